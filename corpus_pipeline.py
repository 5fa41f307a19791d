"""From raw documents to a training mix: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of documents, whatever they are called beside doc_id, text, lang and source, in rows of
the input; an empty table gives an empty one. Ties go by id, and rows that agree in id and text are one document to the
stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlog.llm import chunks, decontaminate, langid, mixing, near
from objectlog.llm.common import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, and those between two languages, go."""
    return langid.identified(docs).filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: the document of the smallest id of each group stays. Wordless texts
    are groups of their own, rows that agree in id and text count as one."""
    return near.one_of_each(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur before (by id) are taken out; documents that held nothing else go. Null texts stay as they are."""
    found = chunks.deduplicated(docs)
    return found.filter((F.col("n_runs") == 0) | F.col("row.text").rlike("[^\\x20\\x09-\\x0D]")).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows are taken out; documents that held nothing else go. Null texts stay as they are."""
    return decontaminate.remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words that is; the columns of `mixing.mix`."""
    return mixing.mix(docs).filter("copies > 0").drop("row_hash")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the learned and the sampled stages.
ORACLE_SQL = None
