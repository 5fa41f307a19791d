"""A directly-follows graph that inserts keep up to date: only the objects that new events touch are looked at again.

Kept are the rows of traces (by folders of hashed objects), how many objects have each pair of events (as changes, by folders of
hashed first events), and changes of the edges' counts. An insert reads the folders of its objects and pairs, takes the
pairs of the touched objects before and after, and adds what is different. Every row names its insert; an insert counts once
its number is written, which is done last, so one that failed half-way leaves nothing behind.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import ObjectLog
from ..sources.staging import staged
from .crowds import dealt, tasks
from .traces import paired, trace

BUCKETS = 64
SCHEMAS = {
    "traces": "otype string, oid string, eid string, activity string, ts timestamp, batch string, bucket int",
    "pairs": "otype string, e1 string, e2 string, change long, batch string, bucket int",
    "edges": "otype string, src string, tgt string, change long, batch string",
}


def _bucket(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def _kept(spark: SparkSession, folder: str, name: str, near: DataFrame | None = None) -> DataFrame:
    """What finished inserts have written, of the folders of ``near`` (with a bucket) alone."""
    done = spark.read.schema("batch string").parquet(f"{folder}/batches")
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    if near is not None:
        rows = rows.filter(F.col("bucket").isin([r[0] for r in near.select("bucket").distinct().collect()]))  # at most BUCKETS
    return rows.join(F.broadcast(done), "batch", "left_semi")  # one row for each insert


def _filed(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by bucket, so that each folder gets few files; a bucket of many rows by several tasks."""
    lanes = max(1, tasks(rows) // BUCKETS)
    return dealt(rows, "bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(lanes)))


def create(spark: SparkSession, folder: str) -> None:
    """An empty graph."""
    for name, schema in {**SCHEMAS, "batches": "batch string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")


def insert(log: ObjectLog, folder: str) -> int:
    """Add the events of a log; how many rows of traces are new. An event that an object has already is left as it is."""
    spark, batch = log.spark, uuid.uuid4().hex
    # Every step is dealt over tasks by its size, so that none holds more as the log grows.
    rows = staged(trace(replace(log, e2o=dealt(log.e2o, "eid", beside=(log.events,)))).withColumn("bucket", _bucket("otype", "oid")), "touched")
    there = _kept(spark, folder, "traces", rows)
    row = ["otype", "oid", "eid"]
    new = staged(dealt(rows, *row, beside=(there,)).join(there.select(*row), row, "left_anti"), "new-rows")
    touched = new.select("otype", "oid").distinct()
    columns = ["otype", "oid", "eid", "activity", "ts"]
    old = staged(there.join(touched, ["otype", "oid"], "left_semi").select(*columns), "touched-before")
    change = lambda df, by: paired(df).select("otype", "e1", "e2", "src", "tgt", F.lit(by).cast("long").alias("change"))
    both = change(old, -1).unionByName(change(old.unionByName(new.select(*columns)), 1))
    changed = dealt(both, "e1").groupBy("otype", "e1", "e2", "src", "tgt").agg(F.sum("change").alias("change")).filter("change <> 0").withColumn("bucket", _bucket("e1"))
    changed = staged(changed, "changed-pairs")
    key = ["otype", "e1", "e2"]
    there = _kept(spark, folder, "pairs", changed)
    before = dealt(there, *key, beside=(changed,)).groupBy(*key).agg(F.sum("change").alias("objects"))
    met = changed.join(before, key, "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    # An edge counts a pair of events once, however many objects of the type have it.
    step = (F.col("objects") + F.col("change") > 0).cast("long") - (F.col("objects") > 0).cast("long")
    edges = met.groupBy("otype", "src", "tgt").agg(F.sum(step).alias("change")).filter("change <> 0")
    name = F.lit(batch).alias("batch")
    edges.select("*", name).write.mode("append").parquet(f"{folder}/edges")
    _filed(new.select(*columns, name, "bucket")).write.mode("append").partitionBy("bucket").parquet(f"{folder}/traces")
    _filed(changed.select(*key, "change", name, "bucket")).write.mode("append").partitionBy("bucket").parquet(f"{folder}/pairs")
    gained = new.count()
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{folder}/batches")
    return gained


def dfg_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """otype, src, tgt, frequency: as `traces.dfg_by_type` of all that was inserted, from the changes of edges alone."""
    return _kept(spark, folder, "edges").groupBy("otype", "src", "tgt").agg(F.sum("change").alias("frequency")).filter("frequency > 0")


def dfg(spark: SparkSession, folder: str) -> DataFrame:
    """src, tgt, frequency: as `traces.dfg`."""
    return dfg_by_type(spark, folder).groupBy("src", "tgt").agg(F.sum("frequency").alias("frequency"))
