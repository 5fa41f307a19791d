"""Intermediate results as Parquet in the folder that all executors share."""

from __future__ import annotations

import hashlib
import itertools
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where no folder is set a temporary one is made, in local mode only."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="objectlog-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in such a folder and read it back: the plan starts anew, and a lost executor costs nothing that has been
    written."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(spark: SparkSession, rows: Iterable[tuple], schema: str, name: str, batch: int = 50_000) -> DataFrame:
    """Rows from the driver as a table, a batch in memory at a time."""
    path, rows = folder(spark, name), iter(rows)
    while part := list(itertools.islice(rows, batch)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def version(df: DataFrame) -> str:
    """What tells one state of a table from another: its plan's meaning, the names of its files and their bytes. Files that are
    added or written anew change it; a table without files is told by its plan."""
    sizes = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return hashlib.sha256("\n".join([str(df.semanticHash()), sizes, *sorted(df.inputFiles())]).encode()).hexdigest()
