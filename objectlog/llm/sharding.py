"""Contiguous shards of equal bytes: running sums of sizes within range-sorted partitions, moved on by the totals of the
partitions before, and cut at equal targets.

Rows that agree in all columns are one run with a count until their shards are known, and long runs are dealt in parts, so
neither a hot key nor a hot row fills one task. Only one total for each partition and one row for each shard are ever small
tables; both are bounded by the plan and by a parameter, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, rowed, unrowed

#: Rows of a run of equal rows that stay together in one part.
RUN = 10_000
#: What a row costs besides its text.
ROW_BYTES = 16


def text_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-8 (null: none) and the fixed cost of a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _sums(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part with its partition and with the bytes and rows before it there."""
    task, size, rows = TaskContext.get(), 0, 0
    for batch in found:
        n = batch.column("n").to_numpy()
        own = n * batch.column("size").to_numpy()
        ends, counts = size + np.cumsum(own), rows + np.cumsum(n)
        names = [*batch.schema.names, "partition", "bytes_before", "rows_before"]
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(n), task.partitionId(), np.int32)), pa.array(ends - own), pa.array(counts - n)], names=names)
        if len(n):
            size, rows = int(ends[-1]), int(counts[-1])


def byte_shards(rows: DataFrame, order: list[str], size: Column, shards: int) -> DataFrame:
    """The rows, each in column ``row`` (of whose fields ``size`` is an expression), with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place in the shard).

    Rows are ordered by ``order``, then by a hash of all their columns; a row goes to the shard in which its middle
    lies when the whole is cut into ``shards`` equal stretches, so each cut is off by half a row at most, and a shard by the
    size of one row; a row larger than two shares may leave a neighbouring shard empty. Nulls of
    ``order`` come first; rows that agree in all columns take neighbouring slots; an empty table gives an empty one. Columns
    of a type that can't be grouped (maps) are not supported. The result reads a written table: reruns of lost tasks agree.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    packed = rowed(rows).groupBy("row").agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("part")
    keyed = packed.select("row", "n", F.xxhash64("row").alias("h"), part).withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("part") * RUN))
    keyed = keyed.select("row", *[F.col(f"row.`{c}`").alias(f"k{i}") for i, c in enumerate(order)], "h", "part", "n")
    keyed = keyed.withColumn("size", size.cast("long"))
    keys = [*[f"k{i}" for i in range(len(order))], "h", "part"]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "n", "size")
    schema = T.StructType([*ordered.schema, T.StructField("partition", T.IntegerType()), T.StructField("bytes_before", T.LongType()), T.StructField("rows_before", T.LongType())])
    summed = materialise(ordered.mapInArrow(lean(_sums), schema), "shard-sums")

    # One row for each partition of the sort: small, whatever the number of rows.
    totals = summed.groupBy("partition").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows")).orderBy("partition").collect()
    all_bytes, all_rows, offsets = 0, 0, []
    for t in totals:
        offsets.append((t["partition"], all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + t["bytes"], all_rows + t["rows"]
    spark = rows.sparkSession
    before = spark.createDataFrame(offsets, "partition int, bytes_offset long, rows_offset long")
    placed = summed.join(F.broadcast(before), "partition").select(
        "row", "size", "n", (F.col("bytes_before") + F.col("bytes_offset")).alias("at"), (F.col("rows_before") + F.col("rows_offset")).alias("place")
    )
    single = placed.select("row", "size", "at", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("again"))
    # Decimal, since bytes times shards may not fit 64 bits; twice, since it is the row's middle that counts.
    single = single.withColumn("middle", (F.lit(2) * (F.col("at") + F.col("again") * F.col("size")) + F.col("size")).cast("decimal(20,0)"))
    dealt = single.select("row", "size", F.expr(f"cast(middle * {shards} div cast({2 * max(all_bytes, 1)} as decimal(20,0)) as int)").alias("shard"), (F.col("place") + F.col("again")).alias("place"))
    first = F.broadcast(dealt.groupBy("shard").agg(F.min("place").alias("first")))  # at most `shards` rows
    return dealt.join(first, "shard").select("row", "size", "shard", (F.col("place") - F.col("first")).alias("slot"))


def sharded(docs: DataFrame, shards: int, order: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with size, shard and slot (in place of columns of those names), in shards of equal bytes."""
    found = byte_shards(docs, order or ["doc_id"], text_bytes(F.col(f"row.`{text_col}`")), shards)
    return unrowed(found, docs.columns, ["size", "shard", "slot"])


def write_shards(docs: DataFrame, path: str, shards: int, order: list[str] | None = None) -> None:
    """The documents as Parquet under ``path``, a folder for each shard, in the order of their slots within each file."""
    sharded(docs, shards, order).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int) -> DataFrame:
    """Where each document goes, without its text: doc_id, size, text_crc32 (null text: that of no bytes), law, shard, slot,
    grown_shard (null: the law is equal bytes, which a further shard moves). Only ids, sizes and checksums are shuffled."""
    slim = docs.select("doc_id", text_bytes(F.col("text")).alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    found = byte_shards(slim, ["doc_id"], F.col("row.bytes"), shards)
    return found.select("row.doc_id", "size", F.col("row.crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
