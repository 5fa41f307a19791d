"""What the corpus operators share: shared folders, hold-out folds, row keys and Arrow output."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch that an operator's Python stage returns, and bytes of text in a slice that it turns to Python objects.
OUT_ROWS, SLICE_BYTES = 50_000, 4 << 20
#: The setting by which the shuffle files of an execution go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set a temporary one is made, in local mode only; on a cluster
    that is an error, since executors share no local folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="objectlog-")
        sc.setCheckpointDir(found)
    return found


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions of DataFrames that are made inside leave no shuffle files; each of them runs once, its result is written
    to the shared folder or small."""
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if old is None else spark.conf.set(_CLEAN, old)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*done: DataFrame) -> None:
    """Remove tables that `materialise` has written, of which nothing is read any more."""
    for df in done:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SENT: list[Broadcast] = []


def send(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast a value. What earlier calls have sent may leave the executors: they fetch it again if its plan still runs."""
    while len(_SENT) > 8:
        _SENT.pop(0).unpersist()
    _SENT.append(spark.sparkContext.broadcast(value))
    return _SENT[-1]


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A Python stage that gives its memory back to the system when a task ends; workers live on between tasks."""

    def run(found: Iterator) -> Iterator:
        yield from step(found)
        give_back()

    return run


def give_back() -> None:
    """Free pages of Arrow's and the C library's heaps go back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def rowed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one, ``row``, beside which an operator's own columns may have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def text_of(rows: pa.StructArray) -> pa.Array:
    """The texts of a column that `rowed` made."""
    return rows.field(rows.type.get_field_index("text"))


def with_text(rows: pa.StructArray, texts: list[str | None]) -> pa.StructArray:
    """Such a column with other texts."""
    fields = [f.with_nullable(True) for f in rows.type]
    return pa.StructArray.from_arrays([pa.array(texts, f.type) if f.name == "text" else rows.field(i) for i, f in enumerate(fields)], fields=fields)


def unrowed(found: DataFrame, names: list[str], new: list[str]) -> DataFrame:
    """The columns ``names`` of ``row``, but for those named as one of ``new``, and those."""
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in new], *new)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def share(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that depends only on the columns and the seed, for bounded samples that reruns repeat."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / float(1 << 40)


def _drawn(rows: DataFrame, per_target: int, targets: int) -> DataFrame:
    """Of rows with ``target`` and ``draw`` about twice as many as wanted of each target, so that no target's rows are ever
    sorted by one task."""
    sizes = rows.groupBy("target").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes) if targets <= 100_000 else sizes  # one row for each target
    return rows.join(sizes, "target").filter(F.col("draw") * F.col("n") < 2 * per_target + 100).drop("n")


def labelled(marks: DataFrame, docs: DataFrame, per_target: int, targets: int, seed: int, most_bytes: int) -> DataFrame:
    """A bounded sample (doc_id, text, target) of documents by ``marks`` (doc_id, target), which may repeat: at most
    ``per_target`` ids of each target among those that ``docs`` has, joined to it, and `bounded` again, since ids of documents
    may repeat too. Labels of other documents take no part, however many there are."""
    there = marks.distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = _drawn(there.withColumn("draw", share(seed, F.col("doc_id").cast("string"))), per_target, targets)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("draw", "doc_id"))).filter(F.col("rank") <= per_target)
    chosen = ranked.select("doc_id", "target")
    few = F.broadcast(chosen) if targets * per_target <= 200_000 else chosen
    return bounded(docs.select("doc_id", "text").join(few, "doc_id"), per_target, targets, seed, most_bytes)


def portion(per_target: int, most_bytes: int, targets: int, of: int) -> tuple[int, int]:
    """``per_target`` and ``most_bytes`` for each of so many targets, lowered where they would be more than ``of`` targets' in all
    (one row of each target stays)."""
    return max(1, min(per_target, per_target * of // max(targets, 1))), max(1, min(most_bytes, most_bytes * of // max(targets, 1)))


def bounded(rows: DataFrame, per_target: int, targets: int, seed: int, most_bytes: int) -> DataFrame:
    """At most ``per_target`` of the rows (doc_id, text, target) of each of about ``targets`` targets, and of those as many as
    hold ``most_bytes`` bytes of text (but one at least): those of the least hash of id and text, very long ones last. Rows
    that agree in all count once."""
    rows = rows.filter("text is not null and target is not null").select("doc_id", "text", "target", share(seed, F.col("doc_id").cast("string"), F.col("text")).alias("draw"))
    drawn = _drawn(rows, per_target, targets).dropDuplicates(["target", "draw", "doc_id"])
    own = Window.partitionBy("target").orderBy(F.octet_length("text") > most_bytes // 16, "draw", "doc_id")
    ranked = drawn.withColumns({"rank": F.row_number().over(own), "held": F.sum(F.octet_length("text").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.filter((F.col("rank") <= per_target) & ((F.col("held") <= most_bytes) | (F.col("rank") == 1))).select("doc_id", "text", "target")


def row_key(doc: Any, text: bytes | None) -> tuple[int, int]:
    """128 bits that stand for a row by its id and text, whatever task reads it: rows that agree in both share them."""
    from xxhash import xxh3_128

    h = xxh3_128(repr(doc).encode("utf-8", "replace"))
    h.update(b"\x00" if text is None else b"\x01" + text)
    return struct.unpack("<qq", h.digest())


def batches(columns: list[list], schema: pa.Schema, most: int = 0) -> Iterator[pa.RecordBatch]:
    """The buffered columns as one batch, after which they are empty; nothing while fewer than ``most`` rows wait."""
    if len(columns[0]) > most or (not most and columns[0]):
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for c in columns:
            c.clear()


def slices(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``SLICE_BYTES`` bytes of a text column (one row at least)."""
    sizes = batch.column(column).nbytes / max(batch.num_rows, 1)
    step = max(1, min(rows, int(SLICE_BYTES / max(sizes, 1))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows_of(found: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows of a stream of batches as tuples, in slices so that long texts are never all Python objects at once."""
    for batch in found:
        for part in slices(batch, names[-1] if "text" not in names else "text"):
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
