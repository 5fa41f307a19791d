"""Substring dedup by content-defined chunking.

A chunk ends at a word whose gear rolling hash over the last 16 bytes is the least of some nine words in a row, so
boundaries depend on nearby bytes only, come back in step after an insertion, and are never more than nine words apart. A digest covers a chunk and the one before it. An occurrence
of a digest is a repeat unless it is the first one, by document id and place. Repeats that follow each other form a run;
runs of at least ``MIN_RUN`` bytes are taken out of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OUT_ROWS, batches, lean, rowed, rows_of, slices, text_of, unrowed, with_text

#: Of so many word starts in a row one ends a chunk, which is one in five of all; a chunk of more bytes than this is cut, at
#: a word if it has one; shorter runs of repeats stay.
WINDOW, MAX_CHUNK, MIN_RUN = 9, 256, 112
#: Digests that a task compares among themselves before it passes on the first of each.
HELD = 250_000
_GEAR = np.random.default_rng(20_240_607).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks of a text, in order; the last is its length."""
    n = len(text)
    if not n:
        return []
    b = np.frombuffer(text, np.uint8)
    h = _GEAR[b]
    for width in (1, 2, 4, 8):  # the sum over 16 bytes of gear << distance
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    # A place is a word's start after white space, or the start of a code point of three bytes and more (scripts without spaces).
    space = (b == 32) | ((b >= 9) & (b <= 13))
    place = np.zeros(n, bool)
    place[1:] = (space[:-1] & ~space[1:]) | ((b[1:] >= 0xE0) & (b[:-1] >= 0x80))
    places = np.flatnonzero(place)
    ends = []
    if len(places) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(h[places - 1], WINDOW).argmin(1)
        ends = places[np.unique(least + np.arange(len(least)))].tolist()
    ends.append(n)
    out, last = [], 0
    for e in ends:
        while e - last > MAX_CHUNK:
            k = int(np.searchsorted(places, last + MAX_CHUNK, side="right")) - 1
            if k >= 0 and places[k] > last:
                last = int(places[k])
            else:
                last += MAX_CHUNK
                while b[last] & 0xC0 == 0x80:  # not inside a code point
                    last -= 1
            out.append(last)
        out.append(e)
        last = e
    return out


def digests(text: bytes, ends: list[int]) -> list[bytes]:
    """The digest of each chunk with the one before it (the first: alone)."""
    from xxhash import xxh3_128_digest

    starts = [0, 0, *ends]
    return [xxh3_128_digest(text[a:e]) for a, e in zip(starts, ends)]


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_key, text_hash, chunks): numbers of the chunks whose digest occurs earlier, of documents that have any.

    ``docs`` has doc_key (integers or text, null first), text_hash (long) and text (binary). Within a task all but the first
    occurrence of a digest are repeats at once, so a digest that very many documents share leaves a task once.
    """
    kind = docs.schema["doc_key"].dataType.simpleString()

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        own: dict[tuple, list[int]] = {}
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            raw, keys = np.frombuffer(b"".join(first), np.int64).reshape(-1, 2), list(first.values())
            for at in range(0, len(keys), OUT_ROWS):
                part, two = keys[at : at + OUT_ROWS], raw[at : at + OUT_ROWS]
                cols = [pa.array([k[1] if k[0] else None for k in part], schema.field("doc_key").type), pa.array([k[2] for k in part], pa.int64()), pa.array([k[3] for k in part], pa.int32())]
                yield pa.record_batch([pa.array(two[:, 0]), pa.array(two[:, 1]), *cols, pa.nulls(len(part), schema.field("own").type)], schema=schema)
            out: list[list] = [[] for _ in schema]
            for (known, doc, h), chunks in own.items():
                for col, value in zip(out, (None, h, doc if known else None, h, None, chunks), strict=True):
                    col.append(value)
                yield from batches(out, schema, OUT_ROWS)
            yield from batches(out, schema)
            first.clear(), own.clear()

        for batch in found:
            schema = schema or pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_key", batch.schema.field("doc_key").type), ("text_hash", pa.int64()), ("chunk", pa.int32()), ("own", pa.list_(pa.int32()))])
            for doc, h, text in rows_of([batch], ["doc_key", "text_hash", "text"]):
                me = (doc is not None, doc, h)
                for chunk, d in enumerate(digests(text, boundaries(text)) if text else ()):
                    key = (*me, chunk)
                    old = first.setdefault(d, key)
                    if old != key:
                        if key < old:
                            first[d] = key
                            old, key = key, old
                        own.setdefault(key[:3], []).append(key[3])
                if len(first) > HELD:
                    yield from flush()
        if schema:
            yield from flush()

    found = docs.select("doc_key", "text_hash", "text").mapInArrow(lean(split), f"h1 long, h2 long, doc_key {kind}, text_hash long, chunk int, own array<int>")
    key = F.struct("doc_key", "text_hash", "chunk")
    known = found.withColumn("first", F.min(key).over(Window.partitionBy("h1", "h2"))).filter(F.col("own").isNotNull() | (key > F.col("first")))
    # Sets, so that copies of a row add nothing.
    return known.select("doc_key", "text_hash", F.explode(F.coalesce("own", F.array("chunk"))).alias("chunk")).groupBy("doc_key", "text_hash").agg(F.collect_set("chunk").alias("chunks"))


def without(text: bytes, chunks: list[int], least: int) -> tuple[bytes, int, int]:
    """The text without its long runs of repeats, its number of chunks, and the runs taken out."""
    ends = boundaries(text)
    again = np.zeros(len(ends) + 2, bool)
    again[np.array(chunks, int) + 1] = True
    # A digest covers its chunk and the one before, and both repeat.
    again[1:-2] |= again[2:-1]
    turn = np.flatnonzero(np.diff(again.astype(np.int8)))
    edge = [0, *ends]
    out, at, runs = [], 0, 0
    for a, b in zip(turn[::2], turn[1::2], strict=True):
        if edge[b] - edge[a] >= least:
            out.append(text[at : edge[a]])
            at, runs = edge[b], runs + 1
    return b"".join([*out, text[at:]]), len(ends), runs


NEW = ["n_bytes", "kept_bytes", "n_chunks", "n_runs"]


def deduplicated(docs: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """row (all columns of ``docs``, repeated passages taken out of ``text``), n_bytes, kept_bytes, n_chunks, n_runs: see
    `substring_dedup`."""
    kind = docs.schema["doc_id"].dataType.typeName()
    ordered = "long" if kind in ("long", "integer", "short", "byte") else "string"
    doc_key, text_hash = F.col("row.doc_id").cast(ordered).alias("doc_key"), F.xxhash64("row.text").alias("text_hash")
    keyed = rowed(docs).select("row", doc_key, text_hash)
    found = repeats(keyed.select("doc_key", "text_hash", F.col("row.text").cast("binary").alias("text")))
    found = found.select(F.col("doc_key").alias("found_key"), F.col("text_hash").alias("found_hash"), "chunks")
    joined = keyed.join(found, F.col("doc_key").eqNullSafe(F.col("found_key")) & (F.col("text_hash") == F.col("found_hash")), "left").select("row", "chunks")

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in slices(batch, "row"):
                rows, texts, cols = part.column("row"), [], ([], [], [], [])
                for text, chunks in zip(text_of(rows).to_pylist(), part.column("chunks").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    kept, n, runs = without(raw, chunks, least) if chunks else (raw, len(boundaries(raw)), 0)
                    texts.append(text if not runs else kept.decode())
                    for col, value in zip(cols, (len(raw), len(kept), n, runs), strict=True):
                        col.append(value)
                yield pa.record_batch([with_text(rows, texts) if any(cols[3]) else rows, *(pa.array(c, pa.int64()) for c in cols)], names=["row", *NEW])

    return joined.mapInArrow(lean(cut), T.StructType([keyed.schema["row"], *(T.StructField(c, T.LongType()) for c in NEW)]))


def substring_dedup(docs: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """All columns of ``docs`` with repeated passages taken out of ``text``, and n_bytes, kept_bytes, n_chunks, n_runs.

    One row for each row. The occurrence that stays is the one of the smallest doc_id (by number or by code point; ids of
    other types go by their text; null ids first), then of the smallest text hash and place; passages that repeat within a
    document leave their first. Runs shorter than ``least`` bytes stay. Rows that agree in id and text are one document and
    get the same result. Null and empty texts stay as they are. Columns of ``docs`` may have any name; those named as the new
    ones are replaced.
    """
    return unrowed(deduplicated(docs, least), docs.columns, NEW)
