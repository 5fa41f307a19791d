"""Token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies, and
summed; token ids are never materialised.

Words travel to their counts by the chunk: a run of a task's documents, of which each distinct word is sent once, with the
places of its documents in the chunk. Back come sums by place.

A pre-token is a run of bytes without ASCII white space. No rule of the vocabularies this is for reaches across ASCII
white space, so a text's token count is the sum over its pre-tokens.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cleaned, lean, rows_of, send

#: Pre-tokens whose counts are sent to every worker (the most frequent ones); all others are joined by a shuffle.
FREQUENT = 200_000
#: Distinct pre-tokens that a task counts before it passes on those it saw often enough to be frequent.
HELD = 400_000
#: Pairs of a document and a word that fill a chunk, documents that a place (16 bits) tells apart, and pairs in a message.
CHUNK, PLACES, MESSAGE = 200_000, 1 << 16, 1_024
#: What a message holds: words joined by spaces, in how many documents each is, and their places and counts.
_SENT = [("part", pa.int32()), ("chunk", pa.binary()), ("messages", pa.int64()), ("n_bytes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("words", pa.binary()), ("times", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())]
_BACK = "chunk binary, messages long, n_bytes array<long>, known array<long>, places binary, counts binary"


def piece_counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """A function from pre-tokens to their numbers of tokens, by the library that belongs to the file's ending."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A piece model marks the text's first word as it marks all others, so each pre-token counts as it does inside a text.
        return lambda words: [len(x) for x in model.encode([w.decode() for w in words], num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda words: [len(x) for x in encode([w.decode() for w in words], add_special_tokens=False)]


def frequent_words(texts: DataFrame, split: Callable[[bytes], list[bytes]], most: int = FREQUENT) -> list[bytes]:
    """The words that make up the largest part of a binary column ``text``, at most ``most`` of them.

    Each task passes on the words that reach 1 / (5 * most) of what it has read; a word with that share of all rows
    reaches it in at least one task. The result only decides which of two exact ways a word takes.
    """

    def local(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

        def often() -> Iterator[pa.RecordBatch]:
            least = sum(seen.values()) / (5 * most)
            out = [(w, n) for w, n in seen.items() if n >= least and n > 1]
            yield from batches([[w for w, _ in out], [n for _, n in out]], schema)
            seen.clear()

        for (text,) in rows_of(found, ["text"]):
            if text:
                seen.update(split(text))
                if len(seen) > HELD:
                    yield from often()
        yield from often()

    counted = texts.select("text").mapInArrow(lean(local), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with cleaned(texts.sparkSession):
        return counted.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0).to_pylist()


def chunked(found: Iterator[pa.RecordBatch], known: dict[bytes, int], parts: int, task: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) as chunks: for each one row, in part ``task % parts``, with its documents, their bytes, what their
    known words amount to and how many messages follow, and messages of its other words, in the part that a word's hash tells."""
    from xxhash import xxh3_128

    get, schema, chunks = known.get, None, 0
    ids, sizes, totals, at, pairs, mark = [], [], [], {}, 0, xxh3_128()

    def flush() -> pa.RecordBatch:
        # The same documents in the same task and order make the same chunk, so a rerun agrees with the lost task.
        chunk = mark.digest() + struct.pack("<ii", task, chunks)
        dealt: dict[int, list[list[bytes]]] = defaultdict(lambda: [[]])
        filled: Counter = Counter()
        for w in sorted(at):
            part = zlib.crc32(w) % parts
            if filled[part] >= MESSAGE:
                dealt[part].append([])
                filled[part] = 0
            dealt[part][-1].append(w)
            filled[part] += len(at[w]) // 2
        rows = []
        for part, messages in dealt.items():
            for words in messages:
                both = [x for w in words for x in at[w]]
                rows.append((part, chunk, None, None, None, b" ".join(words), array("I", [len(at[w]) // 2 for w in words]).tobytes(), array("H", both[::2]).tobytes(), array("I", both[1::2]).tobytes(), None))
        rows.append((task % parts, chunk, len(rows), sizes, totals, None, None, None, None, ids))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in found:
        schema = schema or pa.schema([*_SENT, ("ids", pa.list_(batch.schema.field("doc_id").type))])
        for doc, text in rows_of([batch], ["doc_id", "text"]):
            total, place = 0, len(ids)
            for w, k in Counter(text.split()).items() if text else ():
                if (p := get(w)) is None:
                    pairs += 1
                    if (there := at.get(w)) is None:
                        at[w] = [place, k]
                    else:
                        there += (place, k)
                else:
                    total += p * k
            ids.append(doc)
            sizes.append(len(text or b""))
            totals.append(total)
            mark.update(repr((doc, text is None, sizes[-1])).encode("utf-8", "replace"))
            mark.update(text or b"")
            if pairs >= CHUNK or len(ids) == PLACES:
                yield flush()
                chunks += 1
                ids, sizes, totals, at, pairs, mark = [], [], [], {}, 0, xxh3_128()
    if ids:
        yield flush()


def summed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_tokens: of the rows of whole chunks, one after the other, each document once.

    RuntimeError if a chunk lacks rows: then a task was run again and read its documents in another order, as it can if they come
    from a shuffle. Documents that are read from files don't do that."""
    chunk, first, got = None, None, []

    def whole() -> pa.RecordBatch:
        if first is None or first["messages"] != len(got):
            raise RuntimeError("documents came in another order when a task was run again; write them to files first")
        n = np.array(first["known"], np.int64)
        for places, counts in got:
            n[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)  # a message's places are distinct
        return pa.record_batch([first["ids"], pa.array(first["n_bytes"], pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in found:
        of = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        for i in range(batch.num_rows):
            if (name := of["chunk"][i].as_py()) != chunk:
                if chunk is not None:
                    yield whole()
                chunk, first, got = name, None, []
            if of["messages"][i].is_valid:
                first = {c: of[c][i].as_py() for c in ("messages", "n_bytes", "known")} | {"ids": of["ids"][i].values}
            else:
                got.append((of["places"][i].as_py(), of["counts"][i].as_py()))
    if chunk is not None:
        yield whole()


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; each of repeated rows has its row; other columns
    of ``docs`` take no part. No begin, end or added special tokens; special strings inside texts as the library's
    default has them; no truncation. The frequent pre-tokens (a bounded number) are counted on the driver and sent to
    the workers; the others meet in one shuffle by pre-token, where each distinct one is counted once, and their sums in a
    second one by chunk.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    words = frequent_words(texts, bytes.split, frequent)
    known = send(spark, dict(zip(words, piece_counter(tokenizer)(words) if words else [], strict=True)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunked(found, known.value, parts, TaskContext.get().partitionId())

    def resolve(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Join the words of this partition to the counts of its distinct words, and sum them by document."""
        count, cache = piece_counter(tokenizer), {}
        for batch in (b.slice(at, 256) for b in found for at in range(0, b.num_rows, 256)):
            of = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            told = [(x or b"").split() for x in of["words"].to_pylist()]
            if len(cache) > HELD:
                cache.clear()
            if new := [w for w in dict.fromkeys(w for x in told for w in x) if w not in cache]:
                cache.update(zip(new, count(new), strict=True))
            places, sums = [], []
            for x, times, place, n in zip(told, *(of[c].to_pylist() for c in ("times", "places", "counts")), strict=True):
                if place is None:
                    places.append(None)
                    sums.append(None)
                    continue
                pieces = np.repeat(np.fromiter((cache[w] for w in x), np.int64, len(x)), np.frombuffer(times, np.uint32)) * np.frombuffer(n, np.uint32)
                own, at = np.unique(np.frombuffer(place, np.uint16), return_inverse=True)
                places.append(own.tobytes())
                sums.append(np.bincount(at, pieces).astype(np.uint32).tobytes())
            yield pa.record_batch([of["chunk"], of["messages"], of["n_bytes"], of["known"], pa.array(places, pa.binary()), pa.array(sums, pa.binary()), of["ids"]], names=["chunk", "messages", "n_bytes", "known", "places", "counts", "ids"])

    sent = texts.mapInArrow(lean(split), f"part int, chunk binary, messages long, n_bytes array<long>, known array<long>, words binary, times binary, places binary, counts binary, ids array<{id_type}>")
    back = sent.repartitionById(parts, "part").mapInArrow(lean(resolve), f"{_BACK}, ids array<{id_type}>")
    found = back.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(summed), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
