"""Benchmark decontamination by an FM-index for each shard of training text.

A shard's words become numbers over the phrases' alphabet; a word that no phrase holds is a break, and runs between
breaks that are shorter than the shortest phrase cannot hold one and are left out. Over what remains stand a suffix
array, its Burrows-Wheeler transform in a wavelet tree, and suffix positions at every eighth place and at the start of
each run. All phrases are searched backward at once by wavelet ranks; hits walk back to a sampled position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, rowed, send, slices, text_of, unrowed, with_text
from .subword import LETTERS

#: Words of text in a shard, words of benchmark items in one search, and the distance of sampled suffix positions.
SHARD_WORDS, ITEM_WORDS, SAMPLE = 1 << 21, 1 << 20, 8
WINDOW = 10


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    return text.lower().translate(LETTERS).split()


class Phrases:
    """Windows of benchmark items as rows of numbers over their own alphabet (1 and up), right-aligned."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.alphabet: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words_of(text)]
            for k in range(max(len(ids) - window, 0) + 1) if ids else ():
                rows.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.items = [sorted(s) for s in rows.values()]
        self.codes = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.codes[i, window - len(r) :] = r
        self.least = int(self.size.min()) if len(rows) else 0


class BitRank:
    """A bit vector with ranks: popcounts of 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols, level by level from the highest bit; each level holds its zeros before its ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1 == 1
            self.levels.append((BitRank(one), int(len(symbols) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        start = np.zeros_like(i)
        for k, (level, zeros) in enumerate(self.levels):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def at(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level, zeros in self.levels:
            one = level.at(i)
            c = c << 1 | one
            r = level.rank(i)
            i = np.where(one, zeros + r, i - r)
        return c


class FMIndex:
    """Index over numbers 0 (break) to ``top``; no phrase holds a break."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(text)
        sa = _suffixes(text)
        self.tree = WaveletTree(text[sa - 1], max(int(top).bit_length(), 1))
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.cumsum(counts) - counts
        start = np.empty(n, bool)  # places after a break, from where no walk goes on
        start[0] = True
        start[1:] = text[:-1] == 0
        marked = (sa % sample == 0) | start[sa]
        self.marked, self.sampled, self.n = BitRank(marked), sa[marked], n

    def search(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of right-aligned rows: the suffixes [low, high) that begin with each."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        for step in range(codes.shape[1]):
            live = np.flatnonzero((step < size) & (low < high))
            if not len(live):
                break
            c = codes[live, codes.shape[1] - 1 - step]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, by walking back to a sampled one."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marked.at(rows[live])
            out[live[done]] = self.sampled[self.marked.rank(rows[live[done]])] + steps
            live = live[~done]
            c = self.tree.at(rows[live])
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; breaks are smaller than words and differ by their position."""
    n = len(text)
    breaks = text == 0
    rank = np.where(breaks, np.cumsum(breaks), text + breaks.sum()).astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (int(rank.max()) + 2) + after if width < n else rank
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n or width >= n:
            return order
        width *= 2


def hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, merged spans [first, last) of words inside an occurrence, and items that occur."""
    get, codes, sizes = phrases.alphabet.get, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        codes.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        codes.append(np.zeros(1, np.int64))
    out: list = [(n, [], []) for n in sizes]
    if not len(phrases.size) or not texts:
        return out
    flat = np.concatenate(codes)
    starts = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
    edge = np.flatnonzero(flat == 0)
    run = np.diff(np.concatenate([[-1], edge])) - 1  # words before each break
    keep = run >= phrases.least
    if not keep.any():
        return out
    length, at = run[keep] + 1, edge[keep] - run[keep]
    place = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())  # of each kept symbol in flat
    text = flat[place]
    index = FMIndex(text, len(phrases.alphabet))
    low, high = index.search(phrases.codes, phrases.size)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(rows):
        return out
    found = index.locate(rows)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + phrases.size[which], -1)
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(covered))
    for first, last in zip(turn[::2], turn[1::2], strict=True):
        a = int(place[first])
        doc = int(np.searchsorted(starts, a, side="right")) - 1
        out[doc][1].append((a - int(starts[doc]), a - int(starts[doc]) + int(last - first)))
    docs = np.searchsorted(starts, place[found], side="right") - 1
    pairs = np.unique(np.stack([docs, which], axis=1), axis=0)
    items: dict[int, set[str]] = {}
    for doc, w in pairs.tolist():
        items.setdefault(doc, set()).update(phrases.items[w])
    for doc, own in items.items():
        out[doc][2].extend(sorted(own))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


NEW = ["n_words", "hit_spans", "hit_items"]


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, item_words: int = ITEM_WORDS, last: Callable | None = None) -> DataFrame:
    """row (all columns of ``docs``), n_words, hit_spans, hit_items: see `find_benchmark`. ``last`` turns batches of them to
    batches of row alone, in the workers that found them."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    parts = max(1, -(-size // (item_words * 6)))
    out = rowed(docs).withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(SPANS), "hit_items": F.array().cast("array<string>")})
    schema = out.schema

    def phrases_of(part: int):  # noqa: ANN202
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        return send(spark, Phrases(sorted((r.item, bytes(r.text)) for r in own), window))

    def shards(texts: pa.Array, phrases) -> Iterator[tuple[int, list[tuple]]]:  # noqa: ANN001
        """(where it begins, what `hits` says of each of its texts) of each shard; copies in a shard are indexed once."""
        at = 0
        while at < len(texts):
            own, number, bytes_ = {}, [], 0
            while at + len(number) < len(texts) and bytes_ < shard_words * 6:
                t = texts[at + len(number)].as_py() or b""
                bytes_ += len(t) if t not in own else 0
                number.append(own.setdefault(t, len(own)))
            got = hits(list(own), phrases.value)
            yield at, [(n, _merged(spans), names) for n, spans, names in (got[k] for k in number)]
            at += len(number)

    def told(rows: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        n, spans, names = zip(*found, strict=True)
        return pa.record_batch([rows, pa.array(n, pa.int64()), pa.array(spans, kinds[0]), pa.array(names, kinds[1])], names=["row", *NEW])

    kinds = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())
    if parts == 1:
        phrases = phrases_of(0)

        def search(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                rows = batch.column("row")
                for at, got in shards(text_of(rows).cast(pa.binary()), phrases):
                    yield told(rows.slice(at, len(got)), got)

        if last:
            return out.select("row").mapInArrow(lean(lambda found: last(search(found))), out.select("row").schema)
        return out.select("row").mapInArrow(lean(search), schema)

    # Each part leaves only what it finds, by text; the documents are read again for each, and joined to all of it once.
    key = F.substring(F.sha2(F.coalesce("row.text", F.lit("")), 256), 1, 32).alias("text_key")
    texts = out.select(key, F.col("row.text").cast("binary").alias("text"))
    parts_found = []
    for part in range(parts):
        phrases = phrases_of(part)

        def search_part(found: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for at, got in shards(batch.column("text"), phrases):
                    hit = [k for k, (_, spans, _) in enumerate(got) if spans]
                    keys = batch.column("text_key").slice(at, len(got)).take(pa.array(hit, pa.int64()))
                    yield pa.record_batch([keys, pa.array([got[k][1] for k in hit], kinds[0]), pa.array([got[k][2] for k in hit], kinds[1])], names=["text_key", "spans", "names"])

        found = texts.mapInArrow(lean(search_part), f"text_key string, spans {SPANS.simpleString()}, names array<string>")
        parts_found.append(materialise(found.groupBy("text_key").agg(F.first("spans").alias("spans"), F.first("names").alias("names")), "benchmark-part"))
        phrases.unpersist()
    all_found = reduce(DataFrame.unionByName, parts_found)  # of a text a row for each part at most
    all_found = all_found.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    joined = out.select("row", key).join(all_found, "text_key", "left").select("row", "spans", "names")

    def settle(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in slices(batch, "row"):
                rows = part.column("row")
                spans = [_merged([(x["first"], x["last"]) for x in s or ()]) for s in part.column("spans").to_pylist()]
                names = [n or [] for n in part.column("names").to_pylist()]
                n = [len(words_of((t or "").encode())) for t in text_of(rows).to_pylist()]
                yield told(rows, list(zip(n, spans, names, strict=True)))

    if last:
        return joined.mapInArrow(lean(lambda found: last(settle(found))), out.select("row").schema)
    return joined.mapInArrow(lean(settle), schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, item_words: int = ITEM_WORDS) -> DataFrame:
    """All columns of ``docs`` and n_words (long), hit_spans (array of word spans [first, last)), hit_items (array of item
    ids as text, sorted); one row for each row.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null texts have no words; null and
    wordless items no windows; a null item id counts as the text ''. Repeated rows are searched once a shard and agree;
    items that share an id count as one. Columns of ``docs`` named as the new ones are replaced. Items go to the workers
    in parts of about ``item_words`` words, each searched by a job of its own, so what is broadcast at once is bounded. With
    several parts only what each finds is written, by a digest of the text, and joined to the documents once.
    """
    return unrowed(searched(docs, benchmark, window, shard_words, item_words), docs.columns, NEW)


def removed(text: str | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans; what stands between them and around them stays once."""
    if not text or not spans:
        return text
    raw = text.encode()
    mask = np.frombuffer(raw.lower().translate(LETTERS), np.uint8) != 32
    # bytes.split() also parts at the other ASCII white space, which LETTERS has turned to spaces
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["first"]]])
        at = int(ends[s["last"] - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every occurrence of a window taken out of ``text``; documents of which no word is left go.

    Columns of ``docs`` may have any name; rows without an occurrence, those of null and empty texts among them, stay as they
    are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "row"):
                spans = part.column("hit_spans").to_pylist()
                if any(spans):
                    texts = [removed(t, s) for t, s in zip(text_of(part.column("row")).to_pylist(), spans, strict=True)]
                    keep = pa.array([not s or any(words_of(t.encode())) for t, s in zip(texts, spans, strict=True)])
                    yield pa.record_batch([with_text(part.column("row"), texts)], names=["row"]).filter(keep)
                else:
                    yield part.select(["row"])

    return searched(docs, benchmark, window, last=cut).select("row.*")
