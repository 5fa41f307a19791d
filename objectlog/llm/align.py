"""Alignment of two tokenizers over a corpus: where tokens of both end, how often ids meet there, and how well each
document's links agree with the commonest ones.

Texts are cut before spaces that follow a printing character. No token of either vocabulary reaches over such a place (checked
when the vocabularies are loaded), so tokens, groups and links of a piece are found once for each distinct piece that a
task meets, and a document's are those of its pieces in order.

Links are kept by batch of documents and by stripe of ids of the second vocabulary: which pairs, how often, and in which
documents of the batch. A stripe's counts are summed in one dense block (its ids times the first vocabulary) with ``np.add.at``,
whose row maxima are the best counts. For scoring, the links of a stripe lie in lanes of bounded size, each of which reads
that stripe's counts into such a block again; sums by document go back to the batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cleaned, lean, materialise, rows_of

#: Bytes of a dense block of counts; documents and links of a batch; batches in a lane.
BLOCK_BYTES, BATCH_DOCS, BATCH_LINKS, LANE = 256 << 20, 65_000, 1_000_000, 256
#: Distinct pieces that a task keeps, and their characters, until it begins anew.
KEPT, KEPT_CHARS = 400_000, 16_000_000
#: Before spaces, if a printing character stands before them and one follows later on.
CUT = re.compile(r"(?<=\S)(?= \s*\S)")
#: The mark of a space in pieces.
MARK = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing Latin-1 ones for themselves, the others
    in order by those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens, groups and links of pieces of text, by two vocabulary files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        at = byte_level()
        words = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(at[c] for c in w) if all(c in at for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Only then do tokens of a whole text fall apart into those of its pieces.
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces) and not any(re.search(r"\S\s", x.decode("utf-8", "ignore")) for x in self.bytes_a)
        self.forget()

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.bytes_a), len(self.bytes_b)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.said: list[str] = []
        self.chars = 0
        #: By piece: tokens of A (-1: not given back) and of B, number of links, and the links before it; and all links.
        self.table, self.links = np.zeros((4, 0), np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.apart else [" " + text]

    def learn(self, pieces: set[str]) -> None:
        """Have tokens, groups and links (b << 32 | a) of each piece."""
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        new = list(pieces - self.index.keys())
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            # One text of all of them has the tokens of each, but for those that end in white space, which another space would join.
            ends_plain = [p for p in part if not p[-1].isspace()] if self.apart else []
            if ends_plain and (got := self.together(ends_plain)):
                self.keep(ends_plain, *got)
                part = [p for p in part if p[-1].isspace()]
            if part:
                self.keep(part, *self.one_by_one(part))

    def keep(self, part: list[str], n: np.ndarray, said: list[str], links: np.ndarray) -> None:
        self.index.update(zip(part, range(len(self.said), len(self.said) + len(part)), strict=True))
        self.said.extend(said)
        self.chars += sum(map(len, part))
        before = len(self.links) + np.cumsum(n[2]) - n[2]
        self.table = np.concatenate([self.table, np.vstack([n, before])], axis=1)
        self.links = np.concatenate([self.links, links])

    def together(self, part: list[str]) -> tuple[np.ndarray, list[str], np.ndarray] | None:
        """`groups` of pieces from one text of all of them; None if either vocabulary does not give it back."""
        text = "".join(part)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(p.encode()) for p in part])
        upto = lambda ids, sizes: np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, "right"), prepend=0)
        return self.groups(a, b, upto(a, self.size_a), upto(b, self.size_b))

    def one_by_one(self, part: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """`groups` of pieces that are tokenized by themselves; -1 tokens for those that are not given back."""
        tokens_a = [x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
        tokens_b = self.b.encode([p[1:] for p in part], num_threads=1)  # the library puts one space before
        given_back = [b"".join(map(self.bytes_a.__getitem__, x)) == t and b"".join(map(self.bytes_b.__getitem__, y)) == t for t, x, y in zip(map(str.encode, part), tokens_a, tokens_b, strict=True)]
        kept = lambda tokens: [x if ok else [] for x, ok in zip(tokens, given_back, strict=True)]
        flat = lambda tokens: np.array([i for x in tokens for i in x], np.int64)
        a, b = kept(tokens_a), kept(tokens_b)
        n, said, links = self.groups(flat(a), flat(b), np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64))
        n[:2, ~np.array(given_back)] = -1
        return n, said, links

    def groups(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of pieces whose tokens A and B both make up (``n_a`` and ``n_b`` of each): tokens of A, of B and links of each, its
        groups, and all links. The pieces stand in one row of bytes, in which both end together."""
        _, in_a, in_b = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), assume_unique=True, return_indices=True)
        upto = np.searchsorted(in_a, np.cumsum(n_a) - 1, "right")  # links up to each piece's last
        names_a, names_b = [*map(str, a.tolist())], [*map(str, b.tolist())]
        said, i, j = [], 0, 0
        for k, m in zip((in_a + 1).tolist(), (in_b + 1).tolist(), strict=True):
            said.append(f"{names_a[i] if k == i + 1 else ','.join(names_a[i:k])}|{names_b[j] if m == j + 1 else ','.join(names_b[j:m])}")
            i, j = k, m
        ends = upto.tolist()
        return np.vstack([n_a, n_b, np.diff(upto, prepend=0)]), [";".join(said[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)], (b[in_b] << 32) | a[in_a]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of each text the tokens of A and of B, the links and the groups; and all links in order of the texts."""
        cuts = [self.cut(t) if t and MARK not in t else [] for t in texts]
        self.learn({p for c in cuts for p in c})
        own = [[*map(self.index.__getitem__, c)] for c in cuts]
        own = [c if all(self.table[0, c] >= 0) else [] for c in own]
        each = np.array([len(c) for c in own], np.int64)
        flat = np.fromiter((i for c in own for i in c), np.int64, int(each.sum()))
        n_a, n_b, n, before = self.table[:, flat]
        ends = np.cumsum(each)
        total = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))]) for x in (n_a, n_b, n)]
        place = np.repeat(before - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return *total, [";".join(map(self.said.__getitem__, c)) for c in own], self.links[place]


def striped(links: np.ndarray, docs: np.ndarray, stripes: int, width: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Links (b << 32 | a) of a batch by stripe of b: places of the distinct pairs in the stripe's block, how many links each
    has, and the documents of these links."""
    b, a = links >> 32, links & 0xFFFFFFFF
    code = ((b % stripes) << 48) | ((b // stripes) * width + a)
    order = np.argsort(code, kind="stable")
    code, docs = code[order], docs[order].astype(np.uint16)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(code)))
    pairs = code[first]
    edge = np.flatnonzero(np.concatenate(([True], pairs[1:] >> 48 != pairs[:-1] >> 48, [True]))) if len(pairs) else [0]
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        here = slice(first[i], first[j] if j < len(first) else len(code))
        yield int(pairs[i] >> 48), (pairs[i:j] & ((1 << 48) - 1)).astype(np.uint32).tobytes(), sizes[i:j].astype(np.uint32).tobytes(), docs[here].tobytes()


def alignment(docs: DataFrame, path_a: str, path_b: str, text_of_groups: bool = True, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """By document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` (or only ``groups_sha256``); and by
    pair of ids that are linked anywhere: b, a, count, best (count is b's highest, ties included).

    A tokenizers file of byte-level tokens is A, a sentencepiece model B. Null and empty texts, and those that either does not
    give back byte for byte, have no tokens: zeros, empty groups and an empty digest. Each of repeated rows has its row and its
    links count; null ids stay; other columns take no part; an empty table gives two empty ones. Counts are of 64 bits.
    A single run of characters without spaces is tokenized whole, so that memory follows the longest of them.
    """
    spark = docs.sparkSession
    size_a, size_b = Aligner(path_a, path_b).sizes
    height = max(1, min(block_bytes // (8 * size_a), 0xFFFFFFFF // size_a))  # ids of a stripe
    stripes = -(-size_b // height)
    kind_id = docs.schema["doc_id"].dataType
    said = "groups" if text_of_groups else "groups_sha256"

    def tokenize(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and for each batch of them one for each stripe that has links."""
        from hashlib import sha256

        aligner, task, batch, links, owner, held = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0, [], [], 0
        out, n, kind = [[] for _ in range(12)], 0, None

        def links_out() -> None:
            joined = np.concatenate(links) if links else np.empty(0, np.int64)
            for stripe, pairs, sizes, own in striped(joined, np.repeat(np.arange(len(owner)), owner), stripes, size_a):
                for c, v in zip(out, (task, batch, None, None, None, None, None, None, stripe, pairs, sizes, own), strict=True):
                    c.append(v)
            links.clear()
            owner.clear()

        for part in found:
            if kind is None:
                whole, real, raw = pa.int64(), pa.string(), pa.binary()
                kind = pa.schema([("part", pa.int32()), ("batch", whole), ("n", pa.int32()), ("doc_id", part.schema.field("doc_id").type), ("n_a", whole), ("n_b", whole), ("n_links", whole), (said, real), ("stripe", pa.int32()), ("pairs", raw), ("sizes", raw), ("owners", raw)])
            rows = rows_of([part], ["doc_id", "text"])
            while some := [r for _, r in zip(range(256), rows, strict=False)]:
                n_a, n_b, mine, groups, joined = aligner.align([t for _, t in some])
                links.append(joined)
                owner.extend(mine.tolist())
                shown = groups if text_of_groups else [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                m = len(some)
                for c, v in zip(out, ([task] * m, [batch] * m, range(n, n + m), [d for d, _ in some], n_a.tolist(), n_b.tolist(), mine.tolist(), shown, *[[None] * m] * 4), strict=True):
                    c.extend(v)
                held, n = held + len(joined), n + m
                if held >= BATCH_LINKS or n >= BATCH_DOCS:
                    links_out()
                    batch, held, n = batch + 1, 0, 0
                    yield from batches(out, kind)
                yield from batches(out, kind, 5_000)
        if kind:
            links_out()
            yield from batches(out, kind)

    schema = f"part int, batch long, n int, doc_id {kind_id.simpleString()}, n_a long, n_b long, n_links long, {said} string, stripe int, pairs binary, sizes binary, owners binary"
    first = materialise(docs.select("doc_id", "text").mapInArrow(lean(tokenize), schema), "align-links")
    links = first.filter("stripe is not null")

    def block() -> np.ndarray:
        return np.zeros(height * size_a, np.int64)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a stripe, whose rows come together: its pairs, their counts and which of them are the best of their id."""
        sums, now = block(), None

        def summed() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(sums)
            best = sums.reshape(height, size_a).max(1)
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([sums[at].tobytes()], pa.binary()), pa.array([(sums[at] == best[at // size_a]).tobytes()], pa.binary())], names=["stripe", "pairs", "counts", "best"])
            sums[at] = 0

        for stripe, pairs, sizes in rows_of(found, ["stripe", "pairs", "sizes"]):
            if now not in (None, stripe):
                yield from summed()
            now = stripe
            np.add.at(sums, np.frombuffer(pairs, np.uint32), np.frombuffer(sizes, np.uint32).astype(np.int64))
        if now is not None:
            yield from summed()

    by_stripe = links.select("stripe", "pairs", "sizes").repartition(min(stripes, 4096), "stripe").sortWithinPartitions("stripe")
    counted = materialise(by_stripe.mapInArrow(lean(count), "stripe int, pairs binary, counts binary, best binary"), "align-counts")

    with cleaned(spark):
        most = links.groupBy("stripe").count().agg(F.max("count")).first()[0] or 0  # batches that meet a stripe
    lanes = -(-most // LANE) or 1

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch of documents in the lanes of this partition: the best links and the sum of counts by document."""
        sums, good, held, kind = block(), np.zeros(height * size_a, bool), np.empty(0, np.int64), pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("owners", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())])
        out: list[list] = [[] for _ in kind]
        for part, batch, pairs, sizes, owners, counts, best in rows_of(found, ["part", "batch", "pairs", "sizes", "owners", "counts", "best"]):
            at = np.frombuffer(pairs, np.uint32)
            if counts is not None:  # another stripe begins
                sums[held], good[held] = 0, False
                sums[at], good[at], held = np.frombuffer(counts, np.int64), np.frombuffer(best, bool), at
                continue
            own, n = np.frombuffer(owners, np.uint16), np.frombuffer(sizes, np.uint32)
            docs_here, where = np.unique(own, return_inverse=True)
            total, hits = np.zeros(len(docs_here), np.int64), np.zeros(len(docs_here), np.int64)
            np.add.at(total, where, np.repeat(sums[at], n))
            np.add.at(hits, where, np.repeat(good[at], n))
            for c, v in zip(out, (part, batch, docs_here.tobytes(), hits.astype(np.uint32).tobytes(), total.tobytes()), strict=True):
                c.append(v)
            yield from batches(out, kind, 1_000)
        yield from batches(out, kind)

    lane = F.pmod(F.xxhash64("part", "batch"), F.lit(lanes)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    nothing = F.lit(None)
    meet = links.select("stripe", lane.alias("lane"), F.lit(1).alias("later"), "part", "batch", "pairs", "sizes", "owners", nothing.cast("binary").alias("counts"), nothing.cast("binary").alias("best")).unionByName(
        counted.select("stripe", every.alias("lane"), F.lit(0).alias("later"), nothing.cast("int").alias("part"), nothing.cast("long").alias("batch"), "pairs", nothing.cast("binary").alias("sizes"), nothing.cast("binary").alias("owners"), "counts", "best")
    )
    meet = meet.repartition("stripe", "lane").sortWithinPartitions("stripe", "lane", "later").select("part", "batch", "pairs", "sizes", "owners", "counts", "best")
    scored = meet.mapInArrow(lean(score), "part int, batch long, owners binary, best binary, sums binary")

    def settle(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a batch, which come before its documents, are handed to them."""
        now, hits, total, kind = None, np.zeros(BATCH_DOCS, np.int64), np.zeros(BATCH_DOCS, np.int64), None
        out: list[list] = [[] for _ in range(8)]
        for found_batch in found:
            kind = kind or pa.schema([("doc_id", found_batch.schema.field("doc_id").type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], (said, pa.string())])
            for part, batch, owners, best, sums, n, doc, n_a, n_b, n_links, shown in rows_of([found_batch], ["part", "batch", "owners", "best", "sums", "n", "doc_id", "n_a", "n_b", "n_links", said]):
                if (part, batch) != now:
                    now = part, batch
                    hits[:], total[:] = 0, 0
                if n is None:
                    at = np.frombuffer(owners, np.uint16)
                    hits[at] += np.frombuffer(best, np.uint32)
                    total[at] += np.frombuffer(sums, np.int64)
                    continue
                for c, v in zip(out, (doc, n_a, n_b, n_links, n_links, int(hits[n]), int(total[n]), shown), strict=True):
                    c.append(v)
                yield from batches(out, kind, 5_000)
        if kind:
            yield from batches(out, kind)

    sums_only = scored.select("part", "batch", "owners", "best", "sums", nothing.cast("int").alias("n"), nothing.cast(kind_id).alias("doc_id"), *[nothing.cast("long").alias(c) for c in ("n_a", "n_b", "n_links")], nothing.cast("string").alias(said))
    rows = first.filter("n is not null").select("part", "batch", *[nothing.cast("binary").alias(c) for c in ("owners", "best", "sums")], "n", "doc_id", "n_a", "n_b", "n_links", said)
    both = sums_only.unionByName(rows).repartition("part", "batch").sortWithinPartitions("part", "batch", F.col("n").isNotNull())
    by_document = both.mapInArrow(lean(settle), f"doc_id {kind_id.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {said} string")

    def listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, pairs, counts, best in rows_of(found, ["stripe", "pairs", "counts", "best"]):
            at = np.frombuffer(pairs, np.uint32).astype(np.int64)
            yield pa.record_batch([pa.array((at // size_a) * stripes + stripe), pa.array(at % size_a), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(best, bool))], names=["b", "a", "count", "best"])

    return by_document, counted.mapInArrow(listed, "b long, a long, count long, best boolean")
