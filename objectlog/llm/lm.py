"""LM scoring: a subword lattice. The pieces of an existing vocabulary weight all segmentations of each word; a forward
recursion in log space gives the word's marginal probability, and a document's is the product over its words and one end.

The vocabulary file holds merge ranks, not probabilities. They enter as a Zipf prior, p ~ 1 / (rank + 10), and rounds of
expectation-maximisation over the distinct words of the whole training part turn them into piece probabilities. The
pieces themselves are never trained, and nothing but the lattice's segmentations enters the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_ROWS, batches, fold, lean, materialise, row_key, rows_of, send

#: Words sent to every worker with their scores (the most frequent ones); all others are joined by a shuffle.
FREQUENT = 200_000
#: Words of more bytes are joined by a digest and scored where they stand.
LONG = 48
#: Words that a task holds at once, in number and in bytes.
HELD, HELD_BYTES = 100_000, 8 << 20
#: Weight of the prior against the counts: as if each piece's prior share had been seen in this many pieces of text.
PRIOR = 1_000.0
#: Rounds of expectation-maximisation; each costs about as much as scoring all distinct words once more.
ROUNDS = 1
#: Code points of the longest word that goes through the batched recursion, code points of a batch, and of a window of others.
BATCHED, AT_ONCE, SPAN = 256, 200_000, 8_192
#: What marks the end of a document in the table of counts; words hold no space.
END = b" end"
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def lower_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return text.lower().split()


@dataclass
class Lattice:
    """Pieces as code point strings with natural-log weights; code points without a piece of their own go by bytes."""

    pieces: list[str]
    logp: np.ndarray
    byte_logp: np.ndarray
    end_logp: float = 0.0
    _sorted: tuple = field(default=None, repr=False)

    @staticmethod
    def prior(path: str) -> Lattice:
        """The pieces of a sentencepiece file, weighted by rank: normal pieces, one word mark at most and only in front."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        kept = [(m.id_to_piece(i), -m.get_score(i)) for i in ids]
        kept = [(p, r) for p, r in kept if p and "▁" not in p[1:]]
        weight = np.array([1 / (max(r, 0) + 10) for _, r in kept])
        weight /= weight.sum()
        return Lattice([p for p, _ in kept], np.log(weight * 0.98), np.full(256, math.log(0.01 / 256)), math.log(0.01))

    def _table(self) -> tuple:
        if self._sorted is None:
            with np.errstate(over="ignore"):
                h = np.array([int(x) for x in map(_hash_of, self.pieces)], np.uint64)
            order = np.argsort(h)
            near = np.zeros(1 << 20, bool)
            near[((h * _MIX) >> np.uint64(44)).astype(np.int64)] = True
            single = np.sort(np.array([ord(p) for p in self.pieces if len(p) == 1], np.uint64))
            self._sorted = h[order], order, near, max(map(len, self.pieces)), single
        return self._sorted

    def _edges(self, chars: np.ndarray, inside: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the log weight and the piece number (-1: none, -2: by bytes) at each start inside a word."""
        keys, order, near, longest, single = self._table()
        out = []
        h = np.zeros(chars.shape, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(longest, chars.shape[1]) + 1):
                h = h[:, : chars.shape[1] - n + 1] * _BASE + chars[:, n - 1 :] + np.uint64(1)
                piece = np.full(h.shape, -1, np.int32)
                at = np.nonzero(near[((h * _MIX) >> np.uint64(44)).astype(np.int64)])
                found = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                piece[at] = np.where(keys[found] == h[at], order[found], -1)
                weight = np.where(piece >= 0, self.logp[piece], -np.inf)
                if n == 1:
                    strange = np.nonzero((single[np.minimum(np.searchsorted(single, chars), len(single) - 1)] != chars) & inside)
                    piece[strange] = -2
                    which, number = np.unique(chars[strange], return_inverse=True)
                    weight[strange] = np.array([self._by_bytes(int(c)) for c in which])[number]
                out.append((weight, piece))
        return out

    def _by_bytes(self, char: int) -> float:
        return float(self.byte_logp[list(chr(char).encode("utf-8", "replace"))].sum())

    def words(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of each word; with counts also the expected uses of pieces and bytes.

        Words of like lengths go through the recursion together, filled up on the right; the work is linear in their
        code points, and there are few groups however many lengths there are.
        """
        texts = ["▁" + w.decode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out, uses, by_byte = np.empty(len(texts)), np.zeros(len(self.pieces)), np.zeros(256)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order) and size[order[at]] <= BATCHED:
            most = max(int(size[order[at]] * 1.25), 4)
            end = min(at + max(1, AT_ONCE // most), int(np.searchsorted(size[order], min(most, BATCHED), side="right")))
            own = order[at:end]
            n = int(size[own].max())
            chars = np.frombuffer("".join(texts[i].ljust(n, "\0") for i in own).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64).reshape(len(own), n)
            inside = np.arange(n)[None] < size[own][:, None]
            edges = self._edges(chars, inside)
            ahead = _forward([w for w, _ in edges], n)
            out[own] = ahead[size[own], np.arange(len(own))]
            if counts is not None:
                back = _backward([w for w, _ in edges], size[own])
                for k, (weight, piece) in enumerate(edges, 1):
                    row, col = np.nonzero((piece != -1) & inside[:, : piece.shape[1]])
                    use = np.exp(ahead[col, row] + weight[row, col] + back[col + k, row] - out[own][row]) * counts[own][row]
                    self._used(piece[row, col], use, chars[row, col], uses, by_byte)
            at = end
        for i in order[at:]:
            out[i] = self._long(texts[i], None if counts is None else float(counts[i]), uses, by_byte)
        return out, uses, by_byte

    def _used(self, piece: np.ndarray, use: np.ndarray, chars: np.ndarray, uses: np.ndarray, by_byte: np.ndarray) -> None:
        """Add the uses of edges to those of pieces and bytes."""
        uses += np.bincount(piece[piece >= 0], use[piece >= 0], len(self.pieces))
        which, number = np.unique(chars[piece < 0], return_inverse=True)
        for c, u in zip(which, np.bincount(number, use[piece < 0], len(which)), strict=True):
            np.add.at(by_byte, list(chr(int(c)).encode("utf-8", "replace")), u)

    def _arcs(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, log weight, piece) of the edges that start in the window at ``at``, in the order of their starts."""
        longest = self._table()[3]
        part = np.frombuffer(text[at : at + SPAN + longest - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)[None]
        found = [(np.flatnonzero(p[0, :SPAN] != -1), k, w[0], p[0]) for k, (w, p) in enumerate(self._edges(part, np.ones(part.shape, bool)), 1)]
        start = np.concatenate([s for s, *_ in found])
        order = np.argsort(start, kind="stable")
        each = lambda cols: np.concatenate(cols)[order]
        return start[order] + at, each([np.full(len(s), k) for s, k, *_ in found]), each([w[s] for s, _, w, _ in found]), each([p[s] for s, _, _, p in found])

    def _long(self, text: str, count: float | None, uses: np.ndarray, by_byte: np.ndarray) -> float:
        """The log probability of one long word, window by window; with a count it adds to the uses."""
        n = len(text)
        ahead = [0.0] + [-math.inf] * n
        for at in range(0, n, SPAN):
            for s, k, w, _ in zip(*(x.tolist() for x in self._arcs(text, at)), strict=True):
                ahead[s + k] = _add(ahead[s + k], ahead[s] + w)
        if count is not None:
            back = [-math.inf] * n + [0.0]
            for at in range((n - 1) // SPAN * SPAN, -1, -SPAN):
                start, size, weight, piece = self._arcs(text, at)
                for s, k, w in zip(start[::-1].tolist(), size[::-1].tolist(), weight[::-1].tolist(), strict=True):
                    back[s] = _add(back[s], back[s + k] + w)
                use = np.exp(np.array([ahead[s] for s in start]) + weight + np.array([back[e] for e in start + size]) - ahead[n]) * count
                self._used(piece, use, np.array([ord(text[s]) for s in start], np.uint64), uses, by_byte)
        return ahead[n]

    def refitted(self, uses: np.ndarray, by_byte: np.ndarray, ends: int) -> Lattice:
        """The weights after expected uses: prior plus counts, over all pieces, bytes and the end."""
        w, b, e = uses + PRIOR * np.exp(self.logp), by_byte + PRIOR * np.exp(self.byte_logp), ends + PRIOR * math.exp(self.end_logp)
        total = w.sum() + b.sum() + e
        return Lattice(self.pieces, np.log(w / total), np.log(b / total), math.log(e / total), self._sorted)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(top == -np.inf, -np.inf, np.log(np.exp(terms - top).sum(0)) + top)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _forward(weights: list[np.ndarray], n: int) -> np.ndarray:
    """Log sums over all segmentations of the first 0..n code points: (n + 1, words)."""
    ahead = np.full((n + 1, len(weights[0])), -np.inf)
    ahead[0] = 0
    for i in range(1, n + 1):
        ahead[i] = _log_sum(np.stack([ahead[i - k] + weights[k - 1][:, i - k] for k in range(1, min(len(weights), i) + 1)]))
    return ahead


def _backward(weights: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Log sums over all segmentations of what follows each place of words of the given sizes."""
    n = int(size.max())
    back = np.full((n + 1, len(size)), -np.inf)
    back[size, np.arange(len(size))] = 0
    for i in range(n - 1, -1, -1):
        rest = _log_sum(np.stack([back[i + k] + weights[k - 1][:, i] for k in range(1, min(len(weights), n - i) + 1)]))
        back[i] = np.where(i < size, rest, back[i])
    return back


def key_of(word: bytes) -> bytes:
    """What stands for a word in joins: itself, or a digest of a long one. Digests begin with a space, as no word does."""
    from xxhash import xxh3_128_digest

    return word if len(word) <= LONG else b" h" + xxh3_128_digest(word)


def lm_scores(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod ``parts`` is not ``held`` (a null id counts as the empty text).
    Null and empty texts hold only the end. ``score`` is the lattice's log10 probability of the words and the end;
    ``base_score`` the add-one word model's. Repeated rows are scored and counted each; other columns take no part.
    Word counts are exact over all rows, kept as a table that grows with the vocabulary and is only joined, never
    broadcast; ``frequent`` words (a bounded number) go to the workers with their scores, which keeps hot words out of the
    join. Long words, such as sentences of scripts without spaces, go by digest, the frequent ones among them too, and are
    scored where they stand. With
    no training rows at all, N and V are 0 and the prior weights score. Rows are told apart by 128-bit hashes of id and
    text, so a rerun task agrees with the lost one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (fold(F.col(id_col), parts) == held).alias("held_out"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other, whole, held_bytes = Counter(), set(), {}, 0
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("whole", pa.binary())])

        def out() -> Iterator[pa.RecordBatch]:
            rows = [*train.items(), *((w, 0) for w in other if w not in train)]
            for at in range(0, len(rows), OUT_ROWS):
                part = rows[at : at + OUT_ROWS]
                yield from batches([[w for w, _ in part], [c for _, c in part], [whole.get(w) for w, _ in part]], schema)
            train.clear(), other.clear(), whole.clear()

        for text, held_out in rows_of(found, ["text", "held_out"]):
            words = lower_words(text or b"")
            for i, w in enumerate(words):
                if len(w) > LONG:
                    words[i] = key_of(w)
                    if words[i] not in whole:
                        whole[words[i]] = w
                        held_bytes += len(w)
            if held_out:
                other.update(words)
            else:
                train.update(words)
                train[END] += 1
            if len(train) + len(other) > 4 * HELD or held_bytes > HELD_BYTES:
                yield from out()
                held_bytes = 0
        yield from out()

    found = texts.select("text", "held_out").mapInArrow(lean(count), "word binary, c long, whole binary").groupBy("word")
    counts = materialise(found.agg(F.sum("c").alias("c"), F.first("whole", ignorenulls=True).alias("whole")), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    tokens, distinct, ends = total.n or 0, total.v or 0, total.ends or 0
    model = Lattice.prior(vocabulary)
    words_only = counts.filter(F.col("word") != F.lit(END)).select("word", F.coalesce("whole", "word").alias("text"), "c", F.col("whole").isNull().alias("short"))

    def in_parts(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
        held, size = ([], [], [], []), 0
        for row in rows_of(found, ["word", "text", "c", "short"]):
            for col, value in zip(held, row, strict=True):
                col.append(value)
            size += len(row[1])
            if len(held[0]) >= HELD or size > HELD_BYTES:
                yield held
                held, size = ([], [], [], []), 0
        if held[0]:
            yield held

    def expect_by(sent):
        def expect(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = sent.value
            both = np.zeros(len(lattice.pieces) + 256)
            for _, words, c, _ in in_parts(found):
                _, uses, by_byte = lattice.words(words, np.array(c, float))
                both += np.concatenate([uses, by_byte])
            at = np.flatnonzero(both)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(both[at])], names=["piece", "uses"])

        return lean(expect)

    for _ in range(rounds):
        used = words_only.filter("c > 0").mapInArrow(expect_by(send(spark, model)), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        both = np.zeros(len(model.pieces) + 256)  # as long as the vocabulary, whatever the input
        both[used.column("piece").to_numpy()] = used.column("uses").to_numpy()
        model = model.refitted(both[:-256], both[-256:], ends)

    # Of a long word only its digest and its count are sent; it is scored where it stands.
    hot = words_only.select("word", "c", "short").orderBy(F.desc("c"), "word").limit(frequent).toArrow().to_pydict()
    scores = iter(model.words([w for w, short in zip(hot["word"], hot["short"], strict=True) if short])[0].tolist())
    known = send(spark, (model, {w: (c, next(scores) if short else None) for w, c, short in zip(hot["word"], hot["c"], hot["short"], strict=True)}))
    floor, log10 = tokens + distinct + 1, math.log(10)
    end_score = model.end_logp / log10

    def score_words(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("logp", pa.float64())])
        lattice, hot_known = known.value
        for keys, _, c, short in in_parts(found):
            other = [i for i, w in enumerate(keys) if w not in hot_known]
            logp = np.zeros(len(keys))
            mine = [i for i in other if short[i]]
            logp[mine] = lattice.words([keys[i] for i in mine])[0] / log10
            yield from batches([[keys[i] for i in other], [c[i] for i in other], logp[other].tolist()], schema)

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with the sums over its frequent and long words and the end, and one for each other word."""
        (lattice, hot_known), out, kind, long_scores = known.value, [[] for _ in range(10)], None, {}
        get, held_bytes = hot_known.get, 0
        word, h1, h2, tf = out[:4]
        for batch in found:
            kind = kind or pa.schema([("word", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("tf", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())])
            for doc, text, held_out in rows_of([batch], ["doc_id", "text", "held_out"]):
                key, bag = row_key(doc, text), Counter(lower_words(text or b""))
                n, n_known, base, score = 1, int(ends > 0), math.log10((ends + 1) / floor), end_score
                before = len(word)
                if far := [w for w in bag if len(w) > LONG and w not in long_scores]:
                    if held_bytes > HELD_BYTES:
                        long_scores, held_bytes = {}, 0
                        far = [w for w in bag if len(w) > LONG]
                    long_scores.update(zip(far, (lattice.words(far)[0] / log10).tolist(), strict=True))
                    held_bytes += sum(map(len, far))
                for w, k in bag.items():
                    n += k
                    if len(w) > LONG:
                        score += k * long_scores[w]
                        w = key_of(w)
                    if (there := get(w)) is not None:
                        n_known += k * (there[0] > 0)
                        base += k * math.log10((there[0] + 1) / floor)
                        if there[1] is not None:
                            score += k * there[1] / log10
                        continue
                    word.append(w)
                    tf.append(k)
                word.append(b" %d %d" % key)
                tf.append(0)
                more = len(word) - before
                h1.extend([key[0]] * more)
                h2.extend([key[1]] * more)
                for col, value in zip(out[4:], (doc, held_out, n, n_known, base, score), strict=True):
                    col.extend([None] * (more - 1))
                    col.append(value)
                yield from batches(out, kind, OUT_ROWS)
        if kind:
            yield from batches(out, kind)

    rows = texts.mapInArrow(lean(split), f"word binary, h1 long, h2 long, tf long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, lattice double")
    joined = rows.join(words_only.mapInArrow(lean(score_words), "word binary, c long, logp double"), "word", "left")
    own = lambda c: F.coalesce(F.col(c), F.lit(0))
    c = F.coalesce(F.col("c"), F.lit(0))
    # Rows that agree in id and text share a key; each of them has brought the same sums.
    whole = joined.groupBy("h1", "h2").agg(
        F.count("n_tokens").alias("rows"),
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(own("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(own("base") + F.col("tf") * F.log10((c + 1) / F.lit(float(floor)))).alias("base"),
        F.sum(own("lattice") + F.col("tf") * F.coalesce(F.col("logp"), F.lit(0.0))).alias("lattice"),
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("again")
    return whole.select("doc_id", "held_out", "n_tokens", F.expr("known div rows").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("lattice") / F.col("rows")).alias("score"), again).drop("again")
