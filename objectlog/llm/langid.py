"""Language ID by error-correcting output codes: each language has a codeword, a binary n-gram classifier predicts each
bit, and loss-weighted decoding takes the nearest codeword and flags documents between two of them.

A bit's margin is linear in the n-grams, so a worker computes the margins of each distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fold, lean, portion, rowed, send, slices, text_of, unrowed
from .fit import Adam, gather, minibatches, sigmoid
from .subword import WordCache, ngram_ids, plain_words, word_sums

BUCKETS, SIZES, GAIN = 1 << 14, (1, 2, 3, 4), 8.0
#: Documents that training reads of each language at most, and bytes of them; every language is learned. In all it reads as
#: much as that of so many languages, so that more of them make more rows of features only beyond one document of each.
PER_LANGUAGE, MOST_BYTES, LANGUAGES = 400, 4 << 20, 10
#: Pairs of languages that the draws of codewords compare in all, and (document, language) pairs decoded at once.
DRAWN, AT_ONCE = 300_000_000, 512_000
#: A document is ambiguous when the best language leads the second by less than this.
LEAD = 0.2
UNKNOWN = "und"


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1, as far apart as the best of some hundred draws (fewer beyond 1 000); no bit is the same for all."""
    bits, rng, best, apart = max(15, 6 * int(n).bit_length()), np.random.default_rng(seed), None, (-1, -1)
    for _ in range(min(300, max(1, DRAWN // n**2))):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        flat = np.abs(code.sum(0)) == n
        code[rng.integers(0, n, flat.sum()), np.flatnonzero(flat)] *= -1 if n > 1 else 1
        least, total, signs = bits, 0, code.astype(np.float32)
        for at in range(0, n if n > 1 else 0, 1_000):
            gaps = ((bits - signs[at : at + 1_000] @ signs.T) / 2).astype(np.int64)
            total += int(gaps.sum())
            gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = bits  # its own
            least = min(least, int(gaps.min()))
        if best is None or (n > 1 and (least, total / (n * (n - 1))) > apart):
            best, apart = code, (least, total / (n * (n - 1))) if n > 1 else (0, 0)
    return best


def features(text: str | None) -> np.ndarray:
    """The bag over all words: each spreads its share of the text over its n-grams."""
    words, times = np.unique(np.array(plain_words(text), dtype=object), return_counts=True) if text else ([], [])
    if not len(words):
        return np.zeros(BUCKETS)
    own, ids = ngram_ids(list(words), SIZES, BUCKETS)
    return np.bincount(ids, (times / np.bincount(own, minlength=len(words)))[own], BUCKETS) * (GAIN / times.sum())


def train(targets: list[str], rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, their codewords, n-gram weights of all bits, biases, and each bit's say in decoding."""
    names = sorted(set(targets))
    code = codewords(max(len(names), 1))
    number = {t: k for k, t in enumerate(names)}
    y = np.array([number[t] for t in targets], np.int64)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    each = 1 / np.bincount(y, minlength=len(names))[y] if len(y) else np.empty(0)
    adam, right = Adam([w, b], 0.02), np.zeros(code.shape[1])
    steps = list(range(epochs))
    for own, x in minibatches(rows, BUCKETS, len(steps), seed):
        want = code[y[own]]
        g = -want * sigmoid(-want * (x @ w + b)) * (each[own] / each[own].sum())[:, None]
        adam.step([x.T @ g.astype(np.float32), g.sum(0).astype(np.float32)])
    for own, x in minibatches(rows, BUCKETS, 1, seed):
        right += ((x @ w + b) * code[y[own]] > 0).sum(0)
    say = np.clip(2 * right / max(len(rows), 1) - 1, 0.05, 1)
    return names, code, w.astype(float) * GAIN, b.astype(float), say / say.sum()


def decode(margins: np.ndarray, code: np.ndarray, say: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of margins the nearest codeword by weighted logistic loss, its probability, and its lead."""
    step = max(1, AT_ONCE // len(code))
    loss = np.concatenate([(np.logaddexp(0, -margins[at : at + step, None, :] * code[None]) * say).sum(2) * code.shape[1] for at in range(0, max(len(margins), 1), step)])
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


NEW = ["held_out", "lang_pred", "score", "ambiguous"]


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = 3, held: int = 1) -> DataFrame:
    """row (all columns of ``docs``), held_out, lang_pred, score, ambiguous: see `language_id`."""
    spark = docs.sparkSession
    marked = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), parts) != held)).select("doc_id", "text", F.col("lang").cast("string").alias("target"))
    languages = marked.agg(F.approx_count_distinct("target").alias("n")).first().n
    most, most_bytes = portion(per_language, MOST_BYTES, languages, LANGUAGES)
    names, code, w, b, say = train(*gather(bounded(marked, most, languages, 5, most_bytes), features, BUCKETS))
    model = send(spark, (names, code, w.astype(np.float32), b, say))

    def predict(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, w, b, say = model.value
        cache = WordCache(lambda words: word_sums(words, w, SIZES, True))
        for batch in found:
            for part in slices(batch, "row"):
                texts = text_of(part.column("row")).to_pylist()
                lettered = [bool(t) and bool(names) and next((True for c in t if c.isalpha()), False) for t in texts]
                bags = [plain_words(t) if ok else [] for t, ok in zip(texts, lettered, strict=True)]
                cache.add(bags)
                margins = np.stack([cache.mean(bag, code.shape[1]) + b for bag in bags])
                best, p, lead = decode(margins, code, say)
                lang = pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], pa.string())
                sure = pa.array(np.where(lettered, p, 0.0))
                unsure = pa.array([not ok or bool(x < LEAD) for x, ok in zip(lead, lettered, strict=True)], pa.bool_())
                yield pa.record_batch([part.column("row"), part.column("held_out"), lang, sure, unsure], names=["row", *NEW])

    rows = rowed(docs).select("row", (fold(F.col("row.doc_id"), parts) == held).alias("held_out"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rows.mapInArrow(lean(predict), schema)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = 3, held: int = 1) -> DataFrame:
    """All columns of ``docs`` and held_out, lang_pred, score (0 to 1), ambiguous; one row for each row.

    Learns from doc_id, text and non-null lang only, of rows whose crc32(doc_id as text) mod ``parts`` is not ``held`` (a
    null id counts as the empty text): at most ``per_language`` documents of each language, of which there may be any number
    (beyond ``LANGUAGES`` of them fewer documents of each, one at least);
    rows that share an id are drawn one by one. A null text, one without a letter, and any text when nothing could be
    learned is ``und`` with score 0 and ambiguous. Whole texts; repeated rows agree; of languages that are equally near the
    first by name is taken, and the document is ambiguous. Columns of ``docs`` named as the new ones are replaced.
    """
    return unrowed(identified(docs, per_language, parts, held), docs.columns, NEW)
