"""Quality classifier: cumulative-link ordinal regression on graded ratings. One set of hashed-text weights gives a
document's position; ordered thresholds cut the line into grades, which gives its expected grade and tail probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, lean, portion, send, slices
from .fit import Adam, gather, minibatches, sigmoid
from .subword import WordCache, ngram_ids, word_sums

BUCKETS, SIZES, GAIN = 1 << 15, (2, 3, 4), 10.0
#: Rated documents that training reads of each grade, at most, and bytes of them; every grade is learned. In all it reads as
#: much as that of so many grades, but one document of each.
PER_GRADE, MOST_BYTES, GRADES = 1_500, 16 << 20, 4


def raw_words(text: str | None) -> list[bytes]:
    """Words with case and punctuation as they are."""
    return text.encode("utf-8", "replace").split() if text else []


def style(text: str | None, words: list[bytes]) -> list[int]:
    """Buckets of the text's manner: variety of words and lines, length, capitals, marks, digits, in coarse steps."""
    n = max(len(words), 1)
    size = max(len(text or ""), 1)
    lines = (text or "").splitlines() or [""]
    marks = sum(map(len, words)) - sum(len(w.translate(None, b"%&*$#!|~^<>{}[]=@+_/\\")) for w in words)
    step = lambda x, k: min(int(x * k), k)
    said = [f"variety {step(len(set(words)) / n, 10)}", f"length {int(np.log2(n) * 1.0)}", f"lines {step(len(set(lines)) / len(lines), 10)}", f"marks {step(marks / size * 5, 10)}"]
    said += [f"capitals {step(sum(w.isupper() for w in words) / n, 10)}", f"mean {min(size // n, 20)}", f"digits {step(sum(w.isdigit() for w in words) / n, 10)}"]
    return [zlib.crc32(s.encode()) % BUCKETS for s in said]


def features(text: str | None) -> np.ndarray:
    """The bag over distinct words, and the manner's buckets with 1 each."""
    words = raw_words(text)
    out = np.zeros(BUCKETS)
    if words:
        bag = list(dict.fromkeys(words))
        own, ids = ngram_ids(bag, SIZES, BUCKETS)
        out += np.bincount(ids, 1 / np.bincount(own, minlength=len(bag))[own], BUCKETS) * (GAIN / len(bag))
    np.add.at(out, style(text, words), 1.0)
    return out


def train(targets: list[int], rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, seed: int = 3) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The grades in order, the shared weights, and the thresholds between neighbouring grades."""
    grades = sorted(set(targets))
    k = len(grades)
    w = np.zeros((BUCKETS, 1), np.float32)
    if k < 2:
        return grades, w.astype(float), np.empty(0)
    y = np.searchsorted(grades, targets)
    raw = np.concatenate([[-1.0], np.zeros(k - 2)]).astype(np.float32)  # the first threshold, then logs of the steps
    adam = Adam([w, raw], 0.01)
    for own, x in minibatches(rows, BUCKETS, epochs, seed):
        cut = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        f = (x @ w)[:, 0]
        below = sigmoid(cut[None] - f[:, None])  # P(grade <= j)
        full = np.concatenate([np.zeros((len(f), 1)), below, np.ones((len(f), 1))], axis=1)
        a, b = full[np.arange(len(f)), y[own] + 1], full[np.arange(len(f)), y[own]]
        p = np.maximum(a - b, 1e-9)
        g = (1 - a - b) / len(f)
        at_cut = np.zeros((len(f), k + 1))
        at_cut[np.arange(len(f)), y[own] + 1] -= a * (1 - a) / p
        at_cut[np.arange(len(f)), y[own]] += b * (1 - b) / p
        g_cut = at_cut[:, 1:k].mean(0)
        tail = np.cumsum(g_cut[::-1])[::-1]
        adam.step([(x.T @ g.astype(np.float32))[:, None], np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])]).astype(np.float32)])
    return grades, w.astype(float), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])).astype(float)


def quality(docs: DataFrame, ratings: DataFrame, at_least: int = 1, threshold: float = 0.5, per_grade: int = PER_GRADE, parts: int = 3, held: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, expected_grade, tail_prob (P(grade >= at_least)), top_prob
    (P(grade = highest)), selected (tail_prob >= threshold).

    ``ratings`` holds doc_id and an integer grade; null ids and grades are left out, repeated ratings count once. Training
    reads at most ``per_grade`` documents of each grade and ``MOST_BYTES`` bytes of their texts, none held out; there may be
    any number of grades (beyond ``GRADES`` of them fewer documents of each). Null and empty texts are scored by their
    manner alone. With one grade only that grade is certain; with no rating at all the numbers are null and nothing is
    selected. Repeated rows agree; other columns take no part.
    """
    spark = docs.sparkSession
    marked = ratings.select("doc_id", F.col("grade").cast("long").alias("target")).filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    grades_in = marked.agg(F.approx_count_distinct("target").alias("n")).first().n
    most, most_bytes = portion(per_grade, MOST_BYTES, grades_in, GRADES)
    grades, weights, cuts = train(*gather(labelled(marked, docs, most, grades_in, 9, most_bytes), features, BUCKETS))
    model = send(spark, (grades, weights.astype(np.float32), cuts))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, weights, cuts = model.value
        cache = WordCache(lambda words: word_sums(words, weights, SIZES, True) * GAIN)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                words = [raw_words(t) for t in texts]
                bags = [list(set(w)) for w in words]
                cache.add(bags)
                f = [(float(np.sort(cache.of(bag)[:, 0]).mean(dtype=float)) if bag else 0.0) + float(weights[style(t, w), 0].sum(dtype=float)) for t, w, bag in zip(texts, words, bags, strict=True)]
                n = part.num_rows
                if grades:
                    above = np.concatenate([np.ones((n, 1)), 1 - sigmoid(cuts[None] - np.array(f)[:, None])], axis=1) if len(cuts) else np.ones((n, 1))
                    p = above - np.concatenate([above[:, 1:], np.zeros((n, 1))], axis=1)
                    tail = above[:, np.searchsorted(grades, at_least)] if at_least <= grades[-1] else np.zeros(n)
                    out = [pa.array(p @ np.array(grades, float)), pa.array(tail), pa.array(above[:, -1])]
                else:
                    out = [pa.nulls(n, pa.float64())] * 3
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *out], names=["doc_id", "held_out", "expected_grade", "tail_prob", "top_prob"])

    texts = docs.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "text")
    scored = texts.mapInArrow(lean(score), f"doc_id {id_type}, held_out boolean, expected_grade double, tail_prob double, top_prob double")
    return scored.withColumn("selected", F.coalesce(F.col("tail_prob") >= threshold, F.lit(False)))
