"""Toxicity: a document is the average of its words' embeddings, a word the average of its character n-grams' and its
own; a linear softmax on top is trained jointly with them in numpy. Misspellings that training never saw share n-grams.

Scoring needs one number for each distinct word, since the average and the softmax's logits are linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, lean, send, slices
from .fit import Adam, gather, minibatches, sigmoid
from .subword import WordCache, ngram_ids, plain_words, word_sums

BUCKETS, SIZES, DIM = 1 << 15, (3, 4, 5), 8
#: Gain on the averages, which toxic words share with hundreds of others.
GAIN = 30.0
#: Labelled documents that training reads of each class, at most, and bytes of them; those with the least hash of id and text.
PER_CLASS, MOST_BYTES = 2_000, 16 << 20


def features(text: str | None) -> np.ndarray:
    """The bag over distinct words: each word spreads 1 / words over its n-grams."""
    words = list(dict.fromkeys(plain_words(text)))
    if not words:
        return np.zeros(BUCKETS)
    own, ids = ngram_ids(words, SIZES, BUCKETS)
    return np.bincount(ids, 1 / np.bincount(own, minlength=len(words))[own], BUCKETS) * (GAIN / len(words))


def train(targets: list[int], rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 600, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weight of each n-gram in the logit of class 1 against class 0, and the bias."""
    y, rng = np.array(targets, np.int64), np.random.default_rng(seed)
    if len(set(targets)) < 2:  # nothing to tell apart: the only class, or no label at all
        return np.zeros((BUCKETS, 1)), 6.0 if targets and targets[0] == 1 else -6.0
    e, w, b = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    adam, each = Adam([e, w, b], 0.02), 0.5 / np.bincount(y, minlength=2)[y]  # both classes weigh the same
    for own, x in minibatches(rows, BUCKETS, -(-steps * 64 // len(rows)), seed):
        h = x @ e
        z = h @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(own)), y[own]] -= 1
        p *= (each[own] / each[own].sum())[:, None]
        adam.step([x.T @ (p @ w.T), h.T @ p, p.sum(0)])
    return ((e @ (w[:, 1] - w[:, 0])) * GAIN)[:, None].astype(float), float(b[1] - b[0])


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    ``labels`` holds doc_id and toxic (0 or 1; other values and null ids are left out; repeated labels count once, a document
    with both is learned as both). Training reads at most ``per_class`` documents of each class and ``MOST_BYTES`` bytes of
    their texts, whatever ids and labels repeat, and none of those held out (crc32(doc_id as text) mod ``parts`` = ``held``).
    Only texts are scored: whole texts; null, empty and wordless ones get the bias's score. Repeated rows get the same
    score; other columns take no part. With labels of one class only, or none, every score is that class's.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("toxic").cast("long").alias("target")).filter(F.col("doc_id").isNotNull() & F.col("target").isin(0, 1) & (fold(F.col("doc_id"), parts) != held))
    weights, bias = train(*gather(labelled(marked, docs, per_class, 2, 3, MOST_BYTES), features, BUCKETS))
    model = send(spark, (weights.astype(np.float32), bias))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        cache = WordCache(lambda words: word_sums(words, w, SIZES, True))
        for batch in found:
            for part in slices(batch, "text"):
                bags = [list(set(plain_words(t))) for t in part.column("text").to_pylist()]
                cache.add(bags)
                # Sorted, so that sums don't depend on the order of a set.
                out = [float(np.sort(cache.of(bag)[:, 0]).mean(dtype=float)) if bag else 0.0 for bag in bags]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(sigmoid(np.array(out) + b))], names=["doc_id", "held_out", "score"])

    texts = docs.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "text")
    return texts.mapInArrow(lean(score), f"doc_id {id_type}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
