"""Small models in numpy: sparse hashed rows from the executors, dense minibatches and Adam on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, rows_of


def sparse(dense: np.ndarray) -> tuple[bytes, bytes]:
    """Positions and values of the entries that aren't 0, as bytes."""
    at = np.flatnonzero(dense)
    return at.astype(np.uint16 if len(dense) <= 1 << 16 else np.uint32).tobytes(), dense[at].astype(np.float32).tobytes()


def gather(sample: DataFrame, features: Callable[[str], np.ndarray], buckets: int) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Targets and sparse features of a bounded sample (doc_id, text, target), in an order that reruns repeat."""
    kind = "string" if sample.schema["target"].dataType.typeName() == "string" else "long"

    def build(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, text, target in rows_of(found, ["doc_id", "text", "target"]):
            at, values = sparse(features(text))
            yield pa.record_batch([pa.array([str(doc)]), pa.array([target], pa.string() if kind == "string" else pa.int64()), pa.array([at], pa.binary()), pa.array([values], pa.binary())], names=["doc_id", "target", "at", "values"])

    # Few partitions hold the sample's rows; spread them, since features cost more than the scan of the other columns.
    got = sample.select("doc_id", "text", "target").mapInArrow(lean(build), f"doc_id string, target {kind}, at binary, values binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "at", "values", "target")), strict=True))
    wide = np.uint16 if buckets <= 1 << 16 else np.uint32
    return [r[3] for r in rows], [(np.frombuffer(r[1], wide), np.frombuffer(r[2], np.float32)) for r in rows]


def minibatches(rows: list[tuple[np.ndarray, np.ndarray]], buckets: int, epochs: int, seed: int, most: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, dense features), every row once in each epoch."""
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), most):
            own = order[k : k + most]
            x = np.zeros((len(own), buckets), np.float32)
            for a, i in enumerate(own):
                x[a, rows[i][0]] = rows[i][1]
            yield own, x


class Adam:
    """In-place steps on a list of float32 arrays."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.params, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
