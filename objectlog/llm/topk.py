"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. A block of candidates keeps, for each dimension, one bitmap over its rows for each
binary digit. A query's score is a sum of such bitmaps: the digits of its own component say which slices are added at
which weight (complemented slices for negative components), and carry-save adders turn them into bit slices of the score,
64 rows to a machine word. The best rows are then selected from the most significant slice downward; rows that tie at the
boundary are taken by their ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Candidates in a block of the index, queries that one task runs against a block, and queries added at once.
BLOCK, QUERIES, AT_ONCE = 8_192, 1_024, 64
SCALE = 256
#: A vector whose scaled components are below this, divided by the root of their number, has scores below 2 ** 58.
SAFE = 1 << 29


def _bits(top: int) -> int:
    return max(int(top).bit_length(), 1)


def _sum_planes(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """Carry-save addition: bit planes by weight in, one plane for each weight out."""
    out: list[np.ndarray | None] = []
    w = 0
    while w <= max(columns, default=-1):
        planes = columns.get(w, [])
        carry = columns.setdefault(w + 1, []) if len(planes) > 1 else []
        while len(planes) > 2:
            a, b, c = planes.pop(), planes.pop(), planes.pop()
            x = a ^ b
            planes.append(x ^ c)
            carry.append((a & b) | (x & c))
        if len(planes) == 2:
            a, b = planes
            carry.append(a & b)
            planes = [a ^ b]
        out.append(planes[0] if planes else None)
        w += 1
    return out


class BitSlices:
    """The index of one block: rows (n, dimensions) of integers, in the order that breaks ties."""

    def __init__(self, rows: np.ndarray):
        self.n, self.low = len(rows), rows.min(0)
        unsigned = rows - self.low
        self.words = -(-self.n // 64)
        self.full = self._pack(np.ones(self.n, bool))
        self.slices = [[self._pack((unsigned[:, d] >> b) & 1 == 1) for b in range(_bits(unsigned[:, d].max()))] for d in range(rows.shape[1])]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, bool)
        out[: self.n] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def scores(self, queries: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
        """Slices of the scores (queries, words), least significant first, and what to add to each query's scores."""
        columns: dict[int, list[np.ndarray]] = {}
        size, negative = np.abs(queries), queries < 0
        add = queries @ self.low
        for d, slices in enumerate(self.slices):
            flip = np.where(negative[:, d], np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            add = add - np.where(negative[:, d], size[:, d] * ((1 << len(slices)) - 1), 0)
            digits = [np.where((size[:, d] >> j) & 1 == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None] for j in range(_bits(size[:, d].max()))]
            for b, plane in enumerate(slices):
                signed = plane[None] ^ flip
                for j, digit in enumerate(digits):
                    column = columns.setdefault(b + j, [])
                    column.append(signed & digit)
                    if len(column) >= 24:  # what waits stays in the cache
                        self._reduce(columns, b + j)
        return _sum_planes(columns), add

    @staticmethod
    def _reduce(columns: dict[int, list[np.ndarray]], w: int) -> None:
        planes, carry = columns[w], columns.setdefault(w + 1, [])
        while len(planes) > 2:
            a, b, c = planes.pop(), planes.pop(), planes.pop()
            x = a ^ b
            planes.append(x ^ c)
            carry.append((a & b) | (x & c))
        if len(carry) >= 24:
            BitSlices._reduce(columns, w + 1)

    def top(self, queries: np.ndarray, k: int, allowed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, rows, scores) of the k best rows among ``allowed`` (queries, words); ties to the earlier row."""
        slices, add = self.scores(queries)
        sure, tied = np.zeros_like(allowed), allowed.copy()
        for plane in reversed(slices):
            if plane is None:
                continue
            both = tied & plane
            count = np.bitwise_count(sure | both).sum(1)
            few = (count < k)[:, None]
            sure = np.where(few, sure | both, sure)
            tied = np.where(few, tied & ~plane, both)
        for q in range(len(queries)):
            rows = np.flatnonzero(np.unpackbits(sure[q].view(np.uint8), bitorder="little"))
            edge = np.flatnonzero(np.unpackbits(tied[q].view(np.uint8), bitorder="little"))[: max(k - len(rows), 0)]
            rows = np.concatenate([rows, edge])
            score = np.full(len(rows), int(add[q]), np.int64)
            for w, plane in enumerate(slices):
                if plane is not None:
                    score += ((plane[q][rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
            yield q, rows, score


def integers(row: pd.Series) -> np.ndarray:
    """The components of a row as Python integers: floor(256 * component), whatever its size."""
    if row["wide"] is None:
        return np.array([int(x) for x in row["v"]], object)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in map(float, row["wide"])], object)


def any_size(own: pd.DataFrame, wanted: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of each query, in integers of any size."""
    if not len(own) or not len(wanted):
        return []
    ids, rows = own["vec_id"].to_numpy(), np.stack([integers(r) for _, r in own.iterrows()])
    out = []
    for _, w in wanted.iterrows():
        score = rows @ integers(w)
        best = heapq.nsmallest(k, np.flatnonzero(ids != w["vec_id"]).tolist(), key=lambda r: (-score[r], r))
        out += [(int(w["vec_id"]), int(ids[r]), int(score[r])) for r in best]
    return out


def sort_key(n: int) -> bytes:
    """Bytes that sort, among numbers of one sign, as the numbers do."""
    size = abs(n).to_bytes(-(-abs(n).bit_length() // 8))
    key = len(size).to_bytes(2) + size
    return key if n > 0 else bytes(255 - x for x in key)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score (integer inner product of
    floor(256 * component)) of its k best rows other than itself, ties to the smaller id; fewer if there are fewer.

    Rows with a null id, a null vector or a null or non-finite component take no part. Only vectors of equal length are
    compared; empty ones all score 0. Rows that share a query's id count as its own row, and an id with several vectors has
    one ranking over the scores of all of them; repeated candidates count each.
    Vectors too large for sums of 64 bits are compared in integers of any size; a score that no long holds is ranked all
    the same and given as null. Queries meet candidates in blocks: (queries / 1024) x (rows / 8192) tasks, none of which
    holds more than one block of each.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine).withColumn("dim", F.size("v"))
    small = F.forall("v", lambda x: F.abs(x) < F.lit(float(SAFE)) / SCALE / F.sqrt(F.greatest("dim", F.lit(1))))
    # Of v and wide, one is null.
    v = v.select("vec_id", F.when(small, F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))).alias("v"), F.when(~small, F.col("v")).alias("wide"), "dim")
    # No result holds more than k copies of a row: of rows that agree no more take part, so that none fills a block.
    v = materialise(v.groupBy("vec_id", "v", "wide", "dim").agg(F.least(F.count("*"), F.lit(k)).alias("n")), "vectors").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    asked = v.filter((F.pmod("vec_id", F.lit(every)) == 0) & (F.col("copy") == 1))
    n = v.agg(F.count("*").alias("n"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")).alias("q")).first()
    c_blocks, q_blocks = max(1, -(-n.n // block)), max(1, -(-(n.q or 0) // queries))
    spread = lambda seed, count, *cols: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(count)).cast("int")
    candidates = v.withColumn("c", spread(1, c_blocks, "vec_id", "v", "wide")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = asked.withColumn("q", spread(2, q_blocks, "vec_id", "v", "wide")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))

    def search(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(wanted):
            own, wanted = own.sort_values("vec_id", kind="stable"), wanted.sort_values("vec_id", kind="stable")
            near, asks = own[own["wide"].isna()], wanted[wanted["wide"].isna()]
            if len(near) and len(asks):
                out += narrow(near, asks)
            out += any_size(own[own["wide"].notna()], wanted, k)
            out += any_size(near, wanted[wanted["wide"].notna()], k)
        out = [(q, i, 0, s, None) if -(1 << 63) <= s < 1 << 63 else (q, i, 1 if s > 0 else -1, None, sort_key(s)) for q, i, s in out]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "beyond", "score", "key"]).astype({"score": "Int64", "key": object})

    def narrow(own: pd.DataFrame, wanted: pd.DataFrame) -> list[tuple[int, int, int]]:
        out = []
        ids, rows = own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()).astype(np.int64).reshape(len(own), -1)
        index = BitSlices(rows) if rows.shape[1] else None
        for at in range(0, len(wanted), AT_ONCE):
            q_ids = wanted["vec_id"].to_numpy()[at : at + AT_ONCE]
            if index is None:
                out += [(int(q), int(i), 0) for q in q_ids for i in ids[ids != q][:k]]
                continue
            q_rows = np.stack(wanted["v"].to_numpy()[at : at + AT_ONCE]).astype(np.int64)
            allowed = np.stack([index.full & index._pack(ids != q) for q in q_ids])
            for q, found, score in index.top(q_rows, k, allowed):
                out += [(int(q_ids[q]), int(ids[r]), int(s)) for r, s in zip(found, score, strict=True)]
        return out

    found = candidates.groupBy("dim", "c", "q").cogroup(asked.groupBy("dim", "c", "q")).applyInPandas(search, "query_id long, vec_id long, beyond int, score long, key binary")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("key"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
