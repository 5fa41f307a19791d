"""Mixing sources to target weights by the cube method.

Each source's target is a share of all words; a document is taken target / source_size times on average. The whole part
of that is certain, the fraction is an inclusion probability. The flight phase moves the fractions of three documents at
a time along the null space of the two balancing constraints (words and documents) until one of them is 0 or 1. It runs
in blocks of a source; what each block leaves open (two documents at most) forms the next level's blocks, until one block
a source is left. Landing then settles its last documents by the smallest error in words.
"""

from __future__ import annotations

import itertools
import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Documents in a block of the flight phase, on average.
BLOCK = 2_000
#: Weights of the sources in the order of their names, repeating, and the most a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of the total by weight, at most ``most`` times its size, the excess shared
    again by weight until none is above. Sources by code point, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # Python compares text by code point
    total = float(sum(n for _, n in order))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, done = dict(order), {}
    while len(done) < len(order):
        rest, share = total - sum(done.values()), sum(w for s, w in weight.items() if s not in done)
        above = {s: float(most * size[s]) for s, w in weight.items() if s not in done and rest * w / share > most * size[s]}
        if not above:
            done |= {s: rest * w / share for s, w in weight.items() if s not in done}
        done |= above
    return done


def flight(p: list[float], x: list[float], seed: int) -> None:
    """Move the probabilities ``p`` in place, keeping sum(p) and sum(p * x), until at most two are between 0 and 1."""
    rng, eps = random.Random(seed), 1e-9
    waiting = [i for i, v in enumerate(p) if eps < v < 1 - eps]
    rng.shuffle(waiting)
    hand: list[int] = []
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        if len(hand) < 3:
            return
        a, b, c = hand
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(hand, u, strict=True):
            p[i] += step * v
            p[i] = 0.0 if p[i] < eps else 1.0 if p[i] > 1 - eps else p[i]
        hand = [i for i in hand if 0 < p[i] < 1]


def land(p: list[float], x: list[float]) -> list[float]:
    """Settle the last open documents (a handful): the choice whose words come nearest to what is expected of them."""
    open_ = [i for i, v in enumerate(p) if 0 < v < 1]
    want = sum(p[i] * x[i] for i in open_)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda c: (abs(sum(v * x[i] for v, i in zip(c, open_, strict=True)) - want), c))
    out = list(p)
    for i, v in zip(open_, best, strict=True):
        out[i] = v
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size (words, null text: 0), source, source_size, target, copies, taken
    (copies * size), row_hash (of the text).

    Sources are few and their totals go through the driver. Repeated rows are documents of their own. A source of size 0
    has target 0. Blocks and draws depend on ids, texts and the seed only, so reruns agree whatever the partitioning; rows
    that agree in id and text are interchangeable. Other columns take no part.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    each = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("row_hash"))
    # Rows that agree are numbered, so that their blocks differ and don't depend on the order of rows.
    again = each.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n"))
    sized = materialise(again.select("doc_id", "source", "size", "row_hash", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    goal = targets([(r.source, r["size"]) for r in totals], weights, most)
    plan = spark.createDataFrame(
        [(r.source, int(r["size"]), float(goal[r.source]), min(goal[r.source] / r["size"], float(most)) if r["size"] else 0.0, max(1, -(-r.n // block))) for r in totals],
        "source string, source_size long, target double, rate double, blocks int",
    )
    whole = F.floor(F.col("rate") + 1e-9)
    small = F.broadcast(plan) if len(totals) <= 10_000 else plan  # one row for each source; the same rows either way
    docs_of = sized.join(small, sized.source.eqNullSafe(plan.source)).select(
        "doc_id", sized.source, "size", "row_hash", "copy", "source_size", "target", whole.cast("long").alias("base"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), "blocks"
    )
    schema = docs_of.drop("blocks").schema

    def run(last: bool, level: int):
        def fly(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["row_hash", "doc_id", "size", "copy"], na_position="last", kind="stable").reset_index(drop=True)
            p, x = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
            start = zlib.crc32(repr((seed, level, pdf["source"].iloc[0], pdf["row_hash"].iloc[0], len(p))).encode())
            flight(p, x, start)
            pdf["p"] = land(p, x) if last else p
            return pdf[[f.name for f in schema]]

        return fly

    settled, level, most_blocks = [], 0, max((r.blocks for r in plan.collect()), default=1)
    todo = docs_of.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "row_hash", "copy"), F.col("blocks")).cast("int"))
    while True:
        last = most_blocks == 1
        flown = todo.groupBy("source", "block").applyInPandas(run(last, level), schema)
        if last:
            settled.append(flown)
            break
        flown = materialise(flown, f"mix-level{level}")
        settled.append(flown.filter("p <= 0 or p >= 1"))
        level, most_blocks = level + 1, max(1, -(-2 * most_blocks // block))
        todo = flown.filter("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "row_hash", "copy"), F.lit(most_blocks)).cast("int"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_hash")
