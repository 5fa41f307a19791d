"""A stored cube of a log: counts, distinct objects and quantiles by activity, object type and day, in sketches that merge.

The cells are made once from the events and stored by day; every coarser grouping (of some of the dimensions, of a week, of
all) is read from cells alone. Counts are exact; distinct objects (HyperLogLog) and quantiles (KLL) are estimates of known
error, whose size does not depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import ObjectLog
from .traces import trace

DIMENSIONS = ("activity", "otype", "day")
#: Bits of the HyperLogLog sketches (relative standard error 1.04 / sqrt(2 ** bits) at most), and k of the KLL ones (error of a rank about
#: 1.33 % at 200, falling as 1 / k).
BITS, K = 12, 400


def cells(log: ObjectLog, measure: Column | None = None) -> DataFrame:
    """activity, otype, day, n (an event counts once for each object), objects and spread (sketches of the objects' ids and of
    ``measure``, a number over the event's ts and attrs; the seconds of the day if none is given)."""
    measure = F.expr("hour(ts) * 3600 + minute(ts) * 60 + second(ts)") if measure is None else measure
    rows = trace(log, extra={"measure": measure.cast("double")})
    return rows.groupBy("activity", "otype", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.concat_ws("\x1f", "otype", "oid"), BITS).alias("objects"), F.kll_sketch_agg_double("measure", K).alias("spread")
    )


def store(found: DataFrame, path: str) -> None:
    """The cells under ``path``, a folder for each day, added to what is there: cells of one group merge when they are read."""
    found.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells."""
    return spark.read.parquet(path)


def grouped(found: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, every: bool = True, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The dimensions, level, n, objects (estimated) and quantiles of the measure, merged from cells.

    With ``every`` for all groupings of the dimensions (as CUBE), of which ``level`` tells which are summed over (a bit for each, the last
    dimension's the lowest); otherwise for the finest one. Filter the cells first for a range of days."""
    found = found.select(*[c for c in DIMENSIONS if c in dimensions], "n", "objects", "spread")
    groups = found.cube(*dimensions) if every else found.groupBy(*dimensions)
    level = F.grouping_id() if every else F.lit(0)
    merged = groups.agg(level.cast("long").alias("level"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("objects")).alias("objects"), F.kll_merge_agg_double("spread").alias("spread"))
    return merged.select(*dimensions, "level", "n", "objects", *[F.kll_sketch_get_quantile_double("spread", F.lit(q)).alias(f"q{q:g}".replace(".", "_")) for q in quantiles])
