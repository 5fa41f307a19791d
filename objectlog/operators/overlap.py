"""Interval joins: lives of objects that overlap, events inside an object's open time.

An interval is at home in bins as wide as itself (widths grow by fours), so it lies in two of them at most, and visits
one or two bins of each coarser width in which intervals of the other side are at home. Two intervals that overlap meet
where the longer one is at home; of the bins they share there only the first keeps the pair. What meets in a bin is dealt
over lanes by counts, the larger side split, the smaller one repeated, so a life over the whole span fills no task, and
neither does a busy hour.

Where rows must agree in other columns too, only those values that many rows share need bins; of any other value each row
meets a few rows, and these meet where the value is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import ObjectLog
from .crowds import crowded, parted
from .traces import trace

#: Microseconds of the finest bins, and how much wider the next ones are.
UNIT, FACTOR = 1_000_000, 4
#: Rows of one side in a lane of a bin.
LANE = 100_000
#: Rows on the left with the same values in the columns that must agree, from which on they meet in bins.
SHARED = 64


def _binned(rows: DataFrame, levels: DataFrame | None) -> DataFrame:
    """The rows (on.., row, start, end, level) in their bins: at home, or at the coarser ones of ``levels`` as visitors."""
    if levels is None:
        rows = rows.withColumn("at", F.col("level"))
    else:
        rows = rows.crossJoin(F.broadcast(levels)).withColumn("at", F.explode(F.filter("levels", lambda x: x > F.col("level")))).drop("levels")  # one row
    width = (F.lit(UNIT) * F.pow(F.lit(float(FACTOR)), F.col("at"))).cast("long")
    rows = rows.withColumns({"first": F.floor(F.col("start") / width), "last": F.floor(F.col("end") / width)})
    return rows.withColumn("bin", F.explode(F.sequence("first", "last"))).drop("last", "level")


def _meet(homes: DataFrame, others: DataFrame, keys: list[str], lane: int) -> DataFrame:
    """Pairs (home, other) of rows of a bin that overlap, each in its first common bin."""
    both = [*keys, "at", "bin"]
    n = lambda df, c: df.groupBy(*both).agg(F.count("*").alias(c))
    sizes = n(homes, "n_home").join(n(others, "n_other"), both).withColumns({"lanes": F.ceil(F.greatest("n_home", "n_other") / lane).cast("int"), "split_home": F.col("n_home") > F.col("n_other")}).drop("n_home", "n_other")
    # Bins of one lane need no dealing; the rest are few, since each holds a lane's rows at least.
    crowded = sizes.filter("lanes > 1")

    def dealt(df: DataFrame, home: bool) -> DataFrame:
        own = F.col("split_home") if home else ~F.col("split_home")
        lanes = F.when(F.col("lanes").isNull(), F.array(F.lit(0))).when(own, F.array(F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("lanes") - 1))
        return df.join(crowded, both, "left").withColumn("lane", F.explode(lanes)).drop("lanes", "split_home")

    h, o = dealt(homes, True), dealt(others, False)
    rename = {"row": "row_o", "start": "start_o", "end": "end_o", "first": "first_o"}
    met = h.join(o.withColumnsRenamed(rename), [*both, "lane"])
    return met.filter((F.col("start") <= F.col("end_o")) & (F.col("start_o") <= F.col("end")) & (F.col("bin") == F.greatest("first", "first_o"))).select(F.col("row").alias("home"), F.col("row_o").alias("other"))


def overlapping(left: DataFrame, right: DataFrame, on: list[str] | None = None, start: str = "start", end: str = "end", lane: int = LANE) -> DataFrame:
    """a and b, rows of ``left`` and ``right`` as structs, whose closed intervals [start, end] of timestamps share an instant
    and that agree in the columns ``on``.

    A point is an interval from itself to itself. Rows without a start or an end, of which the end comes first, or with a null in
    ``on`` take no part. Repeated rows pair as often as they are there, no pair comes twice.
    """
    keys = [f"k{i}" for i in range(len(on or []))]

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col(start) <= F.col(end)).select(*[F.col(c).alias(k) for c, k in zip(on or [], keys, strict=True)], F.struct("*").alias("row"), F.unix_micros(F.col(start).cast("timestamp")).alias("start"), F.unix_micros(F.col(end).cast("timestamp")).alias("end"))
        length = F.greatest(F.col("end") - F.col("start"), F.lit(1)) / UNIT
        return rows.withColumn("level", F.greatest(F.ceil(F.log(float(FACTOR), length)), F.lit(0)).cast("int"))

    a, b = prepared(left), prepared(right)
    if not keys:
        return _in_bins(a, b, keys, lane)
    few, busy = parted(a.groupBy(*keys).agg(F.count("*").alias("n")), keys, crowded(b, keys))
    many = few.filter(F.col("n") > SHARED).unionByName(busy).select(*keys)
    rename = {"row": "b", "start": "start_b", "end": "end_b"}
    met = a.drop("level").join(many, keys, "left_anti").join(b.drop("level").withColumnsRenamed(rename), keys)
    plain = met.filter((F.col("start") <= F.col("end_b")) & (F.col("start_b") <= F.col("end"))).select(F.col("row").alias("a"), "b")
    return plain.unionByName(_in_bins(a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi"), keys, lane))


def _in_bins(a: DataFrame, b: DataFrame, keys: list[str], lane: int) -> DataFrame:
    levels = lambda df: df.agg(F.collect_set("level").alias("levels"))  # noqa: E731  one for each power of FACTOR at most
    first = _meet(_binned(a, None), _binned(b, None).unionByName(_binned(b, levels(a))), keys, lane).select(F.col("home").alias("a"), F.col("other").alias("b"))
    second = _meet(_binned(b, None), _binned(a, levels(b)), keys, lane).select(F.col("other").alias("a"), F.col("home").alias("b"))
    return first.unionByName(second)


def lives(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """otype, oid, start, end: from the first to the last timed event of each object."""
    return trace(log, object_type).filter("ts is not null").groupBy("otype", "oid").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def overlapping_lives(log: ObjectLog, type1: str, type2: str) -> DataFrame:
    """oid1, oid2, seconds: objects of two types (or of one, each pair once) whose lives overlap, and for how long."""
    found = overlapping(lives(log, type1), lives(log, type2))
    if type1 == type2:
        found = found.filter(F.col("a.oid") < F.col("b.oid"))
    return found.select(F.col("a.oid").alias("oid1"), F.col("b.oid").alias("oid2"), seconds_between(F.greatest("a.start", "b.start"), F.least("a.end", "b.end")).alias("seconds"))


def events_during(log: ObjectLog, object_type: str, events: DataFrame | None = None) -> DataFrame:
    """oid, eid, activity: events (of the log, or others with eid, activity, ts) that fall into the life of an object of the type
    without being events of that object."""
    points = (log.events if events is None else events).filter("ts is not null").select("eid", "activity", F.col("ts").alias("start"), F.col("ts").alias("end"))
    found = overlapping(lives(log, object_type), points).select(F.col("a.oid").alias("oid"), F.col("b.eid").alias("eid"), F.col("b.activity").alias("activity"))
    return found.join(log.e2o.filter(F.col("otype") == object_type).select("oid", "eid"), ["oid", "eid"], "left_anti")


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6
