"""Traces: the time-ordered events of each object, and what follows from consecutive pairs.

An object that touches most events would make one window partition of nearly the whole log. Windows of objects with very many
events therefore run within spans of time, and the few rows at the spans' edges are stitched by a second, small window.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import ObjectLog
from ..sources.staging import staged
from .crowds import crowded, dealt, parted, repeated

#: Seconds in a span.
SPAN = 30 * 86_400
_KEY = ("otype", "oid")


def _of_type(log: ObjectLog, object_type: str | None) -> DataFrame:
    return log.e2o if object_type is None else log.e2o.filter(F.col("otype") == object_type)


def relations(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """otype, oid, eid, each once, and ``only``: whether the event has no other object of the type. Dealt by event, as the
    join with events needs them, so that they are shuffled once."""
    of_event = Window.partitionBy("eid").orderBy(*_KEY)
    rows = _of_type(log, object_type).select(*_KEY, "eid").filter("eid is not null")
    rows = rows.withColumn("again", F.lag(F.struct(*_KEY)).over(of_event).eqNullSafe(F.struct(*_KEY))).filter("not again").drop("again")
    same = lambda other: other(F.struct("otype")).over(of_event).eqNullSafe(F.struct("otype"))
    return rows.withColumn("only", ~(same(F.lag) | same(F.lead)))


def trace(log: ObjectLog, object_type: str | None = None, extra: dict[str, Column] | None = None, alone: bool = False) -> DataFrame:
    """otype, oid, eid, activity, ts (and extra columns of events): an event once for each of its objects. Events without
    a time come first. With ``alone`` whether no other row has the event and the type. Where the log has events beside their
    relations, only ids that are there more than once are joined."""
    columns = ["eid", "activity", "ts", *[c.alias(n) for n, c in (extra or {}).items()]]
    if log.rows is None:
        return _joined(log.events.select(*columns), relations(log, object_type), alone)
    rows = log.rows.select(*columns, F.col("rels") if object_type is None else F.filter("rels", lambda r: r["otype"] == object_type).alias("rels"))
    rows = rows.filter("eid is not null").withColumn("_hash", F.xxhash64("eid"))
    again = staged(repeated(log.rows, "eid"), "repeated")
    # Rows of an id that others have too are joined; the objects of all others are beside them.
    joined = rows.join(again, "_hash", "left_semi").drop("_hash")
    said = joined.select("eid", F.explode("rels").alias("r")).select("eid", "r.*")
    joined = _joined(joined.drop("rels"), relations(replace(log, e2o=said)), alone)
    its = F.array_distinct(F.transform("rels", lambda r: F.struct(r["otype"], r["oid"])))
    same = lambda r: F.size(F.filter(its, lambda q: q["otype"].eqNullSafe(r["otype"]))) == 1
    told = F.transform(its, lambda r: F.struct(r["otype"], r["oid"], same(r).alias("alone")))
    apart = F.transform("rels", lambda r: F.struct(r["otype"], r["oid"], F.lit(True).alias("alone")))
    rows = rows.join(again, "_hash", "left_anti").withColumn("r", F.explode(F.when(F.size(F.array_distinct("rels.otype")) == F.size("rels"), apart).otherwise(told)))
    return rows.select(*[f"r.{c}" if c in (*_KEY, "alone") else c for c in joined.columns]).unionByName(joined)


def _joined(events: DataFrame, rel: DataFrame, alone: bool) -> DataFrame:
    if not alone:
        return rel.drop("only").join(events, "eid")
    events = events.withColumn("once", F.count("*").over(Window.partitionBy("eid")) == 1)
    return rel.join(events, "eid").withColumn("alone", F.col("only") & F.col("once")).drop("only", "once")


def _spans(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("span", F.coalesce(F.floor(F.unix_seconds("ts") / span), F.lit(-(1 << 62))))


def pairs(log: ObjectLog, object_type: str | None = None, extra: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """otype, oid, e1, src, t1, e2, tgt, t2 (and extra columns as x1, x2): consecutive events of each object, in the order
    of time, then event id."""
    return paired(trace(log, object_type, extra), list(extra or {}), span, crowded(_of_type(log, object_type), list(_KEY)))


def paired(rows: DataFrame, extra: list[str] | None = None, span: int = SPAN, crowd: DataFrame | None = None) -> DataFrame:
    """`pairs` of rows that `trace` has made, or others like them. ``crowd``: slots of objects whose windows run in spans."""
    carried = ["eid", "activity", "ts", *(extra or [])]
    few, many = parted(rows, list(_KEY), crowded(rows, list(_KEY)) if crowd is None else crowd)
    it = F.struct(*carried)
    whole = dealt(few, *_KEY).select(*_KEY, it.alias("a"), F.lead(it).over(Window.partitionBy(*_KEY).orderBy("ts", "eid")).alias("b")).filter("b is not null")
    both = whole.unionByName(_paired_in_spans(_spans(many, span), it))
    names = {"eid": ("e1", "e2"), "activity": ("src", "tgt"), "ts": ("t1", "t2")}
    return both.select(*_KEY, *[F.col(f"{side}.{c}").alias(names.get(c, (f"{c}1", f"{c}2"))[i]) for i, side in enumerate("ab") for c in carried])


def _paired_in_spans(rows: DataFrame, it: Column) -> DataFrame:
    within = Window.partitionBy(*_KEY, "span").orderBy("ts", "eid")
    led = dealt(rows, *_KEY, "span").select(*_KEY, "span", it.alias("a"), F.lead(it).over(within).alias("b"), F.row_number().over(within).alias("k"))
    # The last event of a span is followed by the first one of the next, and of those there are two a span at most.
    ends = led.filter("k = 1 or b is null").withColumn("next", F.lead("a").over(Window.partitionBy(*_KEY).orderBy("a.ts", "a.eid")))
    stitched = ends.filter("b is null and next is not null").select(*_KEY, "a", F.col("next").alias("b"))
    return led.filter("b is not null").select(*_KEY, "a", "b").unionByName(stitched)


def positions(log: ObjectLog, object_type: str | None = None, span: int = SPAN) -> DataFrame:
    """otype, oid, eid, activity, ts, pos: the place (from 0) of each event in its object's trace."""
    rows = _spans(trace(log, object_type), span)
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy(*_KEY, "span").orderBy("ts", "eid")) - 1)
    before = Window.partitionBy(*_KEY).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*_KEY, "span").agg(F.count("*").alias("n")).select(*_KEY, "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, [*_KEY, "span"]).select(*_KEY, "eid", "activity", "ts", (F.col("k") + F.col("offset")).alias("pos"))


def _pair_counts(log: ObjectLog, object_type: str | None, by: list[str]) -> DataFrame:
    """by.., frequency: distinct pairs of events of each object type. Two objects can only have the same pair if they share both
    events, so all other pairs are counted where they are."""
    rows = trace(log, object_type, alone=True)
    single = _single(rows) if log.rows is not None else []
    found = paired(rows.filter(F.col("otype").isNull() | ~F.col("otype").isin(single)) if single else rows, ["alone"], crowd=crowded(_of_type(log, object_type), list(_KEY)))
    shared = ~(F.col("alone1") | F.col("alone2"))
    n = found.groupBy("otype", "src", "tgt", F.when(shared, F.struct("e1", "e2")).alias("pair")).agg(F.count("*").alias("n"))
    if single:
        # Whatever their order, each event but the last is followed by one of the same activity.
        objects = rows.filter(F.col("otype").isin(single)).groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("activity").alias("src"))
        edges = objects.filter("n > 1").groupBy("otype", "src").agg(F.sum(F.col("n") - 1).alias("n"))
        n = n.unionByName(edges.withColumn("tgt", F.col("src")), allowMissingColumns=True)
    return n.groupBy(*by).agg(F.sum(F.when(F.col("pair").isNull(), F.col("n")).otherwise(F.lit(1))).alias("frequency"))


def _single(rows: DataFrame) -> list[str]:
    """The object types whose events all have one activity and no other object of the type."""
    one = (F.count("activity") == F.count("*")) & (F.min("activity") == F.max("activity")) & F.every("alone")
    return [r.otype for r in rows.filter("otype is not null").groupBy("otype").agg(one.alias("one")).filter("one").collect()]


def dfg(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """src, tgt, frequency: distinct pairs of events for each object type, summed over types."""
    return _pair_counts(log, object_type, ["src", "tgt"])


def dfg_by_type(log: ObjectLog) -> DataFrame:
    """otype, src, tgt, frequency: distinct pairs of events."""
    return _pair_counts(log, None, ["otype", "src", "tgt"])


def _edge(log: ObjectLog, object_type: str | None, first: bool) -> DataFrame:
    best = (F.min if first else F.max)(F.struct("ts", "eid", "activity"))
    ends = trace(log, object_type).groupBy(*_KEY).agg(best.alias("e")).select("otype", "e.activity", "e.eid").distinct()
    return ends.groupBy("activity").agg(F.count("*").alias("frequency"))


def start_activities(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """activity, frequency: distinct first events for each object type, summed over types."""
    return _edge(log, object_type, True)


def end_activities(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """activity, frequency: distinct last events for each object type, summed over types."""
    return _edge(log, object_type, False)


def variant_arrays(log: ObjectLog, object_type: str | None = None, limit: int | None = None) -> DataFrame:
    """sequence (an array of activities), length, frequency, otypes: equal traces, counted over all types; with ``limit`` those as
    frequent as the limit-th one.

    Traces are told apart by their length and two sums of hashes of (place, activity), which aggregate like any sum; only
    one trace of each variant that is asked for is put together as an array.
    """
    placed = positions(log, object_type)
    marks = placed.groupBy(*_KEY).agg(F.count("*").alias("length"), *[F.sum(F.xxhash64(F.lit(s), "pos", "activity").cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)])
    found = marks.groupBy("length", "h1", "h2").agg(F.count("*").alias("frequency"), F.sort_array(F.collect_set("otype")).alias("otypes"), F.min(F.struct(*_KEY)).alias("one"))
    if limit:
        # Ties are told apart by their sequences, so all variants as frequent as the limit-th one are put together.
        least = found.select("frequency").orderBy(F.desc("frequency")).limit(limit).agg(F.min("frequency").alias("least"))
        found = found.join(F.broadcast(least), F.col("frequency") >= F.col("least")).drop("least")  # one row
    chosen = found.select(F.col("one.otype").alias("otype"), F.col("one.oid").alias("oid"), "length", "frequency", "otypes")
    sequence = F.transform(F.sort_array(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"])
    return placed.join(chosen, list(_KEY)).groupBy(*_KEY, "length", "frequency", "otypes").agg(sequence.alias("sequence")).select("sequence", "length", "frequency", "otypes")


def variants(log: ObjectLog, object_type: str | None = None, limit: int | None = None) -> DataFrame:
    """variant_id, sequence, length, frequency, otypes: `variant_arrays` as text, most frequent first."""
    top = variant_arrays(log, object_type, limit).select(F.array_join("sequence", " → ", "null").alias("sequence"), "length", "frequency", "otypes").orderBy(F.desc("frequency"), "sequence")
    if not limit:
        return top
    return top.limit(limit).withColumn("variant_id", F.row_number().over(Window.orderBy(F.desc("frequency"), "sequence")))  # `limit` rows


def performance(log: ObjectLog, object_type: str | None = None) -> DataFrame:
    """src, tgt, count, and mean, min, max, median, population deviation of the seconds between, rounded to 2. Pairs are
    not made distinct: every object counts."""
    us = F.unix_micros("t2") - F.unix_micros("t1")
    timed = staged(pairs(log, object_type).filter("t1 is not null and t2 is not null").select("src", "tgt", us.alias("us")), "durations")
    rounded = lambda c: F.round(c / 1e6, 2)
    found = timed.groupBy("src", "tgt").agg(
        F.count("*").alias("count"), rounded(F.sum("us") / F.count("*")).alias("mean_s"), rounded(F.min("us")).alias("min_s"), rounded(F.max("us")).alias("max_s"), rounded(F.stddev_pop("us")).alias("std_s"),
        F.percentile_approx("us", [0.499, 0.501], 10_000).alias("about"),
    )
    return found.join(medians(timed, found), ["src", "tgt"]).select("src", "tgt", "count", "mean_s", "min_s", "max_s", rounded(F.col("median")).alias("median_s"), "std_s")


def medians(timed: DataFrame, found: DataFrame) -> DataFrame:
    """src, tgt, median of ``us``, exact: ``about`` of ``found`` are values that stand a thousandth of the rows around it, off
    by a tenth of that at most. So only values between them are told apart, and those before them counted; no task holds
    all durations of an edge."""
    edges = found.select("src", "tgt", F.col("count").alias("n"), F.col("about")[0].alias("low"), F.col("about")[1].alias("high"))
    same = F.col("src").eqNullSafe(F.col("src_")) & F.col("tgt").eqNullSafe(F.col("tgt_"))
    near = timed.join(edges.withColumnsRenamed({"src": "src_", "tgt": "tgt_"}), same).filter("us <= high")
    near = near.groupBy("src", "tgt", "n", F.when(F.col("us") >= F.col("low"), F.col("us")).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("src", "tgt").orderBy(F.asc_nulls_first("value")))
    near = near.withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("value")))
    return near.groupBy("src", "tgt").agg(((at(F.expr("(n + 1) div 2")) + at(F.expr("n div 2 + 1"))) / 2).alias("median"))


def bottlenecks(log: ObjectLog, object_type: str | None = None, percentile: float = 75) -> DataFrame:
    """src, tgt, count, mean_s, threshold_s, severity: transitions whose mean reaches the percentile of all means."""
    perf = performance(log, object_type).select("src", "tgt", "count", "mean_s")
    cut = perf.agg(F.percentile("mean_s", percentile / 100).alias("threshold_s"))
    severity = F.when(F.col("mean_s") > 1.5 * F.col("threshold_s"), "high").otherwise("medium")
    return perf.join(F.broadcast(cut), F.col("mean_s") >= F.col("threshold_s")).withColumn("severity", severity).orderBy(F.desc("mean_s"), "src", "tgt")  # one row


def deviations(log: ObjectLog, model: DataFrame | None = None, object_type: str | None = None) -> DataFrame:
    """otype, oid, pos, src, tgt: the first pair of each trace that the model's edges (src, tgt) don't have."""
    model = dfg(log, object_type) if model is None else model
    bad = pairs(log, object_type).join(model.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")
    first = bad.groupBy(*_KEY).agg(F.min(F.struct("t1", "e1", "src", "tgt")).alias("f")).select(*_KEY, "f.e1", "f.src", "f.tgt")
    place = positions(log, object_type).join(first.select(*_KEY, F.col("e1").alias("eid")), [*_KEY, "eid"]).select(*_KEY, "pos")
    return first.join(place, list(_KEY)).select(*_KEY, "pos", "src", "tgt")


def conformance(log: ObjectLog, model: DataFrame | None = None, object_type: str | None = None) -> DataFrame:
    """One row: traces, conformant, fitness (rounded to 4; 0 without traces). Every trace counts, none is sampled."""
    model = dfg(log, object_type) if model is None else model
    bad = pairs(log, object_type).join(model.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti").select(*_KEY).distinct().agg(F.count("*").alias("bad"))
    all_ = trace(log, object_type).select(*_KEY).distinct().agg(F.count("*").alias("traces"))
    good = F.col("traces") - F.col("bad")
    return all_.crossJoin(bad).select("traces", good.alias("conformant"), F.when(F.col("traces") > 0, F.round(good / F.col("traces"), 4)).otherwise(0.0).alias("fitness"))  # one row each


def interactions(log: ObjectLog) -> DataFrame:
    """type1, type2 (type1 <= type2), count: pairs of objects that share an event; of one type n(n+1)/2, self pairs
    included, of two types n1 * n2. Counted from the numbers of objects per event and type, never from pairs."""
    n = log.e2o.groupBy("eid", "otype").agg(F.countDistinct("oid").alias("n"))
    both = n.select("eid", F.col("otype").alias("type1"), F.col("n").alias("n1")).join(n.select("eid", F.col("otype").alias("type2"), F.col("n").alias("n2")), "eid").filter("type1 <= type2")
    k = F.when(F.col("type1") == F.col("type2"), F.expr("n1 * (n1 + 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
    return both.groupBy("type1", "type2").agg(F.sum(k).alias("count"))


def top_interactions(log: ObjectLog, limit: int = 10) -> DataFrame:
    """The most frequent pairs of types."""
    return interactions(log).orderBy(F.desc("count"), "type1", "type2").limit(limit)


#: Parts of an attribute's name that mark it as a resource.
RESOURCE_WORDS = ("resource", "user", "actor", "agent", "org", "role", "worker", "employee")


def resource_attributes(log: ObjectLog, low: float = 0.01, high: float = 0.3) -> DataFrame:
    """attribute, distinct_values, rows: event attributes named like a resource, or with a share of distinct values between
    the bounds."""
    total = log.events.agg(F.count("*").alias("rows"))
    values = log.events.select(F.explode("attrs").alias("attribute", "value")).filter("value is not null")
    n = values.groupBy("attribute").agg(F.countDistinct("value").alias("distinct_values")).crossJoin(total)  # one row
    share = F.col("distinct_values") / F.col("rows")
    return n.filter(F.lower("attribute").rlike("|".join(RESOURCE_WORDS)) | ((share > low) & (share < high))).select("attribute", "distinct_values", "rows")


def handovers(log: ObjectLog, resource: Column | str, limit: int | None = None) -> DataFrame:
    """src, tgt, weight: how often consecutive events of an object go from one non-empty resource to another one.
    ``resource`` is an event attribute or an expression over events."""
    who = F.col("attrs")[resource] if isinstance(resource, str) else resource
    out = pairs(log, None, {"who": who}).filter("who1 <> '' and who2 <> '' and who1 <> who2").groupBy(F.col("who1").alias("src"), F.col("who2").alias("tgt")).agg(F.count("*").alias("weight"))
    return out.orderBy(F.desc("weight"), "src", "tgt").limit(limit) if limit else out
