"""Values of attributes at the time of events, and work in moving frames and visits: windows over an object's time, which run in
spans so that an object with most of the events is shared among tasks.

What a span needs of the ones before it is small: the last value (as-of join), the rows of one frame's length (range frames),
or its first and last visit (sessions).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import ObjectLog
from ..sources.staging import staged
from .crowds import crowded, dealt, slot
from .traces import relations

#: Seconds in a span.
SPAN = 30 * 86_400


def _span(ts: str, span: float) -> Column:
    return F.floor(F.unix_micros(ts) / int(span * 1e6))


def as_of(events: DataFrame, changes: DataFrame, keys: list[str], values: list[str], order: list[str] | None = None, span: float = SPAN) -> DataFrame:
    """All columns of ``events`` and, for each of ``values``, what ``changes`` last set it to for the same ``keys`` at or before
    the event's ``ts`` (null: never, and for events without a time).

    Of changes at one instant the last by the columns ``order`` holds. A null is no value: it leaves the one before. Changes without a
    time hold from the start. Null keys agree with each other; repeated events keep their rows.
    """
    order = order or []
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    vals, ords = [f"v{i}" for i in range(len(values))], [f"o{i}" for i in range(len(order))]
    start = F.lit(-(1 << 62))
    nothing = lambda df, cols, as_: [F.lit(None).cast(df.schema[c].dataType).alias(n) for c, n in zip(cols, as_, strict=True)]
    rows = events.select(*key, "ts", F.lit(1).alias("kind"), *nothing(changes, order, ords), *nothing(changes, values, vals), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("row"))
    sets = changes.select(*key, "ts", F.lit(0).alias("kind"), *[F.col(c).alias(o) for c, o in zip(order, ords, strict=True)], *[F.col(c).alias(v) for c, v in zip(values, vals, strict=True)])
    sets = sets.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType))
    # Keys with few rows run whole, those in crowded slots in spans; so every row is shuffled once.
    crowd = crowded(events.select(*key).unionByName(changes.select(*key)), names).withColumn("crowd", F.lit(True))
    marked = lambda df: df.withColumn("_slot", slot(names)).join(F.broadcast(crowd), "_slot", "left").drop("_slot")  # noqa: E731  SLOTS rows at most
    both = marked(rows.filter("ts is not null").unionByName(sets)).withColumn("span", F.when(F.col("crowd"), F.coalesce(_span("ts", span), start)).otherwise(start)).drop("crowd")
    # The last value of each span, carried to the next spans of a crowded slot that have rows: one row for each span of an object.
    when = F.struct("ts", *ords)
    in_spans = lambda df: marked(df).filter("crowd").withColumn("span", F.coalesce(_span("ts", span), start))
    ends = in_spans(sets).groupBy(*names, "span").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), when)).alias(v) for v in vals])
    marks = in_spans(rows.filter("ts is not null").select(*names, "ts").unionByName(sets.select(*names, "ts"))).select(*names, "span").distinct()
    marks = marks.join(ends.withColumnsRenamed({n: f"_{n}" for n in [*names, "span"]}), [*[F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.col("span") == F.col("_span")], "left")
    before = Window.partitionBy(*names).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*names, "span", F.lit(-1).alias("kind"), *[F.last(v, ignorenulls=True).over(before).alias(v) for v in vals])
    within = Window.partitionBy(*names, "span").orderBy(F.asc_nulls_first("ts"), "kind", *ords).rowsBetween(Window.unboundedPreceding, 0)
    every = dealt(both.unionByName(carried, allowMissingColumns=True), *names, "span")
    out = every.withColumns({v: F.last(v, ignorenulls=True).over(within) for v in vals}).filter("kind = 1").select("row", *vals)
    untimed = rows.filter("ts is null").select("row", *vals)
    kept = [c for c in events.columns if c not in values]
    return out.unionByName(untimed).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[F.col(v).alias(c) for c, v in zip(values, vals, strict=True)])


def values_at_events(log: ObjectLog, attribute: str, object_type: str | None = None, span: float = SPAN) -> DataFrame:
    """eid, otype, oid, ts, value: what the attribute of each event's objects was at the event. An attribute that no change has
    set by then has a null value; of changes at one instant the last by name of the changed field holds."""
    rel = log.e2o if object_type is None else log.e2o.filter(F.col("otype") == object_type)
    of_event = relations(replace(log, e2o=dealt(rel, "eid", beside=(log.events,)))).drop("only")
    events = staged(of_event.join(log.events.select("eid", "ts"), "eid").select("eid", "otype", "oid", "ts"), "objects-at-events")  # it is read for crowds too
    changes = log.changes.select("otype", "oid", "ts", F.coalesce("changed_field", F.lit("")).alias("changed_field"), F.col("attrs")[attribute].alias("value"))
    return as_of(events, changes, ["otype", "oid"], ["value"], ["changed_field"], span).select("eid", "otype", "oid", "ts", "value")


def in_frame(rows: DataFrame, keys: list[str], seconds: float, aggregates: dict[str, Column], span: float = SPAN) -> DataFrame:
    """All columns of ``rows`` and each aggregate over the rows of the same ``keys`` whose ``ts`` lies in [ts - seconds, ts].

    Spans hold their own rows and a halo: those of the frame's length before them, which are left out again. Rows that share an
    instant see each other. Rows without a time see the ones without a time. Null keys agree.
    """
    span = max(span, seconds)  # so that a row is in the halo of one span at most
    us, frame = F.unix_micros("ts"), int(seconds * 1e6)
    own = F.coalesce(_span("ts", span), F.lit(-(1 << 62)))
    reach = F.coalesce(F.floor((us + frame) / int(span * 1e6)), own)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "*")
    spread = packed.withColumns({"_us": us, "_own": own, "_span": F.explode(F.array_distinct(F.array(own, reach)))})
    over = Window.partitionBy(*keys, "_span").orderBy("_us").rangeBetween(-frame, 0)
    found = spread.select("_row", "_own", "_span", *[c.over(over).alias(n) for n, c in aggregates.items()])
    return found.filter("_own = _span").select("_row.*", *aggregates)


def recent_work(log: ObjectLog, resource: Column | str, seconds: float = 86_400, span: float = SPAN) -> DataFrame:
    """eid, resource, ts, recent: how many events (itself included) the event's resource had in the time before it.
    ``resource`` is an event attribute or an expression over events; events without one take no part."""
    who = F.col("attrs")[resource] if isinstance(resource, str) else resource
    rows = log.events.select("eid", who.alias("resource"), "ts").filter("resource is not null and ts is not null")
    return in_frame(rows, ["resource"], seconds, {"recent": F.count("*")}, span)


def visits(rows: DataFrame, keys: list[str], gap: float, span: float = SPAN) -> DataFrame:
    """keys, start, end, n: runs of rows of the same ``keys`` whose times lie ``gap`` seconds apart at most (as Spark's
    session windows of that gap). Rows without a time take no part; null keys agree.

    A span is cut into visits by itself; only its first and last visit can go on in other spans, and these few are joined
    by a second window.
    """
    pause = int(gap * 1e6)
    timed = rows.filter("ts is not null").select(*keys, F.unix_micros("ts").alias("_us"), _span("ts", span).alias("_span"))
    within = Window.partitionBy(*keys, "_span").orderBy("_us")
    opened = timed.withColumn("_new", (F.col("_us") - F.lag("_us").over(within) > pause).cast("int"))
    numbered = opened.withColumn("_k", F.sum(F.coalesce("_new", F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*keys, "_span", "_k").agg(F.min("_us").alias("_start"), F.max("_us").alias("_end"), F.count("*").alias("n"))
    pieces = pieces.withColumn("_edge", (F.col("_k") == 0) | (F.col("_k") == F.max("_k").over(Window.partitionBy(*keys, "_span"))))
    across = Window.partitionBy(*keys).orderBy("_start")
    edges = pieces.filter("_edge").withColumn("_new", (F.col("_start") - F.lag("_end").over(across) > pause).cast("int"))
    edges = edges.withColumn("_visit", F.sum(F.coalesce("_new", F.lit(0))).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_visit").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("n").alias("n")).drop("_visit")
    return joined.unionByName(pieces.filter("not _edge").select(*keys, "_start", "_end", "n")).select(*keys, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "n")


def object_visits(log: ObjectLog, gap: float, object_type: str | None = None, span: float = SPAN) -> DataFrame:
    """otype, oid, start, end, n: the visits of each object, by the times of its events."""
    rel = log.e2o if object_type is None else log.e2o.filter(F.col("otype") == object_type)
    rows = rel.select("otype", "oid", "eid").distinct().join(log.events.select("eid", "ts"), "eid")
    return visits(rows, ["otype", "oid"], gap, span)


def visits_stream(events: DataFrame, keys: list[str], gap: str, watermark: str) -> DataFrame:
    """The same over a stream of rows with ``ts``: a visit is given once the watermark has passed its end; later rows are left out."""
    windows = events.withWatermark("ts", watermark).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return windows.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("w")
