"""Filters over events, and the nested event references that they answer with."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import ObjectLog


class UnknownValue(ValueError):
    """An activity, type or object that the log doesn't have."""


def _known(df: DataFrame, column: str, value: str, what: str) -> None:
    if not df.filter(F.col(column) == value).limit(1).count():
        some = [r[0] for r in df.select(column).distinct().orderBy(column).limit(50).collect()]
        raise UnknownValue(f"no {what} {value!r}; there are {', '.join(map(str, some))}")


def moment(value: str | datetime) -> Column:
    """A bound as a timestamp; without an offset it is UTC. Raises ValueError if it isn't ISO 8601."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(at.timestamp()) * 1_000_000 + at.microsecond))


def by_activity(log: ObjectLog, activity: str, strict: bool = False) -> DataFrame:
    """Events of an activity, case-sensitive; ``strict`` raises if no event has it."""
    if strict:
        _known(log.events, "activity", activity, "activity")
    return log.events.filter(F.col("activity") == activity)


def by_object_type(log: ObjectLog, otype: str, strict: bool = False) -> DataFrame:
    """Events with at least one object of the type."""
    if strict:
        _known(log.objects, "otype", otype, "object type")
    return log.events.join(log.e2o.filter(F.col("otype") == otype).select("eid"), "eid", "left_semi")


def between(log: ObjectLog, start: str | datetime, end: str | datetime) -> DataFrame:
    """Events from start to end, both included; events without a time are left out."""
    return log.events.filter(F.col("ts").between(moment(start), moment(end)))


def lifecycle(log: ObjectLog, oid: str, strict: bool = False) -> DataFrame:
    """Events of one object in the order of time, then event id."""
    if strict:
        _known(log.objects, "oid", oid, "object")
    return log.events.join(log.e2o.filter(F.col("oid") == oid).select("eid"), "eid", "left_semi").orderBy("ts", "eid")


def timestamp_text(ts: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS[.ffffff]+00:00`, the text that goes into hashes."""
    base = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.when(F.unix_micros(ts) % 1_000_000 == 0, base).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def references(log: ObjectLog, events: DataFrame | None = None) -> DataFrame:
    """event_id, activity, timestamp, involved_objects (object_id, object_type, role; sorted), hash (SHA-256 of
    `eid:time:sorted object ids`); for all events of the log or those given."""
    events = log.events if events is None else events
    involved = F.sort_array(F.collect_list(F.struct(F.col("oid").alias("object_id"), F.col("otype").alias("object_type"), F.col("qualifier").alias("role"))))
    nested = log.e2o.join(events.select("eid"), "eid", "left_semi").groupBy("eid").agg(involved.alias("involved_objects"))
    out = events.join(nested, "eid", "left")
    objects = F.coalesce("involved_objects", F.array().cast("array<struct<object_id:string,object_type:string,role:string>>"))
    ids = F.array_join(F.array_sort(F.transform(objects, lambda o: o["object_id"])), ",")
    return out.select(
        F.col("eid").alias("event_id"), "activity", F.col("ts").alias("timestamp"), objects.alias("involved_objects"), F.sha2(F.concat_ws(":", F.col("eid"), timestamp_text(F.col("ts")), ids), 256).alias("hash")
    )


def refs_with_type(refs: DataFrame, otype: str) -> DataFrame:
    """Rows of references with an involved object of the type."""
    return refs.filter(F.exists("involved_objects", lambda o: o["object_type"] == otype))


def refs_with_object(refs: DataFrame, oid: str) -> DataFrame:
    """Rows of references that involve the object."""
    return refs.filter(F.exists("involved_objects", lambda o: o["object_id"] == oid))


def value_as_of(log: ObjectLog, attribute: str, at: str | datetime) -> DataFrame:
    """oid, value: what each object's attribute was at a time, by the latest change at or before it that sets it."""
    set_ = log.changes.filter((F.col("ts") <= moment(at)) & F.col("attrs")[attribute].isNotNull())
    return set_.groupBy("oid").agg(F.max_by(F.col("attrs")[attribute], F.struct("ts", F.coalesce("changed_field", F.lit("")))).alias("value"))
