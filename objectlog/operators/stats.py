"""Counts, summaries and structural anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import ObjectLog


def by_object_type(log: ObjectLog) -> DataFrame:
    """otype, count."""
    return log.objects.groupBy("otype").agg(F.count("*").alias("count"))


def objects_by_type(log: ObjectLog) -> DataFrame:
    """otype, oid in order: the members behind ``by_object_type``, as rows so that no group is ever one value."""
    return log.objects.select("otype", "oid").orderBy("otype", "oid")


def statistics(log: ObjectLog) -> DataFrame:
    """One row: events, objects, relations, activities, object_types."""
    e = log.events.agg(F.count("*").alias("events"), F.countDistinct("activity").alias("activities"))
    o = log.objects.agg(F.count("*").alias("objects"), F.countDistinct("otype").alias("object_types"))
    r = log.e2o.agg(F.count("*").alias("relations"))
    return e.crossJoin(o).crossJoin(r)  # one row each


def info(log: ObjectLog) -> DataFrame:
    """One row: events, objects, first and last time, activities and object types (sorted names)."""
    e = log.events.agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_set("activity")).alias("activities"))
    o = log.objects.agg(F.count("*").alias("objects"), F.sort_array(F.collect_set("otype")).alias("object_types"))
    return e.crossJoin(o)  # one row each


def activity_frequency(log: ObjectLog, limit: int | None = 10, samples: int = 3) -> DataFrame:
    """activity, count, sample_ids (the smallest event ids); most frequent first.

    The ids are found within each activity's salted share first, so no activity is ever sorted by one task.
    """
    salted = Window.partitionBy("activity", F.pmod(F.xxhash64("eid"), F.lit(64))).orderBy("eid")
    few = log.events.select("activity", "eid").withColumn("k", F.row_number().over(salted)).filter(F.col("k") <= samples)
    ids = few.groupBy("activity").agg(F.slice(F.sort_array(F.collect_list("eid")), 1, samples).alias("sample_ids"))
    out = log.events.groupBy("activity").agg(F.count("*").alias("count")).join(ids, "activity").orderBy(F.desc("count"), "activity")
    return out.limit(limit) if limit else out


def orphaned_objects(log: ObjectLog) -> DataFrame:
    """oid, otype of objects without an event."""
    return log.objects.join(log.e2o.select("oid"), "oid", "left_anti")


def anomalies(log: ObjectLog, broken_references: bool = False) -> DataFrame:
    """anomaly_type, severity, affected_id, description: orphaned objects, events without objects, and on request
    relations to objects that the log doesn't have."""
    row = lambda df, kind, level, id_, text: df.select(F.lit(kind).alias("anomaly_type"), F.lit(level).alias("severity"), F.col(id_).alias("affected_id"), F.concat(F.lit(text), F.col(id_)).alias("description"))
    out = row(orphaned_objects(log), "orphaned_object", "medium", "oid", "no event relates to object ")
    out = out.unionByName(row(log.events.join(log.e2o.select("eid"), "eid", "left_anti"), "event_no_objects", "high", "eid", "no object relates to event "))
    if broken_references:
        broken = log.e2o.select("oid").unionByName(log.o2o.select(F.explode(F.array("src_oid", "tgt_oid")).alias("oid"))).join(log.objects.select("oid"), "oid", "left_anti").distinct()
        out = out.unionByName(row(broken, "broken_reference", "high", "oid", "the log has no object "))
    return out


def summary(refs: DataFrame) -> DataFrame:
    """Of a result of event references: count, first and last time, seconds between, activities and object types."""
    out = refs.agg(F.count("*").alias("count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sort_array(F.collect_set("activity")).alias("activities"))
    types = refs.select(F.explode("involved_objects.object_type").alias("t")).agg(F.sort_array(F.collect_set("t")).alias("object_types"))
    return out.crossJoin(types).withColumn("seconds", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6)  # one row each


def reconcile(extracted: DataFrame, injected: DataFrame) -> DataFrame:
    """kind, extracted, injected, difference, status, ratio of two tables (kind, n)."""
    both = extracted.select("kind", F.col("n").alias("extracted")).join(injected.select("kind", F.col("n").alias("injected")), "kind", "full").fillna(0, ["extracted", "injected"])
    diff = F.col("extracted") - F.col("injected")
    status = F.when(diff == 0, "perfect_match").when(diff > 0, "missing_records").otherwise("over_injection")
    return both.select("kind", "extracted", "injected", diff.alias("difference"), status.alias("status"), F.round(F.when(F.col("extracted") > 0, F.col("injected") / F.col("extracted")), 4).alias("ratio"))


def audit(log: ObjectLog) -> DataFrame:
    """section, name, n: events by activity, objects by type, relations by qualifier, and how many events have objects."""
    part = lambda df, section, name: df.groupBy(F.lit(section).alias("section"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    linked = log.events.join(log.e2o.select("eid"), "eid", "left_semi").agg(F.lit("events").alias("section"), F.lit("linked").alias("name"), F.count("*").alias("n"))
    return part(log.events, "activity", "activity").unionByName(part(log.objects, "object_type", "otype")).unionByName(part(log.e2o, "e2o_qualifier", "qualifier")).unionByName(part(log.o2o, "o2o_qualifier", "qualifier")).unionByName(linked)


def linked(log: ObjectLog) -> DataFrame:
    """source_type, qualifier, target_type, n, sources, targets, source_ratio, target_ratio: relations between objects by kind, how
    many distinct objects they link on either side, and what share of all objects of their type these are (rounded to 4).
    Ends that are no objects of the log have a null type and ratio; an object of several types counts under the least one."""
    types = log.objects.groupBy("oid").agg(F.min("otype").alias("otype"))
    of = lambda end: types.select(F.col("oid").alias(f"{end}_oid"), F.col("otype").alias(f"{end}_type"))
    rows = log.o2o.join(of("src"), "src_oid", "left").join(of("tgt"), "tgt_oid", "left")
    counts = rows.groupBy("src_type", "qualifier", "tgt_type").agg(F.count("*").alias("n"), F.countDistinct("src_oid").alias("sources"), F.countDistinct("tgt_oid").alias("targets"))
    sizes = types.groupBy("otype").agg(F.count("*").alias("size"))
    size = lambda end: sizes.select(F.col("otype").alias(f"{end}_type"), F.col("size").alias(f"{end}_size"))
    met = counts.join(size("src"), "src_type", "left").join(size("tgt"), "tgt_type", "left")
    ratio = lambda part, end: F.round(F.col(part) / F.col(f"{end}_size"), 4)
    return met.select(F.col("src_type").alias("source_type"), "qualifier", F.col("tgt_type").alias("target_type"), "n", "sources", "targets", ratio("sources", "src").alias("source_ratio"), ratio("targets", "tgt").alias("target_ratio"))


def breakdown(log: ObjectLog, attribute: str, object_type: str | None = None) -> DataFrame:
    """otype, value, objects: how many distinct objects of each type have had each value of an attribute; the value is null for
    objects that never had one."""
    mine = log.objects if object_type is None else log.objects.filter(F.col("otype") == object_type)
    value = F.col("attrs")[attribute]
    had = log.changes.filter(value.isNotNull()).select("otype", "oid", value.alias("value")).distinct()
    return mine.select("otype", "oid").distinct().join(had, ["otype", "oid"], "left").groupBy("otype", "value").agg(F.count("*").alias("objects"))
