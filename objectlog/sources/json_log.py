"""The nested JSON form of a log, read and written; and the declared schema alone."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..log import ObjectLog


def read(spark: SparkSession, path: str) -> ObjectLog:
    """A log from JSON documents (one or several files, each with the four top keys). Values of any JSON type become text;
    times without an offset are UTC, a time that doesn't parse becomes null."""
    doc = spark.read.schema(schema.DOCUMENT).option("multiLine", True).json(path)
    bag = lambda c: F.map_from_entries(F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.struct(a["name"], a["value"])), lambda a: a["value"].isNotNull()))
    e = doc.select(F.inline("events"))
    o = doc.select(F.inline("objects"))
    events = e.select(F.col("id").alias("eid"), F.col("type").alias("activity"), F.try_to_timestamp("time").alias("ts"), bag(F.col("attributes")).alias("attrs"))
    objects = o.select(F.col("id").alias("oid"), F.col("type").alias("otype"))
    arcs = e.select(F.col("id").alias("eid"), F.explode("relationships").alias("r")).select("eid", F.col("r.objectId").alias("oid"), F.col("r.qualifier").alias("qualifier"))
    e2o = arcs.join(objects, "oid", "left").select("eid", "oid", "otype", "qualifier")
    o2o = o.select(F.col("id").alias("src_oid"), F.explode("relationships").alias("r")).select("src_oid", F.col("r.objectId").alias("tgt_oid"), F.col("r.qualifier").alias("qualifier"))
    values = o.select(F.col("id").alias("oid"), F.col("type").alias("otype"), F.explode("attributes").alias("a")).select("oid", "otype", F.try_to_timestamp("a.time").alias("ts"), "a.name", "a.value")
    changes = values.filter("value is not null").groupBy("oid", "otype", "ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("attrs")).select("oid", "otype", "ts", F.lit(None).cast("string").alias("changed_field"), "attrs")
    types = lambda c: doc.select(F.inline(c)).distinct()
    return ObjectLog(events, objects, e2o, o2o, changes, types("eventTypes"), types("objectTypes"))


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_rows(log: ObjectLog) -> DataFrame:
    """id, type, time, attributes, relationships: the events section, by time. A missing qualifier is `related`."""
    arcs = log.e2o.groupBy("eid").agg(F.sort_array(F.collect_list(F.struct(F.col("oid").alias("objectId"), F.coalesce("qualifier", F.lit("related")).alias("qualifier")))).alias("relationships"))
    attrs = F.transform(F.sort_array(F.map_entries(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda a: F.struct(a["key"].alias("name"), a["value"].alias("value")))
    out = log.events.join(arcs, "eid", "left")
    return out.orderBy("ts", "eid").select(F.col("eid").alias("id"), F.col("activity").alias("type"), _iso("ts").alias("time"), attrs.alias("attributes"), F.coalesce("relationships", F.array().cast("array<struct<objectId:string,qualifier:string>>")).alias("relationships"))


def object_rows(log: ObjectLog) -> DataFrame:
    """id, type, relationships, attributes: every object, also those without attributes; a partial snapshot gives only the
    attribute that changed."""
    flat = log.changes.select("oid", "ts", "changed_field", F.explode("attrs").alias("name", "value")).filter("value is not null and (changed_field is null or name = changed_field)")
    attrs = flat.groupBy("oid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "name", "value"))), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"), F.date_format(a["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))).alias("attributes"))
    arcs = log.o2o.groupBy(F.col("src_oid").alias("oid")).agg(F.sort_array(F.collect_list(F.struct(F.col("tgt_oid").alias("objectId"), F.coalesce("qualifier", F.lit("related")).alias("qualifier")))).alias("relationships"))
    out = log.objects.join(arcs, "oid", "left").join(attrs, "oid", "left").orderBy("oid")
    return out.select(F.col("oid").alias("id"), F.col("otype").alias("type"), F.coalesce("relationships", F.array().cast("array<struct<objectId:string,qualifier:string>>")).alias("relationships"), F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string,time:string>>")).alias("attributes"))


def parts(log: ObjectLog) -> dict[str, DataFrame]:
    """The four sections as one-column DataFrames of JSON text, in the order of the document."""
    text = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return {"eventTypes": text(log.event_types.orderBy("name")), "objectTypes": text(log.object_types.orderBy("name")), "events": text(event_rows(log)), "objects": text(object_rows(log))}


def write_lines(log: ObjectLog, folder: str) -> None:
    """One JSON-lines folder for each section: the form that scales."""
    for name, rows in parts(log).items():
        rows.write.mode("overwrite").text(f"{folder}/{name}")


def write_document(log: ObjectLog, path: str) -> None:
    """One nested document in one file on the driver, streamed partition by partition."""
    with open(path, "w") as out:
        for i, (name, rows) in enumerate(parts(log).items()):
            out.write(("{" if not i else ",") + f'"{name}":[')
            for k, row in enumerate(rows.toLocalIterator()):
                out.write(("," if k else "") + row.value)
            out.write("]")
        out.write("}")


def event_batches(log: ObjectLog, size: int = 1_000) -> Iterator[list[dict]]:
    """Events in lists of at most ``size``, fetched a partition at a time."""
    batch: list[dict] = []
    for row in log.events.toLocalIterator(prefetchPartitions=True):
        batch.append(row.asDict(recursive=True))
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def located(path: str | None = None) -> str:
    """The document's path: the argument, else the environment's OBJECT_LOG_FILE; ValueError if neither names one."""
    found = path or os.environ.get("OBJECT_LOG_FILE")
    if not found:
        raise ValueError("name a log by argument or by OBJECT_LOG_FILE")
    return found


def read_schema(spark: SparkSession, path: str | None = None) -> dict[str, dict[str, list[str]]]:
    """Declared types and their attributes: {"events": {type: names}, "objects": {type: names}}; ValueError without any.
    The path may come from the environment, see `located`."""
    path = located(path)
    doc = spark.read.schema(schema.DOCUMENT).option("multiLine", True).json(path)
    found = {side: {r.name: [a.name for a in r.attributes or []] for r in doc.select(F.inline(c)).distinct().collect()} for side, c in (("events", "eventTypes"), ("objects", "objectTypes"))}
    if not any(found.values()):
        raise ValueError(f"{path} declares no types")
    return found
