"""Validators: each returns one row for each finding, (level, code, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import ObjectLog
from ..schema import ATTRIBUTE_TYPES
from .crowds import counted, lacking


def _row(df: DataFrame, code: str, subject: Column | str, detail: Column | str = "") -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) and x else (F.lit("") if isinstance(x, str) else x)
    level = {"missing_key": "syntax", "not_a_list": "syntax", "missing_name": "syntax", "malformed_attribute": "syntax", "malformed_relationship": "syntax"}.get(code, "semantic")
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), c(subject).cast("string").alias("subject"), c(detail).cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(names: tuple[str, ...]):
    """A test of a JSON text: one of the keys is missing."""
    return lambda a: F.array_contains(F.array(*[F.get_json_object(a, f"$.{n}").isNull() for n in names]), True)


def syntax(raw: DataFrame) -> DataFrame:
    """Findings of a JSON document given as a one-column DataFrame ``value`` (text, one document a row)."""
    keys = ("eventTypes", "objectTypes", "events", "objects")
    at = lambda k: F.get_json_object("value", f"$.{k}")
    parts = [_row(raw.filter(at(k).isNull()), "missing_key", F.lit(k)) for k in keys]
    parts += [_row(raw.filter(at(k).isNotNull() & ~at(k).startswith("[")), "not_a_list", F.lit(k)) for k in keys]
    item = "array<string>"
    for k in keys:
        rows = raw.select(F.posexplode(F.from_json(at(k), item)).alias("i", "x")).select("i", "x")
        get = lambda name: F.get_json_object("x", f"$.{name}")
        place = F.concat(F.lit(f"{k}["), "i", F.lit("]"))
        if k.endswith("Types"):
            parts.append(_row(rows.filter(get("name").isNull()), "missing_name", place))
            parts.append(_row(rows.filter(F.exists(F.coalesce(F.from_json(get("attributes"), item), F.array().cast(item)), _without(("name", "type")))), "malformed_attribute", place))
        else:
            for name, code, need in (("attributes", "malformed_attribute", ("name", "value")), ("relationships", "malformed_relationship", ("objectId", "qualifier"))):
                parts.append(_row(rows.filter(F.exists(F.coalesce(F.from_json(get(name), item), F.array().cast(item)), _without(need))), code, place))
    return _all(parts)


def semantics(log: ObjectLog) -> DataFrame:
    """Findings of a log: missing (null or empty) and repeated ids, undeclared types, relations to missing objects or events, changes
    without a time."""
    twice = lambda df, c, code: _row(counted(df.filter(F.col(c) != ""), c).filter("n > 1"), code, c, "n")
    undeclared = lambda df, c, types, code: _row(df.select(F.col(c).alias("name")).distinct().join(types.select("name"), "name", "left_anti"), code, "name")
    oids, eids = log.objects.select("oid"), log.events.select("eid")
    return _all(
        [
            _row(log.events.filter("eid is null or eid = ''"), "missing_event_id", F.lit("")),
            _row(log.objects.filter("oid is null or oid = ''"), "missing_object_id", F.lit("")),
            twice(log.events, "eid", "duplicate_event_id"),
            twice(log.objects, "oid", "duplicate_object_id"),
            undeclared(log.events, "activity", log.event_types, "undeclared_event_type"),
            undeclared(log.objects, "otype", log.object_types, "undeclared_object_type"),
            _row(lacking(log.e2o, oids, "oid"), "dangling_event_object", "oid", "eid"),
            _row(lacking(log.e2o, eids, "eid"), "dangling_event", "eid", "oid"),
            _row(lacking(log.o2o, oids.withColumnRenamed("oid", "tgt_oid"), "tgt_oid"), "dangling_object_object", "tgt_oid", "src_oid"),
            _row(lacking(log.o2o, oids.withColumnRenamed("oid", "src_oid"), "src_oid"), "dangling_object_object", "src_oid", "tgt_oid"),
            _row(log.changes.filter("ts is null"), "attribute_without_time", "oid"),
        ]
    )


def attribute_types(log: ObjectLog) -> DataFrame:
    """Findings where an event attribute's value doesn't read as its declared type (`float` takes integers too)."""
    declared = log.event_types.select(F.col("name").alias("activity"), F.explode("attributes").alias("a")).select("activity", F.col("a.name").alias("attribute"), F.col("a.type").alias("type"))
    values = log.events.select("eid", "activity", F.explode("attrs").alias("attribute", "value")).filter("value is not null")
    typed = values.join(declared, ["activity", "attribute"])
    fine = F.lit(False)
    for name, spark_type in ATTRIBUTE_TYPES.items():
        fine = fine | ((F.col("type") == name) & F.col("value").try_cast(spark_type).isNotNull())
    known = F.col("type").isin(list(ATTRIBUTE_TYPES))
    return _row(typed.filter(known & ~fine), "wrong_type", "eid", F.concat_ws(" ", "attribute", "type", "value")).unionByName(_row(typed.filter(~known).select("type").distinct(), "unknown_type", "type"))


def validate(raw: DataFrame | None, log: ObjectLog) -> DataFrame:
    """All findings; the semantic ones only if the document (if given) has no syntax error, as later checks rest on it."""
    if raw is not None:
        found = syntax(raw)
        if found.limit(1).count():
            return found
    return semantics(log).unionByName(attribute_types(log))


def version(raw: DataFrame) -> DataFrame:
    """version: "2.0" where the four top keys are there, else null."""
    all_ = [F.get_json_object("value", f"$.{k}").isNotNull() for k in ("eventTypes", "objectTypes", "events", "objects")]
    return raw.select(F.when(all_[0] & all_[1] & all_[2] & all_[3], "2.0").alias("version"))
