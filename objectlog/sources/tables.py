"""Logs as Parquet tables, and as a relational store of one typed table for each event and object type."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from .. import schema
from ..log import ObjectLog
from .staging import staged, streamed

#: The key of each table, of which the first write wins, and what its rows are dealt over folders by.
KEYS = {"objects": ["oid"], "events": ["eid"], "e2o": ["eid", "oid", "qualifier"], "o2o": ["src_oid", "tgt_oid", "qualifier"], "changes": ["oid", "ts", "changed_field"], "event_types": ["name"], "object_types": ["name"]}
#: Folders that a table's rows are dealt over by a hash of their key's first column.
BUCKETS = 32
NAMES = ("events", "objects", "e2o", "o2o", "changes", "event_types", "object_types")


SCHEMAS = {"events": schema.EVENTS, "objects": schema.OBJECTS, "e2o": schema.E2O, "o2o": schema.O2O, "changes": schema.CHANGES, "event_types": schema.TYPES, "object_types": schema.TYPES}


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with the columns of its folders; an empty one has no file that tells its schema."""
    by = [StructField("day", DateType())] * (name == "events") + [StructField("bucket", IntegerType())]
    return spark.read.schema(StructType([*SCHEMAS[name].fields, *by])).parquet(f"{folder}/{name}")


def _dealt(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """The rows with the columns of their folders: a hash of the key, events by day before it."""
    df = df.select(*SCHEMAS[name].names).withColumn("bucket", _bucket(F.col(KEYS[name][0])))
    return (df.withColumn("day", F.to_date("ts")), ["day", "bucket"]) if name == "events" else (df, ["bucket"])


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write(log: ObjectLog, folder: str, mode: str = "errorifexists") -> None:
    """The tables as Parquet, by day (events) and hashed key, so that a time range or a few keys prune files."""
    for name in NAMES:
        df, by = _dealt(getattr(log, name), name)
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str) -> ObjectLog:
    """A log that `write` has written."""
    return ObjectLog(**{n: _stored(spark, folder, n).drop("day", "bucket") for n in NAMES})


def write_bucketed(log: ObjectLog, database: str, buckets: int = 64) -> None:
    """Catalog tables with events and relations bucketed by event id, so that their joins need no shuffle."""
    for name in NAMES:
        w = getattr(log, name).write.mode("overwrite")
        if name in ("events", "e2o"):
            w = w.bucketBy(buckets, "eid").sortBy("eid")
        w.saveAsTable(f"{database}.{name}")


def wide(rows: DataFrame, type_column: str, type_name: str, attributes: list[str]) -> DataFrame:
    """Rows of one type with a column for each attribute."""
    kept = [c for c in rows.columns if c not in ("attrs", type_column)]
    return rows.filter(F.col(type_column) == type_name).select(*kept, *[F.col("attrs")[a].alias(a) for a in attributes])


def attribute_names(rows: DataFrame, type_column: str) -> dict[str, list[str]]:
    """Attributes in use by type: as many rows as there are pairs of type and attribute."""
    found = rows.select(type_column, F.explode(F.map_keys("attrs")).alias("a")).distinct().orderBy(type_column, "a").collect()
    out: dict[str, list[str]] = {}
    for t, a in found:
        out.setdefault(t, []).append(a)
    return out


def table_names(types: list[str]) -> dict[str, str]:
    """A table's name for each type: its letters and digits; types that agree in these, but for case, are numbered in order."""
    out: dict[str, str] = {}
    used = {"map_type"}
    for t in sorted(types):
        plain = re.sub("[^a-zA-Z0-9]", "", t)
        name, k = plain, 2
        while name.lower() in used:
            name, k = f"{plain}_{k}", k + 1
        used.add(name.lower())
        out[t] = name
    return out


def export_sqlite(log: ObjectLog, path: str, batch: int = 5_000) -> None:
    """A relational store in one SQLite file on the driver, streamed; the first write of a key wins. Meant for logs that
    fit one file: Parquet is the store for others. ValueError if an event has no object."""
    if log.events.join(log.e2o.select("eid"), "eid", "left_anti").limit(1).count():
        raise ValueError("an event without an object can't be stored")
    db = sqlite3.connect(path)
    quoted = lambda n: '"' + n.replace('"', '""') + '"'

    def table(name: str, columns: list[str], key: int, rows: DataFrame) -> None:
        names = ", ".join(map(quoted, columns))
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({names}, PRIMARY KEY ({', '.join(map(quoted, columns[:key]))}))")
        held = []
        for row in rows.toLocalIterator():
            held.append(tuple(row))
            if len(held) == batch:
                db.executemany(f"INSERT OR IGNORE INTO {quoted(name)} VALUES ({','.join('?' * len(columns))})", held)
                held = []
        db.executemany(f"INSERT OR IGNORE INTO {quoted(name)} VALUES ({','.join('?' * len(columns))})", held)

    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    table("event", ["ocel_id", "ocel_type"], 1, log.events.select("eid", "activity"))
    table("object", ["ocel_id", "ocel_type"], 1, log.objects)
    table("event_object", ["ocel_event_id", "ocel_object_id", "ocel_qualifier"], 3, log.e2o.select("eid", "oid", F.coalesce("qualifier", F.lit("related"))))
    table("object_object", ["ocel_source_id", "ocel_target_id", "ocel_qualifier"], 3, log.o2o)
    for prefix, rows, column, key in (("event", log.events, "activity", ["eid"]), ("object", log.changes, "otype", ["oid"])):
        types = [r[0] for r in (log.events if prefix == "event" else log.objects).select("activity" if prefix == "event" else "otype").distinct().orderBy(1).collect() if r[0] is not None]
        names = attribute_names(rows, column)
        spark = rows.sparkSession
        tables = table_names(types)
        table(f"{prefix}_map_type", ["ocel_type", "ocel_type_map"], 1, spark.createDataFrame([*tables.items()], "a string, b string"))
        for t in types:
            own = names.get(t, [])
            extra = [] if prefix == "event" else [F.coalesce("changed_field", F.lit("")).alias("changed_field")]
            head = ["ocel_id", "ocel_time"] + ([] if prefix == "event" else ["ocel_changed_field"])
            mine = rows.filter(F.col(column) == t).select(*key, time, *extra, *[F.col("attrs")[a] for a in own])
            table(f"{prefix}_{tables[t]}", head + own, len(head) if prefix == "object" else 1, mine)
    db.execute("CREATE INDEX IF NOT EXISTS event_object_by_object ON event_object (ocel_object_id)")
    db.commit()
    db.close()


def import_sqlite(spark: SparkSession, path: str) -> ObjectLog:
    """A log from such a file, streamed through the driver a batch at a time."""
    db = sqlite3.connect(path)
    db.row_factory = sqlite3.Row
    all_ = lambda q: (dict(r) for r in db.execute(q))
    kinds_of = lambda prefix: [(r["ocel_type"], r["ocel_type_map"]) for r in all_(f"SELECT * FROM {prefix}_map_type")]
    bag = lambda r: {k: str(v) for k, v in r.items() if k not in ("ocel_id", "ocel_time", "ocel_changed_field") and v is not None}
    events = ((r["ocel_id"], t, r["ocel_time"], bag(r)) for t, name in kinds_of("event") for r in all_(f'SELECT * FROM "event_{name}"'))
    changes = ((r["ocel_id"], t, r["ocel_time"], r["ocel_changed_field"] or None, bag(r)) for t, name in kinds_of("object") for r in all_(f'SELECT * FROM "object_{name}"'))
    e2o = "SELECT ocel_event_id, ocel_object_id, o.ocel_type, ocel_qualifier FROM event_object LEFT JOIN object o ON o.ocel_id = ocel_object_id"
    plain = lambda q: (tuple(r) for r in db.execute(q))
    ts = lambda df: df.withColumn("ts", F.try_to_timestamp("ts"))
    try:
        return ObjectLog.of(
            ts(streamed(spark, events, "eid string, activity string, ts string, attrs map<string,string>", "events")), streamed(spark, plain("SELECT ocel_id, ocel_type FROM object"), "oid string, otype string", "objects"),
            streamed(spark, plain(e2o), "eid string, oid string, otype string, qualifier string", "e2o"), streamed(spark, plain("SELECT * FROM object_object"), "src_oid string, tgt_oid string, qualifier string", "o2o"),
            ts(streamed(spark, changes, "oid string, otype string, ts string, changed_field string, attrs map<string,string>", "changes")),
        )
    finally:
        db.close()


def insert(log: ObjectLog, folder: str) -> dict[str, int]:
    """Add a log to the tables that `write` has written; how many rows each gained.

    What is there stays: of a key (an event's id, an object's id, a relation, a snapshot's object, time and field) the first
    write wins. Within the log the row of the least ``seq`` (order of ingest) is the first where a table has that column, and
    else the least one by its other columns, times before the rest. ValueError if a new event has no object. Types and
    attributes may be new: attributes are maps, and `wide` gives each its column.

    Only the folders that new keys hash to are read, and of these only the keys; rows are compared by joins, and only new
    ones are written; each part is complete before the next begins, objects and events before what refers to them, so a
    rerun after a failure adds what is missing.
    """
    spark = log.spark
    if log.events.join(log.e2o.select("eid"), "eid", "left_anti").limit(1).count():
        raise ValueError("an event without an object can't be stored")
    gained = {}
    for name, key in KEYS.items():
        rows = staged(_first(getattr(log, name), key), name)
        there = keys_there(spark, folder, name, rows).select(*[F.col(k).alias(f"{k}_") for k in key]).distinct()
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        new = staged(rows.join(there, same, "left_anti"), name)
        gained[name] = new.count()
        if gained[name]:
            dealt, by = _dealt(new, name)
            dealt.write.mode("append").partitionBy(*by).parquet(f"{folder}/{name}")
    return gained


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key, without ``seq``."""
    kept = [c for c in rows.columns if c != "seq"]
    plain = lambda c: F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() in ("map", "array") else F.col(c)  # noqa: E731  maps have no order
    rest = sorted((c for c in kept if c not in key), key=lambda c: (c != "ts", kept.index(c)))
    order = [x for c in ([F.col("seq")] if "seq" in rows.columns else []) + [plain(c) for c in rest] for x in (c.isNull(), c)]
    row = F.struct(*kept)
    return rows.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).agg((F.min_by(row, F.struct(*order)) if order else F.first(row)).alias("row")).select("row.*")


def keys_there(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> DataFrame:
    """The stored rows of a table in the folders that the keys of ``rows`` hash to (at most `BUCKETS` of them)."""
    stored = _stored(spark, folder, name)
    wanted = [r[0] for r in rows.select(_bucket(F.col(KEYS[name][0])).alias("b")).distinct().collect()]
    return stored.filter(F.col("bucket").isin(wanted)) if len(wanted) < BUCKETS else stored
