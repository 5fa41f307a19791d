"""Set algebra over results of event references (rows with event_id), and write-once upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first whose event_id the second has; repeats in the first stay, rows without an id go."""
    return first.join(second.select("event_id"), "event_id", "left_semi").select(first.columns)


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first whose event_id the second doesn't have; rows without an id stay."""
    return first.join(second.select("event_id"), "event_id", "left_anti").select(first.columns)


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row for each event_id, of the first result that has it; rows without an id all stay."""
    both = first.withColumn("_from", F.lit(1)).unionByName(second.withColumn("_from", F.lit(2)), allowMissingColumns=True)
    # Rows without an id get windows of their own, so that they don't all meet in one task.
    own = F.when(F.col("event_id").isNull(), F.monotonically_increasing_id())
    names = [c for c in both.columns if c not in ("_from", "_own")]
    order = Window.partitionBy("event_id", "_own").orderBy("_from", *[F.to_json(F.struct(*names))])
    return both.withColumn("_own", own).withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(*names)


def first_write_wins(rows: DataFrame, keys: list[str], sequence: Column | str) -> DataFrame:
    """One row for each key: the one that came first by an explicit ingest sequence."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.expr(sequence) if isinstance(sequence, str) else sequence).alias("_r")) if rest else rows.dropDuplicates(keys)
    return one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else one


def merged_attributes(changes: DataFrame) -> DataFrame:
    """Snapshots of an object at one time as one: attribute by attribute, the first by ingest sequence wins.

    ``changes`` has oid, otype, ts, changed_field, attrs and seq.
    """
    flat = changes.select("oid", "otype", "ts", "changed_field", "seq", F.explode_outer("attrs").alias("name", "value"))
    one = flat.groupBy("oid", "otype", "ts", "changed_field", "name").agg(F.min_by("value", "seq").alias("value"))
    pairs = F.filter(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda x: x["name"].isNotNull())
    return one.groupBy("oid", "otype", "ts", "changed_field").agg(F.map_from_entries(pairs).alias("attrs"))
