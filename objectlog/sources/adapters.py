"""Plain tables as object logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import ObjectLog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_log(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """`events` as a log: the user and the item of `props` are its objects; attributes user, type and value."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("eid"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), "user_id").alias("user"),
        F.concat(F.lit("i"), F.get_json_object("props", "$.k")).alias("item"),
        "event_type",
    )
    events = rows.select("eid", "activity", "ts", F.create_map(F.lit("user"), "user", F.lit("kind"), "event_type").alias("attrs"))
    both = rows.select("eid", F.explode(F.array(F.struct(F.col("user").alias("oid"), F.lit("User").alias("otype"), F.lit("actor").alias("qualifier")), F.struct(F.col("item").alias("oid"), F.lit("Item").alias("otype"), F.lit("target").alias("qualifier")))).alias("r"))
    e2o = both.select("eid", "r.*").filter("oid is not null")
    return ObjectLog.of(events, e2o.select("oid", "otype").distinct(), e2o)


def commerce_log(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """`orders` and `lineitem` as a log: OrderPlaced and ItemShipped over Order, Customer, Part and Supplier."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    placed = o.select(F.concat(F.lit("o"), "o_orderkey").alias("eid"), F.lit("OrderPlaced").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("o"), "o_orderkey").alias("order"), F.concat(F.lit("c"), "o_custkey").alias("customer"))
    shipped = li.select(
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("eid"), F.lit("ItemShipped").alias("activity"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("o"), "l_orderkey").alias("order"), F.concat(F.lit("p"), "l_partkey").alias("part"), F.concat(F.lit("s"), "l_suppkey").alias("supplier"),
    )
    rel = lambda df, c, t: df.select("eid", F.col(c).alias("oid"), F.lit(t).alias("otype"), F.lit(c).alias("qualifier"))
    e2o = rel(placed, "order", "Order").unionByName(rel(placed, "customer", "Customer")).unionByName(rel(shipped, "order", "Order")).unionByName(rel(shipped, "part", "Part")).unionByName(rel(shipped, "supplier", "Supplier"))
    objects = placed.select(F.col("order").alias("oid"), F.lit("Order").alias("otype"))
    for name, key, letter, otype in (("customer", "c_custkey", "c", "Customer"), ("part", "p_partkey", "p", "Part"), ("supplier", "s_suppkey", "s", "Supplier")):
        objects = objects.unionByName(table(spark, sf_dir, name).select(F.concat(F.lit(letter), key).alias("oid"), F.lit(otype).alias("otype")))
    events = placed.select("eid", "activity", "ts").unionByName(shipped.select("eid", "activity", "ts"))
    beside = lambda df, **types: df.select("eid", "activity", "ts", F.lit(None).cast("map<string,string>").alias("attrs"), F.array(*[F.struct(F.col(c).alias("oid"), F.lit(t).alias("otype"), F.lit(c).alias("qualifier")) for c, t in types.items()]).alias("rels"))
    rows = beside(placed, order="Order", customer="Customer").unionByName(beside(shipped, order="Order", part="Part", supplier="Supplier"))
    o2o = placed.select(F.col("order").alias("src_oid"), F.col("customer").alias("tgt_oid"), F.lit("placed_by").alias("qualifier"))
    return ObjectLog.of(events, objects, e2o, o2o).with_rows(rows)


def shipment_log(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """`lineitem` alone over all orders: orders without a line are orphans."""
    log = commerce_log(spark, sf_dir)
    return ObjectLog.of(log.events.filter("activity = 'ItemShipped'"), log.objects.filter("otype = 'Order'"), log.e2o.filter("otype = 'Order' and eid like 'l-%'"))


def conversation_log(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """`conversations` as a log: a turn is an event, its role the activity, its place the time."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("eid"), F.col("role").alias("activity"), F.timestamp_seconds("turn").alias("ts"), F.concat(F.lit("c"), "conv_id").alias("oid"))
    e2o = rows.select("eid", "oid", F.lit("Conversation").alias("otype"), F.lit("turn_of").alias("qualifier"))
    return ObjectLog.of(rows.select("eid", "activity", "ts"), e2o.select("oid", "otype").distinct(), e2o)


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` and `benchmark` as chunks to search: id, content, chunk_type."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"), F.lit("documents").alias("chunk_type"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("content"), F.lit("benchmark").alias("chunk_type"))
    return d.unionByName(b)
