"""Registered queries of time: overlapping lives, values as of events, moving frames, visits, the cube and token replay, each
beside its SQL where SQL can say the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import cube, history, maintained, overlap, petri, table_functions, traces
from ..operators import replay as replays
from ..sources.adapters import activity_log, commerce_log, conversation_log, table
from ..sources.staging import folder
from .queries import _LOG, query

_ORDERS = "WITH o AS (SELECT 'o' || o_orderkey AS oid, o_custkey AS customer, CAST(o_orderdate AS TIMESTAMP) AS s, greatest(CAST(max(l_shipdate) AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP)) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)\n"


def _orders(spark, d):
    """The lives of shipped orders with their customers."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp").alias("last"))
    start = F.col("o_orderdate").cast("timestamp")
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("oid"), F.col("o_custkey").alias("customer"), start.alias("start"), F.greatest(start, "last").alias("end"))


@query(_ORDERS + "SELECT a.oid AS oid1, b.oid AS oid2, customer, CAST(epoch(least(a.e, b.e) - greatest(a.s, b.s)) AS DOUBLE) AS seconds FROM o a JOIN o b USING (customer) WHERE a.oid < b.oid AND a.s <= b.e AND b.s <= a.e")
def overlapping_orders(spark, d):
    """Orders of one customer that are open at the same time, and for how long."""
    own = _orders(spark, d)
    found = overlap.overlapping(own, own, ["customer"]).filter(F.col("a.oid") < F.col("b.oid"))
    return found.select(F.col("a.oid").alias("oid1"), F.col("b.oid").alias("oid2"), F.col("a.customer").alias("customer"), overlap.seconds_between(F.greatest("a.start", "b.start"), F.least("a.end", "b.end")).alias("seconds"))


@query(_LOG + ", l AS (SELECT otype, oid, min(ts) AS s, max(ts) AS e FROM t GROUP BY otype, oid) SELECT a.oid AS oid1, b.oid AS oid2, (epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s))) / 1e6 AS seconds FROM l a JOIN l b ON a.otype = 'User' AND b.otype = 'Item' AND a.s <= b.e AND b.s <= a.e")
def overlapping_lives(spark, d):
    """Users and items whose lives overlap, over all of them: most lives span most of the log."""
    return overlap.overlapping_lives(activity_log(spark, d), "User", "Item")


@query(_ORDERS + "SELECT a.oid AS oid, count(*) AS n FROM o a JOIN (SELECT 'o' || o_orderkey AS oid, o_custkey AS customer, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b ON a.customer = b.customer AND a.oid <> b.oid AND b.ts BETWEEN a.s AND a.e GROUP BY a.oid")
def shipments_during_orders(spark, d):
    """How many items of a customer's other orders were shipped while an order was open."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    shipped = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("oid"), F.col("o_custkey").alias("customer"), F.col("l_shipdate").cast("timestamp").alias("start"), F.col("l_shipdate").cast("timestamp").alias("end"))
    found = overlap.overlapping(_orders(spark, d), shipped, ["customer"]).filter(F.col("a.oid") != F.col("b.oid"))
    return found.groupBy(F.col("a.oid").alias("oid")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ts, max_by(o_orderstatus, lpad(CAST(o_orderkey AS VARCHAR), 20, '0')) AS value FROM orders GROUP BY o_custkey, o_orderdate),
ev AS (SELECT DISTINCT 'o' || o_orderkey AS eid, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders UNION ALL
       SELECT DISTINCT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, o_custkey, CAST(l_shipdate AS TIMESTAMP) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT eid, 'Customer' AS otype, 'c' || ev.o_custkey AS oid, strftime(ev.ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM ev ASOF LEFT JOIN c ON ev.o_custkey = c.o_custkey AND ev.ts >= c.ts""")
def status_at_events(spark, d):
    """What the status of each event's customer was at the event, for all events of orders and shipments."""
    o, log = table(spark, d, "orders"), commerce_log(spark, d)
    changes = o.select(F.concat(F.lit("c"), "o_custkey").alias("oid"), F.lit("Customer").alias("otype"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("changed_field"), F.create_map(F.lit("status"), "o_orderstatus").alias("attrs"))
    of_order = o.select(F.concat(F.lit("o"), "o_orderkey").alias("oid"), F.concat(F.lit("c"), "o_custkey").alias("customer"))
    shipped = log.e2o.filter("otype = 'Order' and eid like 'l-%'").join(of_order, "oid").select("eid", F.col("customer").alias("oid"), F.lit("Customer").alias("otype"), F.lit("for").alias("qualifier"))
    whole = replace(log, changes=changes, e2o=log.e2o.filter("otype = 'Customer'").unionByName(shipped))
    return history.values_at_events(whole, "status", "Customer").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(_LOG + "SELECT eid, 'u' || user_id AS resource, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS recent FROM base WHERE user_id IS NOT NULL AND ts IS NOT NULL")
def recent_work(spark, d):
    """How much each event's user did in the day before it, the event included."""
    return history.recent_work(activity_log(spark, d), "user", 86_400).select("eid", "resource", "recent")


@query(_LOG + ", g AS (SELECT otype, oid, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS opened FROM t WINDOW w AS (PARTITION BY otype, oid ORDER BY ts, eid)), v AS (SELECT *, sum(opened) OVER (PARTITION BY otype, oid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g WHERE ts IS NOT NULL) SELECT otype, oid, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM v GROUP BY otype, oid, k")
def object_visits(spark, d):
    """Visits: runs of an object's events half a day apart at most."""
    found = history.object_visits(activity_log(spark, d), 43_200)
    return found.select("otype", "oid", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(_LOG + "SELECT activity, otype, strftime(ts, '%Y-%m-%d') AS day, CAST(grouping(activity, otype, strftime(ts, '%Y-%m-%d')) AS BIGINT) AS level, count(*) AS n FROM t GROUP BY CUBE (activity, otype, strftime(ts, '%Y-%m-%d'))")
def activity_cube(spark, d):
    """All groupings of activity, type and day, read from stored cells."""
    path = folder(spark, "cube")
    cube.store(cube.cells(activity_log(spark, d)), path)
    found = cube.grouped(cube.stored(spark, path))
    return found.select("activity", "otype", F.date_format("day", "yyyy-MM-dd").alias("day"), "level", "n")


@query()
def replay_fitness(spark, d):
    """Token replay of all conversations on the net of their frequent edges."""
    log = conversation_log(spark, d)
    pairs = log.e2o.select(F.count("*")).first()[0]
    return replays.replay_fitness(log, petri.discover(log, least=max(1, pairs // 50)))


@query(_LOG + "SELECT otype, oid, eid, activity, row_number() OVER w - 1 AS step, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us, row_number() OVER (PARTITION BY otype, oid, activity ORDER BY ts, eid) - 1 AS seen FROM t WINDOW w AS (PARTITION BY otype, oid ORDER BY ts, eid)")
def trace_steps(spark, d):
    """Places, gaps and loops of every trace, by a table function in SQL."""
    table_functions.register(spark)
    traces.trace(activity_log(spark, d)).createOrReplaceTempView("steps_of")
    return spark.sql("SELECT otype, oid, eid, activity, step, gap_us, seen FROM trace_steps(TABLE(steps_of) PARTITION BY (otype, oid) ORDER BY (ts, eid))")


@query(_LOG + "SELECT src, tgt, frequency FROM dfg")
def maintained_dfg(spark, d):
    """The graph of all events after two inserts, the events of odd ids first: the second one's fall between the first one's."""
    path, log = folder(spark, "maintained"), activity_log(spark, d)
    maintained.create(spark, path)
    odd = F.col("eid").cast("long") % 2 == 1
    for part in (odd, ~F.coalesce(odd, F.lit(False))):
        maintained.insert(replace(log, events=log.events.filter(part)), path)  # relations of other events meet none
    return maintained.dfg(spark, path)
