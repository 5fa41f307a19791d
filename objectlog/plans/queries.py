"""The registered queries over the driver's tables, each beside its SQL.

SQL is written against the same adapters: `e` and `r` are the events and relations of the activity log, `s` its pairs of
consecutive events. Durations stay integers until the last division, so both sides round alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, petri, search, setops, stats, traces, validate
from ..sources import mappers
from ..sources.adapters import activity_log, commerce_log, conversation_log, shipment_log, table, text_chunks
from ..sources.staging import folder, version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LOG = """WITH base AS (SELECT CAST(event_id AS VARCHAR) AS eid, event_type AS activity, ts, user_id, json_extract_string(props, '$.k') AS item FROM events),
e AS (SELECT eid, activity, ts FROM base),
r AS (SELECT eid, 'u' || user_id AS oid, 'User' AS otype, 'actor' AS qualifier FROM base WHERE user_id IS NOT NULL UNION ALL SELECT eid, 'i' || item, 'Item', 'target' FROM base WHERE item IS NOT NULL),
t AS (SELECT DISTINCT otype, oid, eid, activity, ts FROM (SELECT DISTINCT eid, oid, otype FROM r) JOIN e USING (eid)),
s AS (SELECT * FROM (SELECT otype, oid, eid AS e1, activity AS src, ts AS t1, lead(eid) OVER w AS e2, lead(activity) OVER w AS tgt, lead(ts) OVER w AS t2, row_number() OVER w - 1 AS pos FROM t WINDOW w AS (PARTITION BY otype, oid ORDER BY ts, eid)) WHERE e2 IS NOT NULL),
dfg AS (SELECT src, tgt, count(*) AS frequency FROM (SELECT DISTINCT otype, src, tgt, e1, e2 FROM s) GROUP BY src, tgt),
perf AS (SELECT src, tgt, count(*) AS count, round(CAST(sum(us) AS DOUBLE) / count(*) / 1e6, 2) AS mean_s, round(min(us) / 1e6, 2) AS min_s, round(max(us) / 1e6, 2) AS max_s, round(median(us) / 1e6, 2) AS median_s, round(stddev_pop(us) / 1e6, 2) AS std_s
         FROM (SELECT src, tgt, epoch_us(t2) - epoch_us(t1) AS us FROM s) GROUP BY src, tgt)
"""
_CONV = """WITH t AS (SELECT conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS eid, role AS activity, turn AS ts, 'c' || conv_id AS oid FROM conversations),
s AS (SELECT * FROM (SELECT oid, eid AS e1, activity AS src, lead(eid) OVER w AS e2, lead(activity) OVER w AS tgt, row_number() OVER w - 1 AS pos FROM t WINDOW w AS (PARTITION BY oid ORDER BY ts, eid)) WHERE e2 IS NOT NULL),
dfg AS (SELECT src, tgt, count(*) AS frequency FROM (SELECT DISTINCT src, tgt, e1, e2 FROM s) GROUP BY src, tgt)
"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_CHUNKS = "SELECT 'd' || doc_id AS id, text AS content, 'documents' AS chunk_type FROM documents UNION ALL SELECT 'b' || item_id, text, 'benchmark' FROM benchmark"
_QUERY = "ention the and"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _second(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Filters


@query(_LOG + "SELECT eid, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e WHERE activity = 'purchase'")
def filter_activity(spark, d):
    return filters.by_activity(activity_log(spark, d), "purchase").select("eid", "activity", _second("ts"))


@query("WITH i AS (SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS eid, 'ItemShipped' AS activity FROM lineitem WHERE l_suppkey IS NOT NULL) SELECT eid, activity FROM i")
def filter_object_type(spark, d):
    return filters.by_object_type(commerce_log(spark, d), "Supplier").select("eid", "activity")


@query(_LOG + "SELECT eid, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM e) AND (SELECT min(ts) + INTERVAL 3 DAY FROM e)")
def events_between(spark, d):
    log = activity_log(spark, d)
    first = log.events.agg(F.min("ts").alias("t")).first().t
    from datetime import timedelta

    return filters.between(log, first + timedelta(days=1), first + timedelta(days=3)).select("eid", "activity", _second("ts"))


@query(_LOG + "SELECT eid, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e WHERE eid IN (SELECT eid FROM r WHERE oid = 'u7')")
def object_lifecycle(spark, d):
    return filters.lifecycle(activity_log(spark, d), "u7").select("eid", "activity", _second("ts"))


@query(
    _LOG
    + """SELECT eid AS event_id, activity, string_agg(oid || '/' || otype || '/' || qualifier, ',' ORDER BY oid) AS involved,
sha256(eid || ':' || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END || '+00:00:' || string_agg(oid, ',' ORDER BY oid)) AS hash FROM e JOIN r USING (eid) GROUP BY eid, activity, ts"""
)
def event_references(spark, d):
    refs = filters.references(activity_log(spark, d))
    text = F.array_join(F.transform("involved_objects", lambda o: F.concat_ws("/", o["object_id"], o["object_type"], o["role"])), ",")
    return refs.select("event_id", "activity", text.alias("involved"), "hash")


@query(_LOG + "SELECT eid AS event_id FROM e WHERE activity = 'click' AND eid IN (SELECT eid FROM r WHERE oid = 'u7') AND eid IN (SELECT eid FROM r WHERE otype = 'Item')")
def cursor_chain(spark, d):
    """Results of results: by object, then by type, then by activity; one plan."""
    refs = filters.references(activity_log(spark, d))
    return filters.refs_with_type(filters.refs_with_object(refs, "u7"), "Item").filter("activity = 'click'").select("event_id")


# Counts and anomalies


@query("SELECT 'Order' AS otype, count(*) AS count FROM orders UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def stats_by_object_type(spark, d):
    return stats.by_object_type(commerce_log(spark, d))


@query(_LOG + "SELECT DISTINCT otype, oid FROM r")
def objects_by_type(spark, d):
    return stats.objects_by_type(activity_log(spark, d))


@query(_LOG + "SELECT (SELECT count(*) FROM e) AS events, (SELECT count(DISTINCT activity) FROM e) AS activities, (SELECT count(*) FROM (SELECT DISTINCT oid, otype FROM r)) AS objects, (SELECT count(DISTINCT otype) FROM r) AS object_types, (SELECT count(*) FROM r) AS relations")
def log_statistics(spark, d):
    return stats.statistics(activity_log(spark, d))


@query(
    _LOG
    + """SELECT (SELECT count(*) FROM e) AS events, (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM e) AS first_ts, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM e) AS last_ts,
(SELECT string_agg(DISTINCT activity, ',' ORDER BY activity) FROM e) AS activities, (SELECT count(*) FROM (SELECT DISTINCT oid, otype FROM r)) AS objects, (SELECT string_agg(DISTINCT otype, ',' ORDER BY otype) FROM r) AS object_types"""
)
def log_info(spark, d):
    return stats.info(activity_log(spark, d)).select("events", _second("first_ts"), _second("last_ts"), F.array_join("activities", ",").alias("activities"), "objects", F.array_join("object_types", ",").alias("object_types"))


@query(_LOG + "SELECT activity, count(*) AS count, array_to_string(list_sort(list(eid))[1:3], ',') AS sample_ids FROM e GROUP BY activity ORDER BY count DESC, activity LIMIT 10")
def activity_frequency(spark, d):
    return stats.activity_frequency(activity_log(spark, d)).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query("SELECT 'o' || o_orderkey AS oid, 'Order' AS otype FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphaned_objects(spark, d):
    return stats.orphaned_objects(shipment_log(spark, d)).select("oid", "otype")


@query(
    """SELECT 'orphaned_object' AS anomaly_type, 'medium' AS severity, 'o' || o_orderkey AS affected_id, 'no event relates to object o' || o_orderkey AS description FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 3)
UNION ALL SELECT 'event_no_objects', 'high', eid, 'no object relates to event ' || eid FROM (SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS eid FROM lineitem WHERE l_linenumber = 3)
UNION ALL SELECT DISTINCT 'broken_reference', 'high', 'o' || l_orderkey, 'the log has no object o' || l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber <> 3"""
)
def anomalies(spark, d):
    """A shipment log without every tenth order and without the relations of third lines: all three kinds of findings."""
    from dataclasses import replace

    log = shipment_log(spark, d)
    whole = replace(log, objects=log.objects.filter("cast(substring(oid, 2) as bigint) % 10 <> 0"), e2o=log.e2o.filter("split(eid, '-')[2] <> '3'"))
    return stats.anomalies(whole, broken_references=True)


@query(
    _LOG
    + """, k AS (SELECT * FROM e WHERE activity = 'purchase')
SELECT count(*) AS count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, string_agg(DISTINCT activity, ',') AS activities, (SELECT string_agg(DISTINCT otype, ',' ORDER BY otype) FROM r WHERE eid IN (SELECT eid FROM k)) AS object_types, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM k"""
)
def cursor_summary(spark, d):
    log = activity_log(spark, d)
    out = stats.summary(filters.references(log, filters.by_activity(log, "purchase")))
    return out.select("count", _second("first_ts"), _second("last_ts"), F.array_join("activities", ",").alias("activities"), F.array_join("object_types", ",").alias("object_types"), F.round("seconds", 3).alias("seconds"))


@query(
    """WITH x AS (SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT o_orderstatus AS kind, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT kind, coalesce(x.n, 0) AS extracted, coalesce(y.n, 0) AS injected, coalesce(x.n, 0) - coalesce(y.n, 0) AS difference, CASE WHEN coalesce(x.n, 0) = coalesce(y.n, 0) THEN 'perfect_match' WHEN coalesce(x.n, 0) > coalesce(y.n, 0) THEN 'missing_records' ELSE 'over_injection' END AS status, round(coalesce(y.n, 0) / x.n, 4) AS ratio FROM x FULL JOIN y USING (kind)"""
)
def reconciliation(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = lambda df: df.groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return stats.reconcile(n(o), n(o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")))


@query(
    _LOG
    + """SELECT 'activity' AS section, activity AS name, count(*) AS n FROM e GROUP BY activity UNION ALL SELECT 'object_type', otype, count(*) FROM (SELECT DISTINCT oid, otype FROM r) GROUP BY otype
UNION ALL SELECT 'e2o_qualifier', qualifier, count(*) FROM r GROUP BY qualifier UNION ALL SELECT 'events', 'linked', count(*) FROM e WHERE eid IN (SELECT eid FROM r)"""
)
def audit_report(spark, d):
    return stats.audit(activity_log(spark, d))


@query(
    """WITH o AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT 'Order' AS source_type, 'placed_by' AS qualifier, 'Customer' AS target_type, n, n AS sources, customers AS targets, round(n / (SELECT count(*) FROM orders), 4) AS source_ratio, round(customers / (SELECT count(*) FROM customer), 4) AS target_ratio FROM o"""
)
def linked_objects(spark, d):
    """Relations between objects by kind, and which share of the objects they link."""
    return stats.linked(commerce_log(spark, d))


@query("SELECT 'Customer' AS otype, o_orderstatus AS value, count(DISTINCT c_custkey) AS objects FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY o_orderstatus")
def attribute_breakdown(spark, d):
    """How many customers have had orders of each status, or none."""
    from dataclasses import replace

    o = table(spark, d, "orders")
    changes = o.select(F.concat(F.lit("c"), "o_custkey").alias("oid"), F.lit("Customer").alias("otype"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("status").alias("changed_field"), F.create_map(F.lit("status"), "o_orderstatus").alias("attrs"))
    return stats.breakdown(replace(commerce_log(spark, d), changes=changes), "status", "Customer")


# Set algebra


@query(_LOG + "SELECT eid AS event_id FROM e WHERE activity = 'view' AND eid IN (SELECT eid FROM r WHERE oid = 'u7')")
def intersect_results(spark, d):
    log = activity_log(spark, d)
    return setops.intersect(filters.references(log, filters.by_activity(log, "view")), filters.references(log, filters.lifecycle(log, "u7"))).select("event_id")


@query(_LOG + "SELECT eid AS event_id, activity FROM e WHERE activity = 'view' OR eid IN (SELECT eid FROM r WHERE oid = 'u7')")
def union_results(spark, d):
    log = activity_log(spark, d)
    return setops.union(filters.references(log, filters.by_activity(log, "view")), filters.references(log, filters.lifecycle(log, "u7"))).select("event_id", "activity")


@query(_LOG + "SELECT eid AS event_id FROM e WHERE activity = 'view' AND eid NOT IN (SELECT eid FROM r WHERE oid = 'u7')")
def difference_results(spark, d):
    log = activity_log(spark, d)
    return setops.difference(filters.references(log, filters.by_activity(log, "view")), filters.references(log, filters.lifecycle(log, "u7"))).select("event_id")


@query("SELECT l_orderkey, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS l_partkey, arg_min(l_suppkey, (l_shipdate, l_linenumber, l_partkey)) AS l_suppkey FROM lineitem GROUP BY l_orderkey")
def first_write_wins(spark, d):
    """Of each order the part and supplier of the line that was shipped first."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return setops.first_write_wins(li, ["l_orderkey"], "struct(l_shipdate, l_linenumber, l_partkey)").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT 'c' || o_custkey AS oid, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS value FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def value_as_of(spark, d):
    from dataclasses import replace

    o = table(spark, d, "orders")
    log = commerce_log(spark, d)
    changes = o.select(F.concat(F.lit("c"), "o_custkey").alias("oid"), F.lit("Customer").alias("otype"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("changed_field"), F.create_map(F.lit("status"), "o_orderstatus").alias("attrs"))
    return filters.value_as_of(replace(log, changes=changes), "status", "1996-01-01T00:00:00Z")


# Traces


@query(_LOG + "SELECT src, tgt, frequency FROM dfg")
def dfg_edges(spark, d):
    return traces.dfg(activity_log(spark, d))


@query(_LOG + "SELECT src, tgt, count(*) AS frequency FROM (SELECT DISTINCT src, tgt, e1, e2 FROM s WHERE otype = 'User') GROUP BY src, tgt")
def dfg_of_one_type(spark, d):
    return traces.dfg(activity_log(spark, d), "User")


@query(_LOG + "SELECT otype, src, tgt, count(*) AS frequency FROM (SELECT DISTINCT otype, src, tgt, e1, e2 FROM s) GROUP BY ALL")
def dfg_by_type(spark, d):
    return traces.dfg_by_type(activity_log(spark, d))


@query(
    """WITH e AS (SELECT 'o' || o_orderkey AS eid, 'OrderPlaced' AS activity, o_orderdate AS ts FROM orders UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'ItemShipped', l_shipdate FROM lineitem),
r AS (SELECT 'o' || o_orderkey AS eid, 'o' || o_orderkey AS oid, 'Order' AS otype FROM orders UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'Customer' FROM orders
UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS eid, unnest(['o' || l_orderkey, 'p' || l_partkey, 's' || l_suppkey]) AS oid, unnest(['Order', 'Part', 'Supplier']) AS otype FROM lineitem),
s AS (SELECT otype, eid AS e1, activity AS src, lead(eid) OVER w AS e2, lead(activity) OVER w AS tgt FROM (SELECT DISTINCT * FROM r) JOIN e USING (eid) WINDOW w AS (PARTITION BY otype, oid ORDER BY ts, eid))
SELECT src, tgt, count(*) AS frequency FROM (SELECT DISTINCT otype, src, tgt, e1, e2 FROM s WHERE e2 IS NOT NULL) GROUP BY src, tgt"""
)
def dfg_commerce(spark, d):
    return traces.dfg(commerce_log(spark, d))


@query(_LOG + "SELECT activity, count(*) AS frequency FROM (SELECT DISTINCT otype, f.activity AS activity, f.eid AS eid FROM (SELECT otype, oid, arg_min({'activity': activity, 'eid': eid}, (ts, eid)) AS f FROM t GROUP BY otype, oid)) GROUP BY activity")
def dfg_start_activities(spark, d):
    return traces.start_activities(activity_log(spark, d))


@query(_LOG + "SELECT activity, count(*) AS frequency FROM (SELECT DISTINCT otype, f.activity AS activity, f.eid AS eid FROM (SELECT otype, oid, arg_max({'activity': activity, 'eid': eid}, (ts, eid)) AS f FROM t GROUP BY otype, oid)) GROUP BY activity")
def dfg_end_activities(spark, d):
    return traces.end_activities(activity_log(spark, d))


@query(_CONV + "SELECT sequence, length, count(*) AS frequency, 'Conversation' AS otypes FROM (SELECT oid, string_agg(activity, ' → ' ORDER BY ts, eid) AS sequence, count(*) AS length FROM t GROUP BY oid) GROUP BY sequence, length")
def sequence_variants(spark, d):
    return traces.variants(conversation_log(spark, d)).withColumn("otypes", F.array_join("otypes", ","))


@query(_CONV + "SELECT row_number() OVER (ORDER BY frequency DESC, sequence) AS variant_id, * FROM (SELECT sequence, length, count(*) AS frequency, 'Conversation' AS otypes FROM (SELECT oid, string_agg(activity, ' → ' ORDER BY ts, eid) AS sequence, count(*) AS length FROM t GROUP BY oid) GROUP BY sequence, length ORDER BY frequency DESC, sequence LIMIT 5)")
def top_variants(spark, d):
    return traces.variants(conversation_log(spark, d), limit=5).withColumn("otypes", F.array_join("otypes", ","))


@query(_LOG + """, v AS (SELECT string_agg(activity, ' → ' ORDER BY ts, eid) AS sequence, count(*) AS length, otype FROM t GROUP BY otype, oid)
SELECT row_number() OVER (ORDER BY frequency DESC, sequence) AS variant_id, * FROM (SELECT sequence, length, count(*) AS frequency, string_agg(DISTINCT otype, ',' ORDER BY otype) AS otypes FROM v GROUP BY sequence, length ORDER BY frequency DESC, sequence LIMIT 20)""")
def tied_variants(spark, d):
    """Users' traces are long and nearly all occur once: the limit cuts through a tie of most variants."""
    return traces.variants(activity_log(spark, d), limit=20).withColumn("otypes", F.array_join("otypes", ","))


@query(_LOG + "SELECT * FROM perf")
def performance(spark, d):
    return traces.performance(activity_log(spark, d))


@query(_LOG + "SELECT src, tgt, count, mean_s, thr AS threshold_s, CASE WHEN mean_s > 1.5 * thr THEN 'high' ELSE 'medium' END AS severity FROM perf, (SELECT quantile_cont(mean_s, 0.75) AS thr FROM perf) WHERE mean_s >= thr")
def bottlenecks(spark, d):
    return traces.bottlenecks(activity_log(spark, d))


@query(_CONV + ", m AS (SELECT src, tgt FROM dfg WHERE frequency >= 60), bad AS (SELECT DISTINCT oid FROM s WHERE (src, tgt) NOT IN (SELECT (src, tgt) FROM m)) SELECT n AS traces, n - b AS conformant, round((n - b) / n, 4) AS fitness FROM (SELECT count(DISTINCT oid) AS n FROM t), (SELECT count(*) AS b FROM bad)")
def conformance(spark, d):
    log = conversation_log(spark, d)
    return traces.conformance(log, traces.dfg(log).filter("frequency >= 60"))


@query(_CONV + ", m AS (SELECT src, tgt FROM dfg WHERE frequency >= 60) SELECT 'Conversation' AS otype, oid, min(pos) AS pos, arg_min(src, pos) AS src, arg_min(tgt, pos) AS tgt FROM s WHERE (src, tgt) NOT IN (SELECT (src, tgt) FROM m) GROUP BY oid")
def conformance_deviations(spark, d):
    log = conversation_log(spark, d)
    return traces.deviations(log, traces.dfg(log).filter("frequency >= 60")).withColumn("pos", F.col("pos").cast("long"))


@query(_LOG + ", n AS (SELECT eid, otype, count(DISTINCT oid) AS n FROM r GROUP BY eid, otype) SELECT a.otype AS type1, b.otype AS type2, CAST(sum(CASE WHEN a.otype = b.otype THEN a.n * (a.n + 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS count FROM n a JOIN n b ON a.eid = b.eid AND a.otype <= b.otype GROUP BY ALL")
def interactions(spark, d):
    return traces.top_interactions(activity_log(spark, d))


@query("SELECT a AS attribute, n AS distinct_values, (SELECT count(*) FROM events) AS rows FROM (SELECT 'user' AS a, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'kind', count(DISTINCT event_type) FROM events) WHERE a = 'user' OR (n / (SELECT count(*) FROM events) > 0.01 AND n / (SELECT count(*) FROM events) < 0.3)")
def resource_attributes(spark, d):
    return traces.resource_attributes(activity_log(spark, d))


@query(_LOG + ", h AS (SELECT 'u' || b1.user_id AS src, 'u' || b2.user_id AS tgt FROM s JOIN base b1 ON s.e1 = b1.eid JOIN base b2 ON s.e2 = b2.eid WHERE b1.user_id <> b2.user_id) SELECT src, tgt, count(*) AS weight FROM h GROUP BY src, tgt")
def social_network(spark, d):
    return traces.handovers(activity_log(spark, d), "user")


# Search


@query("WITH c AS (" + _CHUNKS + "), w AS (SELECT id, unnest(" + _WORDS.format("content") + ") AS term FROM c) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY term")
def tokenise(spark, d):
    return search.term_table(text_chunks(spark, d))


_BM25 = (
    "WITH c AS (" + _CHUNKS + "), w AS (SELECT id, chunk_type, " + _WORDS.format("content") + " AS t FROM c), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),\n"
    "q AS (SELECT unnest(['ention', 'the', 'and']) AS term), tf AS (SELECT id, chunk_type, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM w, q), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),\n"
    "sc AS (SELECT id, chunk_type, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY id, chunk_type)\n"
)


@query(_BM25 + "SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10")
def bm25_search(spark, d):
    return search.bm25(text_chunks(spark, d), _QUERY, 10)


@query(_BM25 + "SELECT id, score FROM sc WHERE chunk_type = 'benchmark' ORDER BY score DESC, id LIMIT 5")
def search_of_type(spark, d):
    return search.search(text_chunks(spark, d), _QUERY, 5, ["benchmark"])


_OF_THE = _BM25.replace("['ention', 'the', 'and']", "['of', 'the']") + ", ph AS (SELECT id, ' ' || array_to_string(t, ' ') || ' ' AS t FROM w)"


@query(_OF_THE + "\nSELECT id, score FROM sc WHERE id IN (SELECT id FROM ph WHERE contains(t, ' of the '))")
def phrase_search(spark, d):
    return search.phrase(text_chunks(spark, d), "Of the", None)


_HYBRID = (
    _OF_THE + ", a AS (SELECT id, score FROM sc WHERE id IN (SELECT id FROM ph WHERE contains(t, ' of the ')) ORDER BY score DESC, id LIMIT 20), b AS (SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 20)\n"
    "SELECT id, round(0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 10"
)


@query(_HYBRID)
def hybrid_search(spark, d):
    return search.hybrid(text_chunks(spark, d), "of the", 10)


def _index(spark, d):
    """The stored index of all chunks, written once for the searches of a session over the same tables."""
    chunks = text_chunks(spark, d)
    key = (spark.sparkContext.applicationId, version(chunks))
    if key not in _INDEXES:
        _INDEXES[key] = search.Index.build(chunks, folder(spark, "index"))
    return _INDEXES[key]


_INDEXES: dict[tuple[str, str], search.Index] = {}


@query(_BM25 + "SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10")
def indexed_bm25(spark, d):
    return _index(spark, d).bm25(_QUERY, 10)


@query(_BM25 + "SELECT id, score FROM sc WHERE chunk_type = 'benchmark' ORDER BY score DESC, id LIMIT 5")
def indexed_search_of_type(spark, d):
    return _index(spark, d).search(_QUERY, 5, ["benchmark"], "bm25")


@query(_OF_THE + "\nSELECT id, score FROM sc WHERE id IN (SELECT id FROM ph WHERE contains(t, ' of the '))")
def indexed_phrase(spark, d):
    return _index(spark, d).phrase("Of the", None)


@query(_HYBRID)
def indexed_hybrid(spark, d):
    return _index(spark, d).hybrid("of the", 10)


@query("SELECT chunk_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'events' AS chunk_type, count(*) AS n FROM events UNION ALL SELECT 'objects', count(DISTINCT user_id) + count(DISTINCT json_extract_string(props, '$.k')) FROM events UNION ALL SELECT 'event_types', count(DISTINCT event_type) FROM events UNION ALL SELECT 'object_types', 2) GROUP BY chunk_type")
def chunk_sizes(spark, d):
    return search.chunks(activity_log(spark, d)).groupBy("chunk_type").agg(F.sum("n").alias("n"))


@query(_LOG + """, c AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, instr('0123456789abcdef', md5(eid)[1]) - 1 AS lane FROM base),
b AS (SELECT *, (row_number() OVER (PARTITION BY day, lane ORDER BY ts, eid) - 1) // 100 AS batch FROM c),
o AS (SELECT DISTINCT otype, oid FROM r), k AS (SELECT otype, CAST(ceil(count(*) / 100) AS BIGINT) AS batches FROM o GROUP BY otype)
SELECT DISTINCT concat_ws('_', 'events', day, lane, batch) AS id FROM b WHERE user_id = 7
UNION SELECT concat_ws('_', 'objects', otype, CAST('0x' || md5(oid)[1:8] AS BIGINT) % batches) FROM o JOIN k USING (otype) WHERE oid = 'u7'""")
def log_value_search(spark, d):
    """The chunks of the activity log that hold a value: the batches of the events whose attribute it is, and the batch of the
    object of that name."""
    return search.bm25(search.chunks(activity_log(spark, d)), "u7", None).select("id")


@query(
    """WITH v AS (SELECT 'kind' AS attribute, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT 'user', 'u' || user_id FROM events WHERE user_id IS NOT NULL),
c AS (SELECT attribute, value, count(*) AS n FROM v GROUP BY attribute, value),
k AS (SELECT *, count(*) OVER (PARTITION BY attribute) AS distinct_values, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS k FROM c)
SELECT attribute, distinct_values, string_agg(value || '=' || n, ',' ORDER BY value) AS histogram FROM k WHERE distinct_values <= 20 OR k <= 10 GROUP BY attribute, distinct_values"""
)
def value_summary(spark, d):
    text = F.array_join(F.transform(F.sort_array(F.map_entries("histogram")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return search.value_summary(activity_log(spark, d)).withColumn("histogram", text)


@query("WITH c AS (" + _CHUNKS + "), w AS (SELECT id, chunk_type, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT id, chunk_type, " + _WORDS.format("content") + " AS t FROM c)) SELECT term, id, chunk_type, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM w GROUP BY term, id, chunk_type")
def inverted_index(spark, d):
    return search.inverted_index(text_chunks(spark, d)).withColumn("positions", F.array_join("positions", ","))


@query()
def petri_nets(spark, d):
    """Places, transitions and arcs of each object type's net."""
    nets = petri.discover(conversation_log(spark, d))
    return spark.createDataFrame([(t, len(n.places), len(n.transitions), len(n.arcs)) for t, n in nets.items()], "otype string, places int, transitions int, arcs int")


# Validation and scalars


_EID = "'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


@query(
    f"""WITH li AS (SELECT {_EID} AS eid, * FROM lineitem), n AS (SELECT eid, count(*) AS n FROM li GROUP BY eid)
SELECT 'semantic' AS level, code, subject, detail FROM (
SELECT 'dangling_event_object' AS code, 'o' || l_orderkey AS subject, eid AS detail FROM li WHERE l_orderkey % 10 = 0
UNION ALL SELECT 'dangling_event', eid, 'o' || l_orderkey FROM li WHERE l_linenumber = 5
UNION ALL SELECT 'missing_event_id', '', '' FROM li WHERE l_linenumber = 6
UNION ALL SELECT 'dangling_event', eid, 'o' || l_orderkey FROM li WHERE l_linenumber = 6
UNION ALL SELECT 'duplicate_event_id', eid, CAST(2 * n AS VARCHAR) FROM li JOIN n USING (eid) WHERE l_linenumber = 7
UNION ALL SELECT 'missing_object_id', '', '' FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT 'dangling_event_object', 'o' || l_orderkey, eid FROM li WHERE l_orderkey % 10 = 1
UNION ALL SELECT 'duplicate_object_id', 'o' || o_orderkey, '2' FROM orders WHERE o_orderkey % 10 = 2
UNION ALL SELECT 'undeclared_event_type', 'ItemShipped', '' WHERE (SELECT count(*) FROM lineitem) > 0
UNION ALL SELECT 'undeclared_object_type', 'Order', '' WHERE (SELECT count(*) FROM orders) > 0
UNION ALL SELECT 'dangling_object_object', 'c' || o_custkey, 'o' || o_orderkey FROM orders
UNION ALL SELECT 'dangling_object_object', 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderkey % 10 IN (0, 1)
UNION ALL SELECT 'attribute_without_time', 'o' || o_orderkey, '' FROM orders WHERE o_orderkey % 10 = 3)"""
)
def validate_references(spark, d):
    """Findings of all eleven kinds in a shipment log with lines and orders left out, blanked and doubled, undeclared types,
    relations to customers it doesn't have, and snapshots without a time."""
    from dataclasses import replace

    log, orders = shipment_log(spark, d), commerce_log(spark, d).o2o
    line, order = F.split("eid", "-")[2], F.expr("cast(substring(oid, 2) as bigint) % 10")
    events = log.events.filter(line != "5").withColumn("eid", F.when(line != "6", F.col("eid")))
    objects = log.objects.filter(order != 0).withColumn("oid", F.when(order != 1, F.col("oid")).otherwise(""))
    broken = replace(
        log, events=events.unionByName(log.events.filter(line == "7")), objects=objects.unionByName(log.objects.filter(order == 2)), o2o=orders, event_types=log.event_types.limit(0), object_types=log.object_types.limit(0),
        changes=log.objects.filter(order == 3).select("oid", "otype", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("changed_field"), F.lit(None).cast("map<string,string>").alias("attrs")),
    )
    return validate.semantics(broken)


@query("SELECT 'semantic' AS level, 'wrong_type' AS code, CAST(event_id AS VARCHAR) AS subject, 'user integer u' || user_id AS detail FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'semantic', 'unknown_type', 'colour', '' WHERE (SELECT count(*) FROM events) > 0")
def validate_attribute_types(spark, d):
    """Values against declared types: users aren't integers, and no type is called colour."""
    from dataclasses import replace

    log = activity_log(spark, d)
    declared = F.array(F.struct(F.lit("user").alias("name"), F.lit("integer").alias("type")), F.struct(F.lit("kind").alias("name"), F.lit("colour").alias("type")))
    return validate.attribute_types(replace(log, event_types=log.event_types.withColumn("attributes", declared)))


_NODE = """to_json(named_struct('number', o_orderkey, 'title', o_orderstatus, 'createdAt', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'author', named_struct('login', concat('c', o_custkey)), 'milestone', named_struct('id', o_orderkey % 3)))"""


@query(
    """WITH m AS (SELECT 'r_issue_' || o_orderkey AS oid, o_orderkey % 3 AS m, * FROM orders), o AS (SELECT oid, 'Issue' AS otype FROM m UNION ALL SELECT DISTINCT 'r_user_c' || o_custkey, 'User' FROM m UNION ALL SELECT DISTINCT 'r', 'Repository' FROM m UNION ALL SELECT DISTINCT 'r_milestone_0', 'Milestone' FROM m)
SELECT 'object' AS part, oid AS a, otype AS b, '' AS c FROM o
UNION ALL SELECT 'event', 'IssueOpened', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), oid FROM m
UNION ALL SELECT 'o2o', oid, 'r', 'contained_in' FROM m UNION ALL SELECT 'o2o', oid, 'r_user_c' || o_custkey, 'created_by' FROM m UNION ALL SELECT 'o2o', oid, 'r_milestone_0', 'belongs_to_milestone' FROM m WHERE m = 0
UNION ALL SELECT DISTINCT 'o2o', 'r_milestone_0', 'r', 'contained_in' FROM m
UNION ALL SELECT 'title', oid, o_orderstatus, '' FROM m"""
)
def mapped_nodes(spark, d):
    """Orders as landed issue nodes of which every third names a milestone that is there, the others one that isn't."""
    issues = table(spark, d, "orders").selectExpr("'r' as repo", "'issue' as kind", f"{_NODE} as node")
    milestone = issues.limit(1).selectExpr("'r' as repo", "'milestone' as kind", """'{"id": "0", "number": 1}' as node""")
    log = mappers.assemble(issues.unionByName(milestone))
    four = lambda df, part, a, b, c: df.select(F.lit(part).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"), (F.col(c) if c else F.lit("")).alias("c"))
    opened = log.rows.filter("activity = 'IssueOpened'").select("activity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.explode("rels").alias("r"))
    happened = opened.filter("r.qualifier = 'subject'").select("activity", "ts", "r.oid")
    titles = log.changes.filter("otype = 'Issue'").select("oid", F.col("attrs")["title"].alias("title"))
    return four(log.objects, "object", "oid", "otype", None).unionByName(four(happened, "event", "activity", "ts", "oid")).unionByName(four(log.o2o, "o2o", "src_oid", "tgt_oid", "qualifier")).unionByName(four(titles, "title", "oid", "title", None))


@query("SELECT event_id, 'my_org_repo_event_' || replace(event_type || '_' || strftime(ts, '%H%M%S'), ' ', '_') AS id FROM events")
def make_ids(spark, d):
    raw = F.concat_ws(" ", "event_type", F.date_format("ts", "HH:mm:ss"))
    return table(spark, d, "events").select("event_id", scalars.make_id(F.lit(" my org/repo "), F.lit(" Event "), raw).alias("id"))


@query("SELECT o_orderkey, 'v' || o_orderkey % 7 || '.' || o_orderkey % 3 || '.' || o_orderkey % 2 AS tag, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'major' WHEN o_orderkey % 2 = 0 THEN 'minor' ELSE 'patch' END AS kind FROM orders")
def release_kinds(spark, d):
    tag = F.concat(F.lit("v"), F.col("o_orderkey") % 7, F.lit("."), F.col("o_orderkey") % 3, F.lit("."), F.col("o_orderkey") % 2)
    return table(spark, d, "orders").select("o_orderkey", tag.alias("tag"), scalars.release_kind(tag).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, epoch(l_shipdate) - epoch(o_orderdate)) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def durations(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.duration_s(iso("o_orderdate"), iso("l_shipdate")).alias("seconds"))
