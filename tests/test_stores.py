"""What a store and a search must get right when things are asked again: after inserts, with names that clash, with keys that
repeat, with chunks that share an id."""

from dataclasses import replace

from objectlog.log import ObjectLog
from objectlog.operators import petri, search
from objectlog.plans.cursor import Models
from objectlog.sources import tables
from objectlog.sources.staging import version
from pyspark.sql import functions as F


def small_log(spark, rows, attrs="attrs map<string,string>"):
    """Events (eid, activity, seconds, attrs), each of one order."""
    events = spark.createDataFrame([(e, a, t, x) for e, a, t, x in rows], f"eid string, activity string, s long, {attrs}").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e2o = spark.createDataFrame([(e, f"o{e[-1]}", "Order", "of") for e, *_ in rows], "eid string, oid string, otype string, qualifier string")
    return ObjectLog.of(events, e2o.select("oid", "otype").distinct(), e2o.distinct())


def test_models_after_an_insert(spark, mini, tmp_path):
    """The same files give the kept model, read again or not; a log that has grown gives a new one."""
    folder, models = str(tmp_path / "t"), Models()
    tables.write(mini.with_events(mini.events.filter("eid <> 'e6'")), folder)
    made = lambda log: models.get(log, "net", lambda: petri.discover(log))
    first = made(tables.read(spark, folder))
    assert made(tables.read(spark, folder)) is first and len(models) == 1
    before = version(tables.read(spark, folder).events)
    tables.insert(small_log(spark, [("n1", "Return", 1_800_000_000, {}), ("n2", "Refund", 1_800_000_060, {})]), folder)
    now = made(tables.read(spark, folder))
    assert now is not first and len(models) == 2 and version(tables.read(spark, folder).events) != before
    labels = {label for _, label in now["Order"].transitions}
    assert {"Return", "Refund"} <= labels and not {"Return"} & {label for _, label in first["Order"].transitions}


def test_types_with_one_plain_name(spark, tmp_path):
    log = small_log(spark, [("e1", "Pull Request", 1, {"note": "a"}), ("e2", "PullRequest", 2, {"note": "b"}), ("e3", "pull-request", 3, {}), ("e4", "map_type", 4, {}), ("e5", "日本", 5, {"x": "1"})])
    assert tables.table_names(["PullRequest", "Pull Request", "pull-request"]) == {"Pull Request": "PullRequest", "PullRequest": "PullRequest_2", "pull-request": "pullrequest_3"}
    tables.export_sqlite(log, str(tmp_path / "x.db"))
    back = tables.import_sqlite(spark, str(tmp_path / "x.db"))
    key = lambda df: sorted((r.eid, r.activity, r.ts, (r.attrs or {}).get("note")) for r in df.collect())
    assert key(back.events) == key(log.events)


def test_first_of_a_batch_by_order_of_ingest(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.write(small_log(spark, [("e0", "Old", 9, {})]), folder)
    rows = [("e1", "Late", 5, {"k": "1"}), ("e1", "First", 7, {"k": "2"}), ("e1", "Early", 1, None), ("e0", "New", 1, {})]
    log = small_log(spark, rows)
    by_seq = replace(log, events=log.events.withColumn("seq", F.when(F.col("activity") == "First", 1).otherwise(F.lit(2))))
    assert tables.insert(by_seq, folder)["events"] == 1
    assert {r.eid: r.activity for r in tables.read(spark, folder).events.collect()} == {"e0": "Old", "e1": "First"}
    other = str(tmp_path / "u")
    tables.write(small_log(spark, [("e0", "Old", 9, {})]), other)
    assert tables.insert(log, other)["events"] == 1  # without an order of ingest the earliest is the first
    assert {r.eid: r.activity for r in tables.read(spark, other).events.collect()} == {"e0": "Old", "e1": "Early"}
    assert all(n == 0 for n in tables.insert(log, other).values())


def test_an_insert_reads_the_folders_of_its_keys(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.write(small_log(spark, [(f"e{k}", "A", 60 * k, {}) for k in range(3_000)]), folder)
    new = small_log(spark, [("x1", "A", 5, {}), ("e7", "A", 5, {})])
    there = tables.keys_there(spark, folder, "events", new.events)
    stored = spark.read.parquet(f"{folder}/events")
    plan = there.select("eid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<eid:string>" in plan
    share = there.count() / stored.count()
    assert share <= 3 / tables.BUCKETS and stored.select("bucket").distinct().count() == tables.BUCKETS
    gained = tables.insert(new, folder)
    assert (gained["events"], tables.read(spark, folder).events.count()) == (1, 3_001)


def test_values_of_a_log_are_found(spark):
    log = small_log(spark, [(f"e{k}", "Ship", 60 * k, {"note": "zebra" if k == 7 else f"n{k}", "lane": str(k % 3)}) for k in range(2_000)])
    changes = spark.createDataFrame([("o7", "Order", None, None, {"colour": "crimson"})], "oid string, otype string, ts timestamp, changed_field string, attrs map<string,string>")
    o2o = spark.createDataFrame([("o7", "o3", "follows")], "src_oid string, tgt_oid string, qualifier string")
    log = replace(log, changes=changes, o2o=o2o)
    chunks = search.chunks(log).cache()
    found = lambda q: [r.id for r in search.bm25(chunks, q, None).collect()]
    assert len(found("zebra")) == len(found("e7")) == 1 and found("zebra") == found("e7") and found("zebra")[0].startswith("events_")
    assert len(found("crimson")) == 1 and found("crimson")[0].startswith("objects_Order")
    assert [r.id for r in search.phrase(chunks, "note n7", None).collect()] == []  # zebra is there in its place
    text = chunks.filter(F.col("id") == found("zebra")[0]).first().content
    assert text.startswith("time: 1970-01-01") and "activities: Ship " in text and "\nnote: " in text and "zebra 1" in text
    assert chunks.groupBy("chunk_type").agg(F.sum("n").alias("n")).filter("chunk_type = 'events'").first().n == 2_000
    few = search._told(spark.createDataFrame([(1, "a", f"v{k % 50}") for k in range(200)] + [(1, "b", "x"), (2, "b", None)], "k int, label string, value string"), ["k"], 20, 3)
    (line,) = few.collect()
    a, b = line.content.split("\n")
    assert a.startswith("a: 50 values, such as ") and a.count(",") == 3 and b == "b: x 1"


def test_chunks_that_share_an_id(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "red fox runs", "events"), ("1", "fox red", "objects"), ("2", "red fox", "objects"), ("3", "red and fox", "events"), (None, "red fox", "events")], "id string, content string, chunk_type string")
    index = search.Index.build(chunks, str(tmp_path / "i"))
    for found in (search.phrase(chunks, "red fox", None), index.phrase("red fox", None)):
        assert sorted((r.id is None, r.id or "") for r in found.collect()) == [(False, "1"), (False, "2"), (True, "")]
    pairs = lambda df: sorted((str(r.id), r.score) for r in df.collect())
    assert pairs(search.bm25(chunks, "red fox", None)) == pairs(index.bm25("red fox", None)) and len(pairs(index.bm25("red fox", None))) == 5
    assert pairs(search.hybrid(chunks, "red fox", 9)) == pairs(index.hybrid("red fox", 9))
    assert index.info()["chunks"] == 5


def test_a_graph_kept_by_inserts(spark, tmp_path):
    """After any inserts it is that of all events: new events fall between old ones, come twice, and share pairs over objects."""
    import random

    from objectlog.operators import maintained, traces

    rnd, folder = random.Random(3), str(tmp_path / "g")
    rows = [(f"e{k}", rnd.choice("abc"), rnd.randrange(4_000_000), [f"o{rnd.randrange(9)}" for _ in range(rnd.choice([1, 2, 3]))]) for k in range(150)]
    rnd.shuffle(rows)

    def part(some):
        events = spark.createDataFrame([(e, a, t) for e, a, t, _ in some], "eid string, activity string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        e2o = spark.createDataFrame([(e, o, "A" if o < "o5" else "B", None) for e, _, _, os_ in some for o in os_], "eid string, oid string, otype string, qualifier string")
        return ObjectLog.of(events, e2o.select("oid", "otype").distinct(), e2o)

    maintained.create(spark, folder)
    assert maintained.dfg(spark, folder).count() == 0
    edges = lambda df: sorted(tuple(r) for r in df.select("otype", "src", "tgt", "frequency").collect())
    for upto, some in ((90, rows[:90]), (120, rows[80:120]), (150, rows[120:]), (150, rows[:10])):
        gained = maintained.insert(part(some), folder)
        assert edges(maintained.dfg_by_type(spark, folder)) == edges(traces.dfg_by_type(part(rows[:upto])))
    assert gained == 0
    # What an insert that has not finished wrote does not count.
    spark.createDataFrame([("A", "x", "y", 7, "lost")], maintained.SCHEMAS["edges"]).write.mode("append").parquet(f"{folder}/edges")
    assert edges(maintained.dfg_by_type(spark, folder)) == edges(traces.dfg_by_type(part(rows)))
