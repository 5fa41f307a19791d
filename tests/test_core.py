"""The mini log's hand-computed answers, round trips, validators, search, tools, nets and streams."""

import json

import pytest

from objectlog.functions import scalars
from objectlog.log import ObjectLog
from objectlog.operators import filters, petri, search, setops, stats, traces, validate
from objectlog.plans.cursor import Models
from objectlog.plans.tools import TOOLS, Tools
from objectlog.sources import json_log, tables
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_filters(mini):
    assert [r.eid for r in filters.lifecycle(mini, "o1").collect()] == ["e1", "e2", "e3"]
    assert rows(filters.between(mini, "2024-01-01T10:00:00", "2024-01-01T11:30:00Z"), "eid") == [("e2",), ("e5",)]
    assert rows(filters.by_object_type(mini, "Item"), "eid") == [("e2",), ("e3",)]
    with pytest.raises(filters.UnknownValue):
        filters.by_activity(mini, "Nope", strict=True)
    assert filters.by_activity(mini, "ship").count() == 0
    ref = {r.event_id: r for r in filters.references(mini).collect()}
    assert ref["e1"].hash == "efcb5bab9cfc8e11a315e6a7ef0b99be6cddaa323e436369a90cdd097149ce61"
    assert ref["e6"].involved_objects == [] and ref["e1"].involved_objects[0].role is None


def test_statistics(mini):
    assert rows(stats.by_object_type(mini), "otype", "count") == [("Item", 3), ("Order", 2), ("User", 1)]
    assert rows(stats.anomalies(mini), "anomaly_type", "affected_id", "severity") == [("event_no_objects", "e6", "high"), ("orphaned_object", "i3", "medium")]
    got = [(r.activity, r["count"], r.sample_ids) for r in stats.activity_frequency(mini).collect()]
    assert got == [("OrderPlaced", 2, ["e1", "e4"]), ("Ship", 2, ["e3", "e5"]), ("Note", 1, ["e6"]), ("Pick", 1, ["e2"])]


@pytest.mark.parametrize("span", [600, 5_400, 10**9])
def test_pairs_agree_for_any_span(mini, span):
    got = rows(traces.pairs(mini, span=span), "oid", "e1", "e2")
    assert got == [("c1", "e1", "e4"), ("i1", "e2", "e3"), ("i2", "e2", "e3"), ("o1", "e1", "e2"), ("o1", "e2", "e3"), ("o2", "e4", "e5")]
    assert rows(traces.positions(mini, "Order", span), "oid", "eid", "pos") == [("o1", "e1", 0), ("o1", "e2", 1), ("o1", "e3", 2), ("o2", "e4", 0), ("o2", "e5", 1)]


def test_traces(mini):
    assert rows(traces.dfg(mini), "src", "tgt", "frequency") == [("OrderPlaced", "OrderPlaced", 1), ("OrderPlaced", "Pick", 1), ("OrderPlaced", "Ship", 1), ("Pick", "Ship", 2)]
    assert rows(traces.start_activities(mini), "activity", "frequency") == [("OrderPlaced", 3), ("Pick", 1)]
    assert rows(traces.variants(mini), "sequence", "frequency") == [("OrderPlaced → OrderPlaced", 1), ("OrderPlaced → Pick → Ship", 1), ("OrderPlaced → Ship", 1), ("Pick → Ship", 2)]
    perf = {(r.src, r.tgt): r for r in traces.performance(mini).collect()}
    assert perf["Pick", "Ship"]["count"] == 3 and perf["Pick", "Ship"].mean_s == 7200 and perf["Pick", "Ship"].std_s == 0
    assert sum(r["count"] for r in perf.values()) == 6
    assert rows(traces.bottlenecks(mini), "src", "severity") == [("OrderPlaced", "medium"), ("Pick", "medium")]
    assert rows(traces.interactions(mini), "type1", "type2", "count") == [("Item", "Item", 6), ("Item", "Order", 4), ("Order", "Order", 5), ("Order", "User", 2), ("User", "User", 2)]
    assert rows(traces.handovers(mini, "resource"), "src", "tgt", "weight") == [("alice", "bob", 1), ("alice", "carol", 1)]
    assert traces.conformance(mini).first().fitness == 1.0 and traces.deviations(mini).count() == 0
    strict = traces.dfg(mini).filter("src = 'Pick'")
    assert rows(traces.deviations(mini, strict), "oid", "pos", "tgt") == [("c1", 0, "OrderPlaced"), ("o1", 0, "Pick"), ("o2", 0, "Ship")]


def test_sets(mini):
    a = filters.references(mini, filters.by_activity(mini, "Ship"))
    b = filters.references(mini, filters.lifecycle(mini, "o1"))
    assert rows(setops.intersect(a, b), "event_id") == [("e3",)]
    assert rows(setops.union(a, b), "event_id") == [("e1",), ("e2",), ("e3",), ("e5",)]
    assert rows(setops.difference(a, b), "event_id") == [("e5",)]


def test_round_trips(spark, mini, tmp_path):
    path = str(tmp_path / "log.json")
    json_log.write_document(mini, path)
    back = json_log.read(spark, path)
    assert validate.validate(spark.read.text(path, wholetext=True), back).count() == 0
    assert rows(back.events, "eid", "activity", "ts") == rows(mini.events, "eid", "activity", "ts")
    assert rows(back.e2o, "eid", "oid", "otype") == rows(mini.e2o, "eid", "oid", "otype")
    assert {r.eid: r.attrs for r in back.events.collect()} == {r.eid: r.attrs for r in mini.events.collect()}
    assert set(json_log.read_schema(spark, path)["objects"]) == {"Order", "Item", "User"}
    assert sum(map(len, json_log.event_batches(mini, 4))) == 6
    tables.write(mini, str(tmp_path / "t"))
    assert rows(traces.dfg(tables.read(spark, str(tmp_path / "t"))), "src", "tgt", "frequency") == rows(traces.dfg(mini), "src", "tgt", "frequency")
    with pytest.raises(ValueError):
        tables.export_sqlite(mini, str(tmp_path / "x.db"))
    linked = mini.with_events(mini.events.filter("eid <> 'e6'"))
    tables.export_sqlite(linked, str(tmp_path / "y.db"))
    assert rows(tables.import_sqlite(spark, str(tmp_path / "y.db")).events, "eid", "activity", "ts") == rows(linked.events, "eid", "activity", "ts")


def test_syntax_errors(spark):
    bad = {"eventTypes": [{"attributes": [{"name": "x"}]}], "objectTypes": {}, "events": [{"id": "e", "attributes": [{"name": "a"}], "relationships": [{"objectId": "o"}]}]}
    found = {r.code for r in validate.syntax(spark.createDataFrame([(json.dumps(bad),)], "value string")).collect()}
    assert found == {"missing_key", "not_a_list", "missing_name", "malformed_attribute", "malformed_relationship"}


def test_semantic_errors(spark, mini):
    from dataclasses import replace

    twice = mini.events.unionByName(mini.events.limit(1)).unionByName(spark.createDataFrame([(None, "New", None, None)], mini.events.schema))
    arcs = mini.e2o.unionByName(spark.createDataFrame([("e1", "zz", "Order", None), ("zz", "o1", "Order", None)], mini.e2o.schema))
    links = spark.createDataFrame([("o1", "qq", "x")], "src_oid string, tgt_oid string, qualifier string")
    changes = spark.createDataFrame([("o1", "Order", None, None, {"a": "1"})], mini.changes.schema)
    found = {r.code for r in validate.semantics(replace(mini, events=twice, e2o=arcs, o2o=links, changes=changes)).collect()}
    assert found == {"missing_event_id", "duplicate_event_id", "undeclared_event_type", "dangling_event_object", "dangling_event", "dangling_object_object", "attribute_without_time"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    c = one(scalars.conventional_commit(F.lit("fix: y\n\nBREAKING CHANGE: z, Fixes #12 and #7, #12")))
    assert (c.commit_type, c.is_breaking, c.subject, c.issues) == ("fix", True, "y", [12, 7])
    assert one(scalars.conventional_commit(F.lit("Merge z"))).commit_type == "other"
    assert [one(scalars.release_kind(F.lit(t))) for t in ("v1.0.0", "1.2.0", "1.2.3-rc1", "nightly")] == ["major", "minor", "patch", "other"]
    assert one(scalars.make_id(F.lit("a/b"), F.lit("Issue"), F.lit(" x:1 y "))) == "a_b_issue_x1_y" and one(scalars.make_id(F.lit("a"), F.lit("b"), F.lit(" "))) is None
    assert [one(scalars.safe_timestamp(F.lit(t))) for t in ("2024-01-01T00:00:00", None)] == ["2024-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert one(scalars.duration_s(F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-01T00:00:00Z"))) == 0.0
    assert one(scalars.duration_s(F.lit("0001-01-01T00:00:00Z"), F.lit("2024-01-01T00:00:00Z"))) is None


def test_search(spark, mini):
    c = spark.createDataFrame([("a", "Été_1 the cat", "x"), ("b", "the the cat sat", "y"), ("c", None, "x")], "id string, content string, chunk_type string")
    assert [r.id for r in search.bm25(c, "sat").collect()] == ["b"] and [r.id for r in search.phrase(c, "The cat").collect()] == ["b", "a"]
    assert rows(search.phrase(c, "the the"), "id") == [("b",)]
    assert rows(search.bm25(c, "été_1"), "id") == [("a",)] and search.bm25(c, "!!").count() == 0
    assert rows(search.search(c, "cat", 5, ["y"], "hybrid"), "id") == [("b",)]
    assert rows(search.inverted_index(c).filter("term = 'the'"), "id", "tf") == [("a", 1), ("b", 2)]
    assert {r.chunk_type for r in search.chunks(mini).collect()} == {"event_types", "object_types", "events", "objects"}


def test_stored_index(spark, tmp_path):
    """The stored index answers as the scan does, and reads only the buckets of the query's terms."""
    words = "the cat sat on a mat while an été_1 dog ran".split()
    c = spark.createDataFrame([(f"c{k}", " ".join(words[(k * j) % len(words)] for j in range(1, 3 + k % 7)), "xy"[k % 2]) for k in range(60)] + [("none", None, "x")], "id string, content string, chunk_type string")
    index = search.Index.build(c, str(tmp_path / "index"), buckets=8)
    for text in ("the cat", "a", "cat sat on", "été_1 dog", "nothing here", "!!", "cat cat"):
        for types in (None, ["y"]):
            for mode in ("bm25", "phrase", "hybrid"):
                assert index.search(text, 5, types, mode).collect() == search.search(c, text, 5, types, mode).collect(), (text, types, mode)
    plan = index.bm25("cat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.info() == {"strategy": "phrase", "size_mb": 0.0, "chunks": 61, "indexed": True}
    assert [search.strategy(n) for n in (0, 5_000_000, 100_000_001)] == ["phrase", "hybrid", "bm25"] and search.strategy(0, "bm25") == "bm25"


def test_medians(spark):
    """Exact medians of few, many, odd, even, equal and null-named rows."""
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {"one": [5], "two": [1, 4], "equal": [7] * 999, "odd": rng.integers(-1_000, 10**12, 30_001).tolist(), "even": rng.integers(0, 50, 20_000).tolist(), None: [3, 9, 11, 100]}
    timed = spark.createDataFrame([(k, None, v) for k, g in groups.items() for v in g], "src string, tgt string, us long")
    found = timed.groupBy("src", "tgt").agg(F.count("*").alias("count"), F.percentile_approx("us", [0.499, 0.501], 10_000).alias("about"))
    assert {r.src: r.median for r in traces.medians(timed, found).collect()} == {k: float(np.median(g)) for k, g in groups.items()}


def test_incremental_insert(spark, mini, tmp_path):
    """A second write adds what is new, first writes stay, new attributes become columns."""
    from dataclasses import replace

    folder = str(tmp_path / "log")
    tables.write(mini, folder)
    first = tables.read(spark, folder)
    assert all(n == 0 for n in tables.insert(replace(mini, events=mini.events.join(mini.e2o.select("eid"), "eid", "left_semi")), folder).values())
    row = spark.createDataFrame([("e1", "Changed", {"x": "1"}), ("e9", "Return", {"reason": "late"})], "eid string, activity string, attrs map<string,string>").withColumn("ts", F.to_timestamp(F.lit("2024-02-01T00:00:00Z")))
    more = ObjectLog.of(row, spark.createDataFrame([("o9", "Order"), ("o1", "Other")], "oid string, otype string"), spark.createDataFrame([("e1", "o1", "Order", None), ("e9", "o9", "Order", "of")], "eid string, oid string, otype string, qualifier string"))
    gained = tables.insert(more, folder)
    assert (gained["events"], gained["objects"], gained["e2o"]) == (1, 1, 1)
    now = tables.read(spark, folder)
    assert now.events.count() == first.events.count() + 1 and {r.activity for r in now.events.filter("eid = 'e1'").collect()} == {"OrderPlaced"}
    assert tables.wide(now.events, "activity", "Return", ["reason"]).first().reason == "late" and {r.otype for r in now.objects.filter("oid = 'o1'").collect()} == {"Order"}
    with pytest.raises(ValueError):
        tables.insert(replace(more, e2o=more.e2o.limit(0)), folder)


def test_models_are_kept_by_log(mini):
    models, made = Models(most=2), []
    make = lambda: made.append(1) or len(made)
    assert models.get(mini, "a", make) == models.get(mini, "a", make) == 1
    assert models.get(mini.of_type("Order"), "a", make) == 2 and models.get(mini, "b", make) == 3 and len(models) == 2
    assert models.get(mini, "a", make) == 4  # the one used longest ago had gone


def test_schema_by_argument_or_environment(spark, mini, tmp_path, monkeypatch):
    monkeypatch.delenv("OBJECT_LOG_FILE", raising=False)
    with pytest.raises(ValueError):
        json_log.read_schema(spark)
    json_log.write_document(mini, str(tmp_path / "log.json"))
    monkeypatch.setenv("OBJECT_LOG_FILE", str(tmp_path / "log.json"))
    assert json_log.read_schema(spark) == json_log.read_schema(spark, str(tmp_path / "log.json")) and json_log.located("x") == "x"


def test_nets(mini):
    nets = petri.discover(mini)
    assert set(nets) == {"Order", "Item", "User"} and petri.summary(nets)["nets_count"] == 3
    for net in nets.values():
        names = {n for n, _ in net.transitions}
        assert all((a in names) != (b in names) for a, b in net.arcs)
        assert all(any(a == p for a, _ in net.arcs) for p in net.places if p != "sink") and all(any(b == p for _, b in net.arcs) for p in net.places if p != "source")
    assert str(petri.mine({"a", "b", "c"}, {("a", "b"), ("b", "c"), ("a", "c")}, {"a"}, {"c"})) == "seq(a, xor(tau, b), c)"
    assert str(petri.mine({"a", "b"}, {("a", "b"), ("b", "a")}, {"a", "b"}, {"a", "b"})) == "and(a, b)"
    assert str(petri.mine({"a", "b"}, {("a", "b"), ("b", "a")}, {"a"}, {"a"})) == "loop(a, b)"


def accepts(net, trace):
    """Whether a net can play a trace from its source to its sink, by search over markings."""
    ins, outs, label = {}, {}, dict(net.transitions)
    for a, b in net.arcs:
        (ins.setdefault(b, []) if b in label else outs.setdefault(a, [])).append(a if b in label else b)
    start = (("source", 1),)
    seen, todo = {(0, start)}, [(0, start)]
    while todo:
        at, marking = todo.pop()
        if at == len(trace) and marking == (("sink", 1),):
            return True
        have = dict(marking)
        for t, name in label.items():
            if all(have.get(p, 0) > 0 for p in ins[t]) and (name is None or (at < len(trace) and trace[at] == name)):
                after = dict(have)
                for p in ins[t]:
                    after[p] -= 1
                for p in outs[t]:
                    after[p] = after.get(p, 0) + 1
                state = (at + (name is not None), tuple(sorted((p, n) for p, n in after.items() if n)))
                if state not in seen and all(n <= 3 for _, n in state[1]):
                    seen.add(state)
                    todo.append(state)
    return False


def test_nets_play_their_logs():
    """Logs played at random from process trees: the net mined from their directly-follows graph plays every trace."""
    import random

    rng = random.Random(5)

    def tree(names, depth):
        if len(names) == 1:
            return names[0]
        op, cut = rng.choice(["seq", "xor", "and"]), rng.randint(1, len(names) - 1)
        return (op, tree(names[:cut], depth + 1), tree(names[cut:], depth + 1))

    def play(t):
        if isinstance(t, str):
            return [t]
        a, b = t[1], t[2]
        if t[0] == "seq":
            return play(a) + play(b)
        if t[0] == "xor":
            return play(rng.choice([a, b]))
        x, y, out = play(a), play(b), []
        while x or y:
            out.append((x if x and (not y or rng.random() < 0.5) else y).pop(0))
        return out

    for _ in range(60):
        t = tree(list("abcdef")[: rng.randint(1, 6)], 0)
        log = [play(t) for _ in range(300)]
        edges = {(a, b) for x in log for a, b in zip(x, x[1:])}
        net = petri.net_of(petri.mine({a for x in log for a in x}, edges, {x[0] for x in log}, {x[-1] for x in log}))
        assert all(accepts(net, x) for x in set(map(tuple, log))), t


def test_tools(mini):
    t = Tools(mini)
    assert len(TOOLS) >= 24 and len(t.call("list_available_tools")["tools"]) == len(TOOLS)
    a = t.call("trace_object_lifecycle", object_id="o1")["cursor_id"]
    b = t.call("filter_by_event_type", event_type="Ship", input_cursor_id=a)["cursor_id"]
    assert t.call("get_total_from_cursor_id", cursor_id=b) == {"total": 1}
    u = t.call("union_cursors", cursor_id_1=a, cursor_id_2=b)["cursor_id"]
    assert t.call("get_summary_from_cursor_id", cursor_id=u)["count"] == 3
    assert t.call("get_timerange_by_cursor_id", cursor_id=u)["seconds"] == 10_800
    assert "error" in t.call("trace_object_lifecycle", object_id="none") and "error" in t.call("nope") and "error" in t.call("get_cursor_results", cursor_id="x")
    assert t.call("discover_dfg", include_visualization=True)["dot"].startswith("digraph")
    assert t.call("discover_petri_net", object_type="Item", include_visualization=True)["nets_count"] == 1
    assert t.call("check_conformance")["rows"][0]["fitness"] == 1.0
    assert t.call("search_ocel", query="Pick")["rows"] and t.call("discover_social_network", resource_attribute="resource")["rows"]
    assert "error" in t.call("discover_social_network", resource_attribute="zzz")


def test_stream(spark, mini, tmp_path):
    from objectlog.streaming.pairs import stream_pairs

    src = str(tmp_path / "in")
    traces.trace(mini).select("otype", "oid", "eid", "activity", "ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("otype string, oid string, eid string, activity string, ts timestamp").parquet(src)
    q = stream_pairs(stream).writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("pairs_out"), "oid", "e1", "e2") == rows(traces.pairs(mini), "oid", "e1", "e2")


def test_inverted_index_covers_both_tables(spark, tmp_path):
    """The registered query against brute force; rows that share an id are one chunk."""
    import re
    from collections import defaultdict

    from objectlog.plans.queries import QUERIES

    docs = [(1, "Été_1 the cat the"), (2, ""), (3, None), (4, "The cat"), (4, "the dog, the"), (None, "no id"), (None, "id id")]
    bench = [(1, "the cat 3"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = defaultdict(list)
    for letter, kind, table in (("d", "documents", docs), ("b", "benchmark", bench)):
        for i, text in table:
            for pos, term in enumerate(re.findall(r"\w+", (text or "").lower())):
                want[term, None if i is None else f"{letter}{i}", kind].append(pos)
    got = {(r.term, r.id, r.chunk_type): (r.tf, r.positions) for r in QUERIES["inverted_index"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), ",".join(map(str, sorted(v)))) for k, v in want.items()}


def test_top_variants_with_many_ties(spark):
    """Far more variants of one frequency than the limit: the first by sequence stay, however long the others are."""
    from objectlog.log import ObjectLog

    traces_ = {f"z{k:03d}": ["b"] * 3 + [f"x{k:03d}"] for k in range(150)} | {"zz1": ["a"], "zz2": ["a", "c"], "y1": ["q"], "y2": ["q"]}
    events = [(f"{o}-{i}", a, o, i) for o, acts in traces_.items() for i, a in enumerate(acts)]
    df = spark.createDataFrame(events, "eid string, activity string, oid string, at long").withColumn("ts", F.timestamp_seconds("at")).withColumn("otype", F.lit("T")).withColumn("qualifier", F.lit(None).cast("string"))
    log = ObjectLog.of(df.select("eid", "activity", "ts"), df.select("oid", "otype").distinct(), df.select("eid", "oid", "otype", "qualifier"))
    want = [("q", 2), ("a", 1), ("a → c", 1), ("b → b → b → x000", 1), ("b → b → b → x001", 1)]
    assert [(r.sequence, r.frequency) for r in traces.variants(log, limit=5).orderBy("variant_id").collect()] == want
    assert [r.variant_id for r in traces.variants(log, limit=3).orderBy("variant_id").collect()] == [1, 2, 3] and traces.variants(log, limit=1_000).count() == 153


def test_value_summary_of_all_attributes(spark, tmp_path):
    """The registered query against brute force: `user` has over 20 values, so its ten most frequent ones, ties by value."""
    from collections import Counter

    from objectlog.plans.queries import QUERIES

    events = [(n, ["view", "click"][n % 2], n, None if n % 11 == 0 else n % 30 if n < 90 else 7 + n % 3, '{"k": 1}') for n in range(120)]
    spark.createDataFrame(events, "event_id long, event_type string, at long, user_id long, props string").withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for name, values in (("kind", [e[1] for e in events]), ("user", [f"u{e[3]}" for e in events if e[3] is not None])):
        c = Counter(values)
        kept = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: len(c) if len(c) <= 20 else 10]
        want[name] = (len(c), ",".join(f"{v}={n}" for v, n in sorted(kept)))
    assert want["user"][0] > 20
    assert {r.attribute: (r.distinct_values, r.histogram) for r in QUERIES["value_summary"](spark, str(tmp_path)).collect()} == want
