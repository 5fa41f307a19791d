"""Work that grows no faster than the tables: what is shuffled, how it is dealt, and the same results either way."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from objectlog.log import ObjectLog
from objectlog.operators import crowds, overlap, search, traces
from objectlog.sources import mappers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shared(spark):
    """Events of several objects of a type, repeated relations, a repeated event, events without a time."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    events = [(f"e{i}", "AB"[i % 2], None if i % 17 == 0 else start + timedelta(days=rng.randrange(200))) for i in range(120)]
    events.append(("e3", "B", start + timedelta(days=300)))
    rel = [(f"e{i}", f"{t[0]}{rng.randrange(4)}", t, None) for i in range(120) for t in ("X", "Y") for _ in range(rng.randrange(4))]
    return events, rel, ObjectLog.of(spark.createDataFrame(events, "eid string, activity string, ts timestamp"), spark.createDataFrame(sorted({(o, t) for _, o, t, _ in rel}), "oid string, otype string"), spark.createDataFrame(rel, "eid string, oid string, otype string, qualifier string"))


def brute_pairs(events, rel):
    out = []
    for otype, oid in {(t, o) for _, o, t, _ in rel}:
        mine = {e for e, o, t, _ in rel if (t, o) == (otype, oid)}
        row = sorted((x for x in events if x[0] in mine), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        out += [(otype, a[1], b[1], a[0], b[0]) for a, b in zip(row, row[1:], strict=False)]
    return out


@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_pairs_are_the_same_in_spans_and_whole(shared, monkeypatch, most):
    events, rel, log = shared
    monkeypatch.setattr(crowds, "CROWD", most)
    want = brute_pairs(events, rel)
    got = [tuple(r) for r in traces.pairs(log).select("otype", "src", "tgt", "e1", "e2").collect()]
    assert Counter(got) == Counter(want)
    assert {(r.src, r.tgt): r.frequency for r in traces.dfg(log).collect()} == Counter(x[1:3] for x in set(want))
    assert {(r.otype, r.src, r.tgt): r.frequency for r in traces.dfg_by_type(log).collect()} == Counter(x[:3] for x in set(want))


def test_relations_are_shuffled_once_before_their_join(shared):
    """Formerly once to be made distinct and once more to meet their events."""
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan(traces.trace(shared[2])))
    assert len(dealt) == 2 and all(re.fullmatch(r"eid#\d+", x) for x in dealt)


def test_pairs_that_no_other_object_can_have_are_not_told_apart(spark):
    """Formerly every pair of events was shuffled to be made distinct."""
    rows = spark.range(400).select(F.concat(F.lit("e"), "id").alias("eid"), F.lit("A").alias("activity"), F.timestamp_seconds("id").alias("ts"))
    log = ObjectLog.of(rows, rows.limit(0).select(F.col("eid").alias("oid"), F.col("activity").alias("otype")), rows.select("eid", F.concat(F.lit("o"), F.substring("eid", -1, 1)).alias("oid"), F.lit("O").alias("otype"), F.lit("q").alias("qualifier")))
    got = traces.dfg(log)
    assert [tuple(r) for r in got.collect()] == [("A", "A", 390)]
    assert not re.search(r"keys=\[otype#\d+, src#\d+, tgt#\d+, e1#\d+, e2#\d+\]", plan(got))


@pytest.mark.parametrize(("share", "crowd"), [(64, 10_000), (3, 10_000), (64, 20), (0, 1)])
def test_keyed_overlaps_are_the_same_in_bins_and_at_their_keys(spark, monkeypatch, share, crowd):
    rng = random.Random(3)
    monkeypatch.setattr(overlap, "SHARED", share)
    monkeypatch.setattr(crowds, "CROWD", crowd)
    make = lambda n: [(i, rng.choice([None, 1, 1, 2, 3, 4]), s := rng.randrange(1_000), s + rng.choice([0, 1, 5, 300, -1])) for i in range(n)]
    left, right = make(60), make(80)
    df = lambda rows: spark.createDataFrame(rows, "i int, k int, s long, e long").select("i", "k", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    got = overlap.overlapping(df(left), df(right), ["k"]).select("a.i", F.col("b.i").alias("j")).collect()
    want = [(a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]]
    assert Counter(map(tuple, got)) == Counter(want)


def test_rows_of_keys_with_few_rows_are_not_repeated_in_bins(spark):
    """Formerly each point visited all widths of bins in which intervals of the other side were at home."""
    days = lambda c: F.timestamp_seconds(c * 86_400)
    a = spark.range(300).select(F.col("id").alias("k"), days(F.lit(0)).alias("start"), days(F.col("id") % 100).alias("end"))
    b = spark.range(300).select(F.col("id").alias("k"), days(F.lit(0)).alias("start"), days(F.lit(0)).alias("end"))
    found = overlap.overlapping(a, b, ["k"])
    assert found.count() == 300
    joined = re.search(r"Join \[k0#\d+L\], \[k0#\d+L\], Inner", plan(found))
    assert joined and "bin#" not in plan(found)[: joined.start()]


def test_an_index_is_built_without_a_copy_of_its_postings(spark, monkeypatch, tmp_path):
    """Formerly all postings were written once and joined to the lengths of their chunks before the index was written."""
    from objectlog.operators import search

    names, stage = [], search.staged
    monkeypatch.setattr(search, "staged", lambda df, name: names.append(name) or stage(df, name))
    chunks = spark.createDataFrame([("a", "red red fox", "t"), ("a", "fox of the hill", "t"), ("b", "the fox", "t"), ("c", None, "t"), ("a", "red", "u"), (None, "the red hill", "t")], "id string, content string, chunk_type string")
    for k, most in enumerate((100, 0)):
        monkeypatch.setattr(search, "MERGED", most)
        index = search.Index.build(chunks, str(tmp_path / str(k)))
        assert {tuple(r) for r in index.postings.select("id", "chunk_type", "dl").distinct().collect()} == {("a", "t", 7), ("b", "t", 2), ("a", "u", 1), (None, "t", 3)}
        said = index.totals.first()
        assert (said.n, said.avgdl, said.bytes) == (5, 13 / 5, 48)
    assert "postings" not in names


def test_rows_of_a_frequent_key_meet_by_broadcast(spark):
    """Formerly all links to one object, such as the repository, went to one task."""
    rows = spark.createDataFrame([("r", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3), ("gone", 4)] + [("lost", i) for i in range(20)], "oid string, i int")
    known = spark.createDataFrame([("r", "R"), ("a", "A"), ("b", "B"), ("c", "C")], "oid string, otype string")
    for most in (1, 10, 1_000):
        for how in ("inner", "left_semi"):
            assert Counter(map(tuple, crowds.met(rows, known, "oid", how, most).collect())) == Counter(map(tuple, rows.join(known, "oid", how).collect()))
    assert plan(crowds.met(rows, known, "oid", most=10)).count("BroadcastHashJoin") >= 2


def _chunk(n=50):
    import pyarrow as pa

    texts = [" ".join(f"w{i}x{j} w{i % 7}y{j} the" for j in range(40)).encode() for i in range(n)]
    return pa.record_batch([pa.array([*range(n)], pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])


def test_words_travel_by_the_chunk():
    """Formerly a row for each document and word, each with the 16 bytes that tell documents apart."""
    from objectlog.llm import tokens

    (sent,) = list(tokens.chunked(iter([_chunk()]), {b"the": 1}, 3, 0))
    pairs = 50 * 80
    assert sent.num_rows <= 1 + 3 + pairs // tokens.MESSAGE
    assert len(b" ".join(x for x in sent["words"].to_pylist() if x).split()) == 50 * 40 + 7 * 40  # each distinct word once
    (first,) = [r for r in sent.to_pylist() if r["messages"] is not None]
    assert first["messages"] == sent.num_rows - 1 and first["ids"] == [*range(50)] and first["known"] == [40] * 50


def test_a_chunk_that_lacks_rows_is_an_error():
    import pyarrow as pa

    from objectlog.llm import tokens

    (sent,) = list(tokens.chunked(iter([_chunk()]), {}, 3, 0))
    assert sum(b.num_rows for b in tokens.summed(iter([sent]))) == 50
    for lost in (0, sent.num_rows - 1):
        kept = pa.Table.from_batches([sent]).filter(pa.array([i != lost for i in range(sent.num_rows)])).to_batches()
        with pytest.raises(RuntimeError, match="another order"):
            list(tokens.summed(iter(kept)))


def test_rows_are_dealt_over_more_tasks_as_their_files_grow(spark, tmp_path, monkeypatch):
    """Formerly the number of tasks was fixed, and a task of an insert into the maintained graph held ever more."""
    from objectlog.operators import maintained

    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert crowds.tasks(files) == 0 and crowds.tasks(spark.createDataFrame([(1,)], "a int")) == 0
    monkeypatch.setattr(crowds, "SHARE", 20_000)
    one, two = crowds.tasks(files), crowds.tasks(files, files)
    assert two > one > spark.sparkContext.defaultParallelism
    assert crowds.dealt(files, "id").rdd.getNumPartitions() == one
    events = files.select(F.col("id").cast("string").alias("eid"), F.lit("A").alias("activity"), F.timestamp_seconds("id").alias("ts")).filter("id < 300")
    e2o = events.select("eid", F.concat(F.lit("o"), F.substring("eid", -1, 1)).alias("oid"), F.lit("O").alias("otype"), F.lit("q").alias("qualifier"))
    log = ObjectLog.of(events, e2o.select("oid", "otype").distinct(), e2o)
    assert "REPARTITION_BY_NUM" in plan(traces.pairs(log))
    monkeypatch.setattr(crowds, "SHARE", 500_000)
    folder = str(tmp_path / "kept")
    maintained.create(spark, folder)
    assert maintained.insert(log, folder) == 300 and maintained.insert(log, folder) == 0
    assert [tuple(r) for r in maintained.dfg(spark, folder).collect()] == [("A", "A", 290)]


@pytest.mark.parametrize("most", [0, 10_000])
def test_values_as_of_are_the_same_in_spans_and_whole(spark, monkeypatch, most):
    """Formerly every row was shuffled into a span and once more to meet what the spans before it had set."""
    from objectlog.operators import history

    monkeypatch.setattr(crowds, "CROWD", most)
    rng = random.Random(9)
    events = [(i, rng.choice([None, "a", "b"]), rng.choice([None, *range(200)])) for i in range(80)]
    changes = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(200)]), i, rng.choice([None, "x", "y", "z"])) for i in range(40)]
    at = F.timestamp_seconds("s").alias("ts")
    e, c = spark.createDataFrame(events, "i int, k string, s int").select("i", "k", at), spark.createDataFrame(changes, "k string, s int, o int, v string").select("k", at, "o", "v")
    got = history.as_of(e, c, ["k"], ["v"], ["o"], 20)
    want = []
    for i, k, s in events:
        before = sorted(((t is not None, t or 0, o), v) for q, t, o, v in changes if q == k and v and s is not None and (t is None or t <= s))
        want.append((i, before[-1][1] if before else None))
    assert Counter((r.i, r.v) for r in got.collect()) == Counter(want)
    assert "_v0" not in plan(got)


def test_chunks_are_told_by_tasks_that_grow_with_their_files(spark, tmp_path, monkeypatch):
    """Formerly each label's values were counted twice and joined, in a number of tasks that was fixed. Some events
    have no objects, no attributes or no time."""
    at = F.when(F.col("id") % 7 != 0, F.timestamp_seconds(F.col("id") * 10))
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    attrs = F.when(F.col("id") % 5 != 0, F.create_map(F.lit("by"), F.concat(F.lit("u"), F.col("id") % 3), F.lit("none"), F.lit(None).cast("string")))
    events = kept(spark.range(900).select(F.concat(F.lit("e"), "id").alias("eid"), F.concat(F.lit("A"), F.col("id") % 2).alias("activity"), at.alias("ts"), attrs.alias("attrs")), "events")
    links = spark.range(4_000).select(F.concat(F.lit("e"), F.col("id") % 600 + 1).alias("eid"), F.concat(F.lit("o"), F.col("id") % 1_500).alias("oid"), F.lit("O").alias("otype"), F.lit("q").alias("qualifier"))
    e2o = kept(links, "e2o")
    log = ObjectLog.of(events, e2o.select("oid", "otype").distinct(), e2o)
    told = lambda: {r.id: (r.content, r.n) for r in search.event_chunks(log, 10).collect()}
    once = told()
    monkeypatch.setattr(crowds, "SHARE", 1_000)
    assert told() == once
    assert plan(search._told(events.select(F.lit(1).alias("k"), F.lit("l").alias("label"), F.col("eid").alias("value")), ["k"])).count("REPARTITION_BY_NUM") == 2

    found = events.withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))).collect()
    objects = {}
    for r in e2o.collect():
        objects.setdefault(r.eid, set()).add(r.oid)
    lanes = {}
    for r in found:
        lanes.setdefault((r.day, int(hashlib.md5(r.eid.encode()).hexdigest()[0], 16)), []).append(r)
    want = {}
    for (day, lane), mine in lanes.items():
        mine.sort(key=lambda r: (str(r.ts), r.eid))
        for k in range(0, len(mine), 10):
            batch = mine[k : k + 10]
            said = [(" activities", r.activity) for r in batch] + [(" events", r.eid) for r in batch] + [(" objects", o) for r in batch for o in objects.get(r.eid, ())]
            said += [x for r in batch for x in (r.attrs or {}).items() if x[1] is not None]
            want[f"events_{day}_{lane}_{k // 10}"] = (len(batch), Counter(said))
    assert set(once) == set(want)
    for key, (n, said) in want.items():
        lines = dict(x.split(": ", 1) for x in once[key][0].split("\n")[1:])
        assert once[key][1] == n and set(lines) == {label.strip() for label, _ in said}
        for label in {label for label, _ in said}:
            values = {v: c for (name, v), c in said.items() if name == label}
            assert lines[label.strip()] == ", ".join(f"{v} {c}" for v, c in sorted(values.items()))


@pytest.mark.parametrize("most", [1, 60, 10_000])
def test_keys_are_counted_and_looked_up_by_tasks_that_grow_with_their_files(spark, tmp_path, monkeypatch, most):
    """Formerly in a number of tasks that was fixed; null, repeated and crowded keys on both sides."""
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    key = lambda c: F.when(c % 13 != 0, F.concat(F.lit("k"), F.when(c % 5 == 0, 0).otherwise(c % 90)))
    rows = kept(spark.range(900).select(key(F.col("id")).alias("k"), F.col("id").alias("v")), "rows")
    known = kept(spark.range(300).filter("id % 3 = 0").select(key(F.col("id")).alias("k")), "known")
    monkeypatch.setattr(crowds, "LIGHT", 1_000)
    have = {r.k for r in known.collect()} - {None}
    lack = crowds.lacking(rows, known, "k", most)
    assert plan(lack).count(f"{crowds.tasks(rows, known, share=1_000)}), REPARTITION_BY_NUM") == 2
    assert Counter((r.k, r.v) for r in lack.collect()) == Counter((r.k, r.v) for r in rows.collect() if r.k not in have)
    assert {r.k: r.n for r in crowds.counted(rows, "k", most).collect()} == Counter(r.k for r in rows.collect())
    assert crowds.tasks(rows, share=1 << 40) == 0 and "REPARTITION_BY_NUM" in plan(crowds.counted(rows, "k"))


def test_nodes_that_alone_describe_their_objects_are_not_joined(spark, monkeypatch):
    """Formerly every link and event met all objects, and each attribute of each node was shuffled. Some issues are there twice,
    some share an event, a type is said in two ways, milestones, commits and issues are missing."""
    import json

    day = "2024-01-0{}T00:00:00Z".format
    issues = [("issue", {"number": i, "title": f"t{i}", "createdAt": day(1 + i % 3), "author": {"login": f"u{i % 4}"}, "milestone": {"id": str(i % 3)}}) for i in range(24)]
    more = [("milestone", {"id": "0", "number": 1, "createdAt": day(1)}), ("issue", {"number": 3, "title": "again", "state": "CLOSED", "author": {"login": "u9"}, "createdAt": day(1)})] + issues[5:7]
    more += [("issue_comment", {"id": f"C{i}", "__issue_number": i, "createdAt": day(4)}) for i in (1, 40)] + [("pr_comment", {"id": "C1", "__pr_number": 1, "createdAt": day(4)})]
    more += [("commit", {"oid": "abc", "message": "fix: #4 #99", "committedDate": day(2), "author": {"name": "u1"}}), ("commit_files", {"sha": "abc", "files": [{"path": "a"}, {"path": "a"}]}), ("commit_files", {"sha": "lost", "files": [{"path": "b"}]})]
    more += [("release", {"databaseId": 5, "tagName": "v1", "createdAt": day(2)})] + [("review_thread", {"id": "TH", "__pr_number": n, "isResolved": True, "resolvedAt": day(3)}) for n in (1, 50)]

    def told(rows):
        asked = []
        monkeypatch.setattr(mappers, "met", lambda df, *a, **k: asked.append(df.count()) or crowds.met(df, *a, **k))
        log = mappers.assemble(spark.createDataFrame([("r", k, json.dumps(n), i) for i, (k, n) in enumerate(rows)], "repo string, kind string, node string, seq long"))
        tables = {n: getattr(log, n) for n in ("events", "objects", "e2o", "o2o", "changes")}
        return asked, {n: Counter(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()) for n, df in tables.items()}

    monkeypatch.setattr(mappers, "KINDS", {k: mappers.KINDS[k] for k in {k for k, _ in issues + more}})
    met, got = told(issues + more)
    assert met[-1] == 24 - 3 + 1  # of the issues and the release that alone describe their objects, only links to what must exist
    objects = mappers._objects
    monkeypatch.setattr(mappers, "_objects", lambda facts: objects(facts).withColumn("facts", F.lit(2)))
    monkeypatch.setattr(mappers, "repeated", lambda df, key: df.select(F.xxhash64(key).alias("_hash")))
    every, want = told(issues + more)
    assert sum(every) > sum(met) and got == want
    assert all(x == 1 for t in ("events", "objects", "e2o", "o2o") for x in got[t].values())


def test_events_beside_their_relations_are_not_joined(spark, shared, tmp_path, monkeypatch):
    """Formerly all relations were shuffled by event to meet their events, and again for the windows of types that have one
    activity. Some rows of orders and lines are there twice, one order with another customer."""
    from objectlog.sources.adapters import commerce_log

    rng = random.Random(11)
    orders = [(i, rng.randrange(6), datetime(2024, 1, 1 + rng.randrange(9))) for i in range(40)] + [(3, 7, datetime(2024, 1, 2)), (4, 1, datetime(2024, 1, 3)), (90, None, datetime(2024, 1, 3))]
    lines = [(rng.randrange(40), rng.randrange(5), rng.randrange(3), i % 7, datetime(2024, 1, 1 + rng.randrange(12))) for i in range(150)]
    lines += [(*x[:4], datetime(2024, 1, 20)) for x in lines[:3]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        spark.range(9).select(F.col("id").alias(key)).write.parquet(str(tmp_path / f"{name}.parquet"))
    met, relations = [], traces.relations
    monkeypatch.setattr(traces, "relations", lambda log, t=None: met.append(log.e2o.count()) or relations(log, t))
    log = commerce_log(spark, str(tmp_path))
    plain = ObjectLog.of(log.events, log.objects, log.e2o)
    said, rel, other = shared
    nested = other.events.join(other.e2o.groupBy("eid").agg(F.collect_list(F.struct("oid", "otype", "qualifier")).alias("rels")), "eid", "left").withColumn("rels", F.coalesce("rels", F.expr("cast(array() as array<struct<oid:string,otype:string,qualifier:string>>)")))
    told = lambda df: Counter(map(tuple, df.collect()))
    got = told(traces.trace(log, alone=True)), told(traces.dfg_by_type(log))
    assert met and max(met) < 0.2 * plain.e2o.count()
    assert got == (told(traces.trace(plain, alone=True)), told(traces.dfg_by_type(plain)))
    both = other.with_rows(nested)
    assert told(traces.trace(both, "X", alone=True)) == told(traces.trace(other, "X", alone=True))
    assert {(r.src, r.tgt): r.frequency for r in traces.dfg(both).collect()} == Counter(x[1:3] for x in set(brute_pairs(said, rel)))
    assert log.of_type("Part").rows is None
    lone = plain.with_rows(log.rows.dropDuplicates(["eid"]))
    assert set(traces._single(traces.trace(lone, alone=True))) == {"Customer", "Part", "Supplier"}
