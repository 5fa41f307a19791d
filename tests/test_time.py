"""Interval joins, values as of events, moving frames, visits, the cube, token replay and streams in any order, against plain
versions on small tables with nulls, ties, repeated rows and one object or life that covers all."""

import datetime as dt
import random
from collections import Counter

import pytest

from objectlog.log import ObjectLog
from objectlog.operators import cube, history, overlap, petri, replay, traces
from objectlog.streaming.pairs import ordered_pairs
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


# --- Interval joins ---


def intervals(seed, n):
    rnd, out = random.Random(seed), []
    for k in range(n):
        s = rnd.choice([rnd.randrange(5_000), rnd.randrange(5_000) + rnd.random(), None] if k % 17 == 0 else [rnd.randrange(5_000), rnd.randrange(5_000) + 0.5])
        length = rnd.choice([0, 0, 1, 3, 30, 200, 1_000])
        out.append((k, rnd.choice(["x", "y", None]), s, None if s is None else s + length))
    return [*out, (n, "x", 0, 9_000), (n, "x", 0, 9_000), (n + 1, "x", 100, 90)]


@pytest.mark.parametrize(("on", "lane"), [([], 100_000), (["k"], 100_000), ([], 7)])
def test_overlaps(spark, on, lane):
    schema = "id int, k string, start timestamp, end timestamp"
    left, right = ([(i, k, at(s), at(e)) for i, k, s, e in intervals(seed, 120)] for seed in (1, 2))
    df = [spark.createDataFrame(x, schema) for x in (left, right)]
    got = Counter((r.a, r.b) for r in overlap.overlapping(*df, on, lane=lane).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect())
    good = lambda r: None not in r[2:] and r[2] <= r[3]
    want = Counter((a[0], b[0]) for a in left for b in right if good(a) and good(b) and a[2] <= b[3] and b[2] <= a[3] and (not on or (a[1] == b[1] and a[1] is not None)))
    assert got == want and len(want) > 200
    assert overlap.overlapping(df[0].limit(0), df[1], on).count() == 0


def test_a_life_over_everything_is_shared(spark, monkeypatch):
    """One life meets 5 000 others in lanes of 100."""
    rows = [(k, at(k), at(k + 1)) for k in range(5_000)]
    others, one = spark.createDataFrame(rows, "id int, start timestamp, end timestamp"), spark.createDataFrame([(-1, at(0), at(6_000))], "id int, start timestamp, end timestamp")
    seen = []
    real = overlap._meet

    def watched(homes, others, keys, lane):
        seen.append((homes, others, keys, lane))
        return real(homes, others, keys, lane)

    monkeypatch.setattr(overlap, "_meet", watched)
    found = overlap.overlapping(one, others, lane=100)
    assert found.count() == 5_000
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "lane" in plan and len(seen) == 2
    homes, visitors = seen[0][0], seen[0][1]
    assert homes.count() <= 2 and visitors.groupBy("at", "bin").count().agg(F.max("count")).first()[0] > 1_000  # what lanes are for


def test_lives_and_events(mini):
    assert sorted((r.oid1, r.oid2, r.seconds) for r in overlap.overlapping_lives(mini, "Order", "Order").collect()) == [("o1", "o2", 7_200.0)]
    found = {(r.oid, r.eid) for r in overlap.events_during(mini, "Order").collect()}
    assert found == {("o1", "e4"), ("o1", "e5"), ("o2", "e2")}


# --- Values as of events ---


@pytest.mark.parametrize("span", [1, 40, 10**9])
def test_values_as_of(spark, span):
    rnd = random.Random(4)
    events = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(300)]), k) for k in range(200)] + [("a", 5, 999)] * 3
    changes = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(300)]), rnd.choice([None, f"v{k}"]), rnd.choice([None, k]), k) for k in range(60)]
    e = spark.createDataFrame([(o, at(t), k) for o, t, k in events], "oid string, ts timestamp, eid int")
    c = spark.createDataFrame([(o, at(t), v, w, k) for o, t, v, w, k in changes], "oid string, ts timestamp, v string, w int, o int")

    def last(oid, t, column):
        hits = [((-1 if s[1] is None else s[1]), s[4], s[column]) for s in changes if s[0] == oid and s[column] is not None and (s[1] is None or (t is not None and s[1] <= t))]
        return max(hits)[2] if hits and t is not None else None

    got = Counter((r.eid, r.oid, r.v, r.w) for r in history.as_of(e, c, ["oid"], ["v", "w"], ["o"], span).collect())
    assert got == Counter((k, o, last(o, t, 2), last(o, t, 3)) for o, t, k in events)


def test_attribute_at_events(spark, mini):
    changes = spark.createDataFrame([("o1", "Order", at(3_600 * h), f, {"state": v}) for h, f, v in ((9, None, "new"), (10.5, "state", "paid"), (10.5, "a", "seen"), (30, "state", "gone"))], "oid string, otype string, ts timestamp, changed_field string, attrs map<string,string>")
    log = ObjectLog.of(mini.events, mini.objects, mini.e2o, changes=changes)
    got = {(r.eid, r.oid): r.value for r in history.values_at_events(log, "state", "Order").collect()}
    assert got == {("e1", "o1"): "new", ("e2", "o1"): "new", ("e3", "o1"): "paid", ("e4", "o2"): None, ("e5", "o2"): None}


# --- Frames and visits ---


@pytest.mark.parametrize("span", [1, 70, 10**9])
def test_frames(spark, span):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, rnd.randrange(900), rnd.random() * 900]), k) for k in range(400)]
    df = spark.createDataFrame([(u, at(t), k) for u, t, k in rows], "u string, ts timestamp, _k int").withColumn("row", F.lit(1))
    got = {r._k: (r.n, r.least) for r in history.in_frame(df, ["u"], 60, {"n": F.count("*"), "least": F.min("_k")}, span).collect()}
    inside = lambda a, b: (a is None and b is None) or (a is not None and b is not None and a - 60 <= b <= a)
    want = {}
    for u, t, k in rows:
        t_ = None if t is None else round(t, 6)
        own = [j for v, s, j in rows if v == u and inside(t_, None if s is None else round(s, 6))]
        want[k] = (len(own), min(own))
    assert got == want


@pytest.mark.parametrize("span", [1, 25, 10**9])
def test_visits(spark, span):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 3_000)])) for _ in range(300)] + [("hot", t * 9) for t in range(200)]
    df = spark.createDataFrame([(u, at(t)) for u, t in rows], "u string, ts timestamp")
    got = sorted((str(r.u), r.start, r.end, r.n) for r in history.visits(df, ["u"], 10, span).collect())
    want = []
    for u in {u for u, _ in rows}:
        times = sorted(t for v, t in rows if v == u and t is not None)
        runs = []
        for t in times:
            if runs and t - runs[-1][-1] <= 10:
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(str(u), at(r[0]), at(r[-1]), len(r)) for r in runs]
    assert got == sorted(want)
    own = df.filter("ts is not null").groupBy("u", F.session_window("ts", "10 seconds").alias("w")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count("*").alias("n"))
    assert got == sorted((str(r.u), r.s, r.e, r.n) for r in own.collect())


def streamed(spark, tmp_path, batches, schema, query, name):
    """What ``query`` gives of batches that arrive one after the other; the last one only moves the watermark on."""
    src = str(tmp_path / "in")
    out = query(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src) if not spark.createDataFrame([], schema).write.mode("overwrite").parquet(src) else None)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_visits_of_a_stream(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), at(t)) for t in rnd.sample(range(3_000), 200)]
    batches = [rows[:70], rows[70:140], rows[140:], [("z", at(90_000))], [("z", at(90_001))]]
    got = streamed(spark, tmp_path, batches, "u string, ts timestamp", lambda s: history.visits_stream(s, ["u"], "10 seconds", "2 hours"), "visits_out")
    want = history.visits(spark.createDataFrame(rows, "u string, ts timestamp"), ["u"], 10)
    key = lambda df: sorted((r.u, r.start, r.end, r.n) for r in df.filter("u <> 'z'").collect())
    assert key(got) == key(want)


def test_pairs_of_a_stream_in_any_order(spark, tmp_path):
    rnd = random.Random(8)
    rows = [("T", rnd.choice("ab"), f"e{k}", rnd.choice("xyz"), at(rnd.randrange(2_000))) for k in range(120)]
    rnd.shuffle(rows)
    schema = "otype string, oid string, eid string, activity string, ts timestamp"
    batches = [rows[:40], rows[40:80] + rows[:5], rows[80:], [("T", "z", "z1", "x", at(90_000))], [("T", "z", "z2", "x", at(90_001))], [("T", "z", "z3", "x", at(90_002))]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: ordered_pairs(s, "2 hours"), "ordered_out").filter("oid <> 'z'")
    want = []
    for o in "ab":
        own = sorted((r for r in rows if r[1] == o), key=lambda r: (r[4], r[2]))
        want += [(o, x[2], y[2]) for x, y in zip(own, own[1:])]
    assert sorted((r.oid, r.e1, r.e2) for r in got.collect()) == sorted(want)


# --- The cube ---


def test_cube(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"e{k}", rnd.choice("xy"), at(rnd.randrange(10 * 86_400)), f"o{rnd.randrange(1_500)}", rnd.choice(["A", "B"])) for k in range(4_000)]
    df = spark.createDataFrame(rows, "eid string, activity string, ts timestamp, oid string, otype string")
    log = ObjectLog.of(df.select("eid", "activity", "ts"), df.select("oid", "otype").distinct(), df.select("eid", "oid", "otype", F.lit(None).cast("string").alias("qualifier")))
    path = str(tmp_path / "cube")
    cube.store(cube.cells(log), path)
    cells = cube.stored(spark, path)
    second = lambda t: t.hour * 3600 + t.minute * 60 + t.second
    for r in cube.grouped(cells, ("activity", "otype")).collect():
        own = [x for x in rows if (r.level & 2 or x[1] == r.activity) and (r.level & 1 or x[4] == r.otype)]
        objects = len({(x[3], x[4]) for x in own})
        below = sum(second(x[2]) <= r.q0_5 for x in own) / len(own)
        assert r.n == len(own) and abs(r.objects - objects) <= 0.05 * objects and abs(below - 0.5) <= 0.02
    week = cells.filter(F.col("day").between("2024-01-02", "2024-01-08"))
    found = cube.grouped(week, ("otype",), every=False)
    assert "events" not in found._jdf.queryExecution().optimizedPlan().toString() and "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().simpleString()
    assert sum(r.n for r in found.collect()) == sum(86_400 <= (x[2] - T0).total_seconds() < 8 * 86_400 for x in rows)
    cube.store(cube.cells(log), path)  # cells of one group add up, the same objects stay the same
    again = cube.grouped(cube.stored(spark, path), (), every=False).first()
    assert again.n == 8_000 and abs(again.objects - len({x[3:] for x in rows})) < 150


# --- Token replay ---


def net(*transitions):
    out = petri.Net()
    out.place("source"), out.place("sink")
    for label, before, after in transitions:
        out.places += [p for p in (*before, *after) if p not in out.places]
        out.transition(label, before, after)
    return out


def test_replay_by_hand():
    line = replay.Replay(net(("a", ["source"], ["p"]), ("b", ["p"], ["sink"])))
    assert line("ab") == (0, 0, 3, 3)
    assert line("b") == (1, 1, 2, 2)  # p is missing, the source's token stays
    assert line("a") == (1, 1, 2, 2) and line("") == (1, 1, 1, 1)
    assert line("aab") == (1, 1, 4, 4)
    assert line("axb") == (1, 1, 4, 4)  # x is not in the net
    skip = replay.Replay(net(("a", ["source"], ["p"]), (None, ["p"], ["q"]), ("b", ["p"], ["q"]), ("c", ["q"], ["sink"])))
    assert skip("ac") == (0, 0, 4, 4) and skip("abc") == (0, 0, 4, 4)
    both = replay.Replay(net((None, ["source"], ["p", "q"]), ("a", ["p"], ["r"]), ("b", ["q"], ["s"]), (None, ["r", "s"], ["sink"])))
    assert both("ab") == both("ba") == (0, 0, 6, 6)
    assert both("a") == (1, 2, 3, 4)  # b's half stays, with a's; the end is missing


def said_by(play, names, word):
    """Whether the net can say the word, by all of its runs."""
    todo, seen = [(Counter({"source": 1}), 0)], set()
    while todo:
        marking, i = todo.pop()
        if (mark := (frozenset(marking.items()), i)) in seen:
            continue
        seen.add(mark)
        if i == len(word) and marking == Counter({"sink": 1}):
            return True
        for t, label in names.items():
            if play._holds(marking, play.inputs[t]) and (label is None or (i < len(word) and label == word[i])):
                todo.append((+(marking - play.inputs[t] + play.outputs[t]), i + (label is not None)))
    return False


def test_replay_of_what_a_net_can_say():
    """Whatever random runs of mined nets say replays without a missing or a remaining token, and so does what was mined from if
    some run says it."""
    rnd = random.Random(10)
    for seed in range(12):
        words = [rnd.choices("abcde", k=rnd.randrange(1, 7)) for _ in range(6)]
        edges = {(x, y) for w in words for x, y in zip(w, w[1:])}
        made = petri.net_of(petri.mine({a for w in words for a in w}, edges, {w[0] for w in words}, {w[-1] for w in words}))
        play = replay.Replay(made)
        names = dict(made.transitions)
        for _ in range(20):
            marking, said = Counter({"source": 1}), []
            for _ in range(60):
                ready = [t for t in names if play._holds(marking, play.inputs[t])]
                if marking == Counter({"sink": 1}) or not ready:
                    break
                t = rnd.choice(ready)
                marking = +(marking - play.inputs[t] + play.outputs[t])
                said += [names[t]] if names[t] else []
            if marking == Counter({"sink": 1}):
                assert play(said)[:2] == (0, 0), (seed, said)
        for w in words:
            assert (play(w)[:2] == (0, 0)) == said_by(play, names, w), (seed, w)


def test_replay_counts_variants(mini):
    nets = {"Order": net(("OrderPlaced", ["source"], ["p"]), ("Ship", ["p"], ["sink"]))}
    got = {tuple(r.sequence): (r.frequency, r.missing, r.remaining, r.consumed, r.produced) for r in replay.replayed(mini, nets).collect()}
    assert got == {("OrderPlaced", "Pick", "Ship"): (1, 1, 1, 4, 4), ("OrderPlaced", "Ship"): (1, 0, 0, 3, 3)}
    (total,) = replay.replay_fitness(mini, nets).collect()
    assert (total.traces, total.fitting, total.missing, total.produced, total.fitness) == (2, 1, 1, 7, round(1 - 1 / 7, 6))
    assert replay.replayed(mini, {}).count() == 0
    mined = replay.replay_fitness(mini, petri.discover(mini)).collect()
    assert {r.otype: r.fitness for r in mined} == {"Item": 1.0, "Order": 1.0, "User": 1.0}
    assert traces.variant_arrays(mini, "Order").count() == 2


def test_parts_in_sequence_are_in_order():
    """Whatever their names: c before b before a."""
    assert str(petri.mine(set("abc"), {("c", "b"), ("b", "a")}, {"c"}, {"a"})) == "seq(c, b, a)"
    assert str(petri.mine(set("abx"), {("a", "b"), ("b", "x"), ("x", "a")}, {"a"}, {"b"})) == "loop(seq(a, b), x)"


def test_steps_of_traces_in_sql(spark):
    from objectlog.operators import table_functions

    table_functions.register(spark)
    rows = [("o1", "a", at(0), 1), ("o1", "b", at(5.5), 2), ("o1", "a", at(5.5), 3), ("o2", "a", at(9), 4), ("o1", None, None, 5), ("o2", "a", at(8), 6)]
    spark.createDataFrame(rows, "oid string, activity string, ts timestamp, k int").createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT k, step, gap_us, seen FROM trace_steps(TABLE(some_rows) PARTITION BY oid ORDER BY (ts, k))").collect()
    assert sorted(map(tuple, got)) == [(1, 1, None, 0), (2, 2, 5_500_000, 0), (3, 3, 0, 1), (4, 1, 1_000_000, 1), (5, 0, None, 0), (6, 0, None, 0)]
    with pytest.raises(Exception, match="activity and ts"):
        spark.sql("SELECT * FROM trace_steps(TABLE(SELECT 1 AS x))").collect()
