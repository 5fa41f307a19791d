"""Repair of conversations whose turns are missing, empty, repeated, cut off or out of turn: the cheapest edits that give
``system? (user assistant)+`` or nothing, and of those the audit that is least in ASCII.

The edits come from a backward dynamic programme over turns and grammar states. Of a turn only its role's first letter, two
marks and a key take part; texts meet the edits at the end. Turns of a conversation lie in segments of bounded length. A segment is
a min-plus matrix from state to state, so the cost to go at each segment's end comes from one streamed pass over
the matrices, backwards; with it every segment walks forward from each state it may be entered in, and one streamed pass over
these four ends, forwards, says which walk is the one taken. So a conversation of any length is shared among tasks, and what one task
sees of it whole is a few numbers for each segment.

States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; it may end in 0 or 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, lean, materialise, rows_of

#: Rows of a segment.
SEGMENT = 4_096
#: What is no white space, as a class of both regular expression languages.
INK = r"[^\x20\x09-\x0D]"
#: Costs: delete, insert, change of role, a truncated turn that stays.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: By state: the state that an inserted or re-roled turn leads to, the role it has, and where a kept turn leads by its initial.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FAR = 1 << 60


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``turns`` after damage by crc32(``conv_id:turn``) modulo 20: 0 drops the row, 1 empties its
    text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user. Null roles and texts, and null ids in the
    checksum, count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), act.alias("act")).filter("act <> 0")
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("again")).drop("again")


# --- A segment: runs of (initial, forced, cut off, times); forced ones must be deleted. -------------------------------------


def closed(b: list[int]) -> list[int]:
    """Costs to go by state, insertions allowed."""
    t2, t3 = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return [min(b[0], INSERT + t2), min(b[1], INSERT + t2), t2, t3]


#: Costs to go where nothing follows.
END = closed([0, FAR, FAR, 0])


def costs(runs: list[tuple[str, bool, bool, int]], end: list[int]) -> list[list[int]]:
    """Costs to go before each run, and after the last (``end``)."""
    out = [end]
    for initial, forced, cut_off, times in reversed(runs):
        go = out[-1]
        best = [min(FAR, DELETE * times + g) for g in go]
        if not forced:
            more, keeps = CUT_OFF * cut_off, KEEPS.get(initial, {})
            for s in range(4):
                best[s] = min(best[s], REROLE + more + go[NEXT[s]])
                if s in keeps:
                    best[s] = min(best[s], more + go[keeps[s]])
        out.append(closed(best))
    return out[::-1]


def walk(runs: list[tuple[str, bool, bool, int]], go: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The audit of the cheapest way from ``state`` through a segment, at each step the least letter of D, I, K, R that stays
    on a cheapest way, and the state it ends in. After the last segment what is open is closed."""
    said: list[str] = []
    for i, (initial, forced, cut_off, times) in enumerate(runs):
        while True:
            here, after, more = go[i][state], go[i + 1], CUT_OFF * cut_off
            if here == DELETE * times + after[state]:
                said.append("D" * times)
            elif here == INSERT + go[i][NEXT[state]]:
                said.append("I")
                state = NEXT[state]
                continue
            elif not forced and state in (keeps := KEEPS.get(initial, {})) and here == more + after[keeps[state]]:
                said.append("K")
                state = keeps[state]
            else:
                said.append("R")
                state = NEXT[state]
            break
    while last and state not in (0, 3):
        said.append("I")
        state = NEXT[state]
    return "".join(said), state


def turns_of(audit: str, runs: list[tuple[str, bool, bool, int]], state: int) -> Iterator[tuple[int, str | None]]:
    """The repaired turns of a segment: (number of the run, None if its role stays, else the new one), -1 for an inserted turn."""
    i, left = 0, runs[0][3] if runs else 0
    for edit in audit:
        if edit == "I":
            yield -1, ROLE[state]
            state = NEXT[state]
            continue
        if edit != "D":
            yield i, None if edit == "K" else ROLE[state]
            state = KEEPS[runs[i][0]][state] if edit == "K" else NEXT[state]
        left -= 1
        if not left:
            i += 1
            left = runs[i][3] if i < len(runs) else 0


# --- The same over all conversations. --------------------------------------------------------------------------------


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _runs_of(row: dict) -> list[tuple[str, bool, bool, int]]:
    return [(x, bool(m & 1), bool(m & 2), n) for x, m, n in zip(row["initials"], row["marks"], row["times"], strict=True)]


def _stream(found: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in found:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(schema: T.StructType, made: Iterator[tuple], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    kind, out = _arrow(schema), [[] for _ in schema]
    for row in made:
        for c, v in zip(out, row, strict=True):
            c.append(v)
        yield from batches(out, kind, most)
    yield from batches(out, kind)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text) the report and the repaired turns.

    Report, one row for each conv_id: gaps (numbers missing between the least and the greatest turn), blank, duplicate and
    truncated (each row by its first fault: no printing character; role and text of an earlier row; last printing character
    none of ``.!?``), illegal (neighbours whose roles' first letters are not su, ua or au), cost and audit of the edits.
    Repaired turns: conv_id, part, segment, place (in this order they make up the conversation), role, text; inserted ones
    have empty texts.

    Rows go by turn, nulls first, then by role and the first 64 characters of the text, then by digest. Null roles and texts
    are one space, null conv_ids one conversation. Rows that agree in all are one run with a count throughout. Other columns
    take no part; an empty table gives two empty ones. Texts are told apart by 128 bits of their SHA-256.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.withColumns({"own": digest(F.col("text")), "head": F.substring("text", 1, 64)})
    rows = rows.withColumn("key", digest(F.to_json(F.struct("conv_id", "turn", "role", F.hex("own").alias("own")))))
    blank = ~F.col("text").rlike(INK)
    cut_off = ~F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")
    slim = rows.select("conv_id", "turn", "role", "own", "head", "key", blank.alias("blank"), cut_off.alias("cut_off"))
    runs = slim.groupBy(*slim.columns).agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # Texts of a role that occur at several turns of a conversation: all but the first are duplicates.
    first = runs.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("own").alias("o")).agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    met = runs.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("own") == F.col("o")), "left")
    seen = F.coalesce(turn != F.col("first"), F.lit(False))
    keys = ["conv_id", "turn", "role", "head", "own"]
    ordered = met.select(*keys, "key", "blank", "cut_off", "n", seen.alias("seen")).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("head", "own")

    conv = _type(turns, "conv_id")
    counts = ["known", "least", "most", "distinct", "blank", "duplicate", "truncated", "illegal"]
    segment_schema = T.StructType.fromDDL(f"conv_id {conv}, part int, segment long, alone boolean, initials array<string>, marks array<int>, times array<long>, keys array<binary>, matrix array<long>, first_role string, last_role string, " + ", ".join(f"{c} long" for c in counts))

    def segments(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a conversation that are next to each other, at most `segment` rows of the table in each segment."""

        def made() -> Iterator[tuple]:
            part, number, held, now, begun = TaskContext.get().partitionId(), 0, [], None, False
            names = ["conv_id", "turn", "role", "key", "blank", "cut_off", "n", "seen"]

            def made_of(whole: bool) -> tuple:
                runs, own, marks = [], [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                turn_list = [r[1] for r in held if r[1] is not None]
                before = None
                for _, _, role, key, is_blank, is_cut, n, is_seen in held:
                    initial = role[:1]
                    faulty = n if is_blank or is_seen else n - 1
                    if is_blank:
                        marks["blank"] += n
                    else:
                        marks["duplicate"] += faulty
                        if not is_seen:
                            marks["truncated"] += is_cut
                            runs.append((initial, False, bool(is_cut), 1))
                            own.append(key)
                    if faulty:
                        runs.append((initial, True, False, faulty))
                        own.append(key)
                    marks["illegal"] += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
                    before = initial
                matrix = None
                if not whole:
                    ways = [costs(runs, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
                    matrix = [min(ways[e][s], FAR) for s in range(4) for e in range(4)]
                return (now, part, number, whole, [r[0] for r in runs], [r[1] + 2 * r[2] for r in runs], [r[3] for r in runs], own, matrix, held[0][2][:1], held[-1][2][:1],
                        len(turn_list), min(turn_list, default=None), max(turn_list, default=None), len(set(turn_list)), *marks.values())

            # Whole conversations are only sure within a partition: its first and last may go on in its neighbours.
            started = True
            for row in rows_of(found, names):
                if held and (row[0] != now or len(held) >= segment):
                    ends = row[0] != now
                    yield made_of(ends and not begun and not started)
                    number, held = number + 1, []
                    started, begun = started and not ends, not ends
                now = row[0]
                held.append(row)
            if held:
                yield made_of(False)

        yield from _rows(segment_schema, made())

    cut = materialise(ordered.select("conv_id", "turn", "role", "key", "blank", "cut_off", "n", "seen").mapInArrow(lean(segments), segment_schema), "dialogue-segments")
    place = ["part", "segment"]
    go_schema = T.StructType.fromDDL("part int, segment long, go array<long>, last boolean")

    def backward(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs to go at each segment's end, from a conversation's last segment to its first."""

        def made() -> Iterator[tuple]:
            now, go, begun = None, END, False
            for r in _stream(found):
                last = not begun or r["conv_id"] != now
                go = END if last else go
                now, begun = r["conv_id"], True
                yield r["part"], r["segment"], go, last
                m = r["matrix"]
                go = closed([min(m[4 * s + e] + go[e] for e in range(4)) for s in range(4)])

        yield from _rows(go_schema, made())

    split = cut.filter("not alone")
    back = split.select("conv_id", *place, "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("segment")).mapInArrow(lean(backward), go_schema)
    walk_schema = T.StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segment_schema if f.name != "matrix") + ", audits array<string>, ends array<int>, last boolean, cost_to_go array<long>")
    names = [f.name for f in walk_schema]

    def walks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The audit and the end of each segment from every state that it may be entered in."""

        def made() -> Iterator[tuple]:
            for r in _stream(found):
                runs = _runs_of(r)
                go = costs(runs, r["go"] or END)
                last = r["alone"] or r["last"]
                ways = [walk(runs, go, s, last) if go[0][s] < FAR else ("", 0) for s in range(1 if r["alone"] else 4)]
                yield *[r[n] for n in names[:-4]], [w[0] for w in ways], [w[1] for w in ways], last, go[0]

        yield from _rows(walk_schema, made(), 200)

    walked = materialise(cut.join(back, place, "left").select(*[c for c in names[:-4]], "go", "last").mapInArrow(lean(walks), walk_schema), "dialogue-walks")
    start_schema = T.StructType.fromDDL("part int, segment long, state int, seam long, common long")

    def forward(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In which state each segment is entered; whether its seam to the one before is illegal or lies within a turn."""

        def made() -> Iterator[tuple]:
            now, state, begun, role, turn = None, 0, False, None, None
            for r in _stream(found):
                if not begun or r["conv_id"] != now:
                    now, begun, state, role, turn = r["conv_id"], True, 0, None, None
                yield r["part"], r["segment"], state, int(role is not None and role + r["first_role"] not in ("su", "ua", "au")), int(turn is not None and turn == r["least"])
                state, role, turn = r["ends"][state], r["last_role"], r["most"] if r["most"] is not None else turn

        yield from _rows(start_schema, made())

    starts = walked.filter("not alone").select("conv_id", *place, "first_role", "last_role", "least", "most", "ends").repartition("conv_id").sortWithinPartitions("conv_id", *place).mapInArrow(lean(forward), start_schema)
    state = F.coalesce(F.col("state"), F.lit(0))
    taken = materialise(
        walked.join(starts, place, "left").select(
            "conv_id", *place, "initials", "marks", "times", "keys", *counts[:7], (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"), F.coalesce("common", F.lit(0)).alias("common"),
            state.alias("state"), F.element_at("audits", state + 1).alias("audit"), F.col("cost_to_go")[0].alias("cost"),
        ),
        "dialogue-edits",
    )
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, "audit"))), lambda x: x["audit"]), "")
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - (F.sum("distinct") - F.sum("common")), F.lit(0))
    # The cost of the whole is what the first segment has still to go from state 0.
    report = taken.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in counts[4:]], F.min_by("cost", F.struct(*place)).alias("cost"), said.alias("audit"))

    edit_schema = T.StructType.fromDDL(f"conv_id {conv}, part int, segment long, place long, role string, key binary")

    def edits(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for r in _stream(found):
                for k, (run, role) in enumerate(turns_of(r["audit"], _runs_of(r), r["state"])):
                    yield r["conv_id"], r["part"], r["segment"], k, role, None if run < 0 else r["keys"][run]

        yield from _rows(edit_schema, made())

    repaired = taken.select("conv_id", *place, "initials", "marks", "times", "keys", "audit", "state").mapInArrow(lean(edits), edit_schema)
    texts = rows.groupBy("key").agg(F.first("role").alias("own_role"), F.first("text").alias("own_text"))
    kept = repaired.filter("key is not null").join(texts, "key").select("conv_id", *place, "place", F.coalesce("role", "own_role").alias("role"), F.col("own_text").alias("text"))
    return report, kept.unionByName(repaired.filter("key is null").select("conv_id", *place, "place", "role", F.lit("").alias("text")))


def line_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines. A digest reads its bytes in order, so a conversation's are
    streamed through one task, which holds one line of it at a time."""
    schema = T.StructType.fromDDL(f"conv_id {_type(repaired, 'conv_id')}, repaired_sha256 string")

    def hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def made() -> Iterator[tuple]:
            now, h = None, None
            for conv, role, text in rows_of(found, ["conv_id", "role", "text"]):
                if h is not None and conv != now:
                    yield now, h.hexdigest()
                    h = None
                if h is None:
                    now, h = conv, sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode("utf-8", "replace"))
            if h is not None:
                yield now, h.hexdigest()

        yield from _rows(schema, made())

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(lean(hashed), schema)


def repair_report(turns: DataFrame, every: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The report and the digest of the repaired turns for each conv_id of ``every``; those without turns have zeros, an empty
    audit and the digest of nothing."""
    report, repaired = repair(turns, segment)
    ids = every.select("conv_id").distinct()
    found = ids.join(report.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    found = found.join(line_digests(repaired).withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
