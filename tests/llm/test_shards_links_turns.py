"""Shards, links of two tokenizers and repaired conversations against plain versions, on tables with nulls, ties, repeated rows,
hot groups and columns whose names clash; and samples where labels or languages are very many."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from objectlog.llm import align, common, dialogue, langid, lm, near, sharding, toxicity
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
CLASH = ["size", "shard", "slot", "row", "n", "part", "k0", "h", "groups", "a.b", "conv", "key"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# --- Shards ---


def plain_shards(rows, shards):
    """By id (nulls first); rows that share an id may come in any order, so their sizes are equal here."""
    size = lambda t: len((t or "").encode()) + 16
    total, at, out = sum(size(t) for _, t in rows), 0, []
    slots = Counter()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        s = (2 * at + size(text)) * shards // (2 * total)
        out.append((doc, size(text), zlib.crc32((text or "").encode()), s, slots[s]))
        at, slots[s] = at + size(text), slots[s] + 1
    return out


def table(found):
    return sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in found.collect())


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_of_equal_bytes(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    rows = [(k, "é" * (k * 7 % 50)) for k in range(300)] + [(None, "no id")] * 40 + [(5_000, "same")] * 200 + [(6_000, None), (6_001, ""), (6_002, "x" * 4_000)]
    found = sharding.shard_table(clashing(spark.createDataFrame(rows, DOCS).repartition(4)), shards)
    assert table(found) == sorted((str(r[0]), *r[1:]) for r in plain_shards(rows, shards))
    assert {(r.law, r.grown_shard) for r in found.collect()} == {("bytes", None)}


def test_shards_are_balanced_and_written(spark, tmp_path):
    rows = [(k, "w" * (k * 37 % 900)) for k in range(2_000)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    sizes = Counter()
    for r in sharding.sharded(docs, 8).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 916
    sharding.write_shards(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()) == rows
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_shards_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard_table(empty, 40).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_table(empty, 0)


# --- Links of two tokenizers ---


def plain_links(texts):
    """Both libraries over whole texts, their tokens' bytes, and the offsets that both end at."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=str(public.path("piece_bpe_32k.model")))
    at, out, counts = align.byte_level(), [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False) if text else None
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(at[c] for c in t) for t in a.tokens] if a else []
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append((0, 0, [], ""))
            continue
        ends = lambda parts: {sum(map(len, parts[: k + 1])): k for k in range(len(parts))}
        ends_a, ends_b = ends(a_bytes), ends(b_bytes)
        cuts = sorted(ends_a.keys() & ends_b.keys())
        links, said, i, j = [], [], 0, 0
        for c in cuts:
            said.append(",".join(map(str, a.ids[i : ends_a[c] + 1])) + "|" + ",".join(map(str, b[j : ends_b[c] + 1])))
            i, j = ends_a[c] + 1, ends_b[c] + 1
            links.append((a.ids[i - 1], b[j - 1]))
        counts.update(links)
        out.append((len(a.ids), len(b), links, ";".join(said)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), said) for n_a, n_b, x, said in out], counts


TEXTS = [
    None, "", " ", "   \n", "word", "two  spaces   and trailing ", " leading", "line\nbreak\r\n\ttab", "nbsp here   there", "mark ▁ of a space", "a▁b", "<|endoftext|> <s> </s> <unk> text", "Été ÉTÉ 日本語のテキスト 👩‍👩‍👧 é",
    "don't I'll we've 12,345 1e9 a_b", "  \x1c x \x85 y", "zero​width ﻿ bom", "x" * 500, "the cat the cat the cat", "ﬁ Ⅳ ﾊﾝｶｸ", "\x00 nul", "a  \n  b 　 c",
]


@pytest.mark.parametrize("block", [align.BLOCK_BYTES, 8 * 50_300 * 40])
def test_alignment(spark, block, monkeypatch):
    monkeypatch.setattr(align, "LANE", 1)
    texts = [*TEXTS, *["the cat sat on a mat" for _ in range(50)], "hot word " * 2_000]
    docs = clashing(spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)], DOCS).repartition(5))
    paths = str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model"))
    found, pairs = align.alignment(docs, *paths, block_bytes=block)
    expected, counts = plain_links(texts)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(((k if k != 3 else None, *e) for k, e in enumerate(expected)), key=str)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == counts
    best = {(r.a, r.b) for r in pairs.filter("best").collect()}
    assert best == {p for p, n in counts.items() if n == max(m for q, m in counts.items() if q[1] == p[1])}
    short = {r.doc_id: r.groups_sha256 for r in align.alignment(docs, *paths, text_of_groups=False)[0].collect()}
    assert short == {(k if k != 3 else None): hashlib.sha256(e[-1].encode()).hexdigest() if e[-1] else "" for k, e in enumerate(expected)}


def test_alignment_of_nothing(spark):
    found, pairs = align.alignment(spark.createDataFrame([], DOCS), str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model")))
    assert found.collect() == [] and pairs.collect() == []


def test_pieces_fall_apart_as_whole_texts():
    """Cuts change no token, whatever stands around spaces."""
    rnd, aligner = random.Random(7), align.Aligner(str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model")))
    assert aligner.apart
    for _ in range(400):
        text = "".join(rnd.choice([" ", "  ", "\n", "a", "the", "Zq", "'s", "9", ".", "é", " ", "日", "\t", "-"]) for _ in range(rnd.randrange(1, 25)))
        n_a, n_b, _, said, _ = aligner.align([text])
        tokens_a, tokens_b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
        groups = [g.split("|") for g in said[0].split(";")]
        assert [int(x) for g in groups for x in g[0].split(",")] == tokens_a and [int(x) for g in groups for x in g[1].split(",")] == tokens_b
        assert (n_a[0], n_b[0]) == (len(tokens_a), len(tokens_b))


# --- Conversations ---


def plain_damage(rows):
    out = {}
    spaced = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        act = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", spaced(text)) if act == 2 else spaced(text)
        mine += [(turn, "user" if act == 4 else spaced(role), text)] * {0: 0, 3: 2}.get(act, 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def plain_repair(rows):
    """The least (cost, audit) over all ways, by a heap."""
    faults, seen = [], set()
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()
        new = [(x, name) for x, name in (("u", "user"), ("a", "assistant")) if x in after[state]]
        for x, name in new:
            heapq.heappush(heap, (cost + 2, audit + "I", i, after[state][x], (*turns, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, turns))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after[state][role[:1]], (*turns, f"{role}:{text}")))
                for x, name in new:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after[state][x], (*turns, f"{name}:{text}")))


def turns_table(seed, hot=0):
    rnd, rows = random.Random(seed), []
    for conv in [None, *range(60)]:
        for t in range(rnd.choice([0, 1, 2, 5, 9, 30])):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rnd.choice([None, t, t, t, t + rnd.randrange(3)]), role, rnd.choice(["Hi.", "Hi", "", "  \n", None, f"a {rnd.randrange(9)}.", f"x{rnd.randrange(4)} ! ", "Été"])))
    rows += [(7, rnd.choice([None, *range(hot // 2)]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["Hi.", "No", "", f"{rnd.random()}."])) for _ in range(hot)]
    return rows + rows[:20] + [(99, 4, "user", "same")] * 50


@pytest.mark.parametrize(("segment", "hot"), [(dialogue.SEGMENT, 0), (1, 0), (3, 0), (40, 900)])
def test_repaired_conversations(spark, segment, hot):
    rows = turns_table(segment, hot)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit("x") for c in ("key", "part", "segment", "n", "audit", "cost", "own", "a.b")})
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_report(dialogue.damage(df), df, segment).collect()}
    assert got == {conv: plain_repair(mine) for conv, mine in plain_damage(rows).items()}


def test_no_conversations_and_dropped_ones(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_report(df, df).collect() == []
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)
    assert [tuple(r) for r in dialogue.repair_report(dialogue.damage(df), df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [("c", 2, "assistant", "Fine."), ("c", 1, "system", "Be kind."), ("c", 3, "user", "So"), ("c", 4, "user", " ")]
    report, turns = dialogue.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert [(r.role, r.text) for r in turns.orderBy("part", "segment", "place").collect()] == [("system", "Be kind."), ("user", ""), ("assistant", "Fine.")]
    assert [(r.cost, r.audit, r.blank, r.truncated) for r in report.collect()] == [(8, "KIKDD", 1, 1)]


# --- Samples, and words that every text holds ---


def test_labels_far_beyond_the_documents(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(300)], DOCS)
    marks = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("target"))
    got = common.labelled(marks, docs, 100, 2, 3, 1 << 20).collect()
    assert Counter(r.target for r in got) == {0: 100, 1: 100}
    every = common.labelled(marks, docs, 1_000, 2, 3, 1 << 20).collect()
    assert len(every) == 300
    scored = toxicity.toxicity(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, "vile slur vile").otherwise("kind words here")), marks.withColumnRenamed("target", "toxic"))
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored.collect())


def test_features_are_bounded_for_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "DRAWN", 10_000)
    rows = [(k, f"lang{k % 200} " * 5 + f"t{k}", f"l{k % 200}") for k in range(8_000)]
    seen, real = [], langid.train
    monkeypatch.setattr(langid, "train", lambda targets, x: seen.extend(targets) or real(targets, x, epochs=1))
    langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40).limit(1).collect()
    assert set(seen) == {f"l{k}" for k in range(200)} and len(seen) <= 40 * langid.LANGUAGES
    assert common.portion(400, 4 << 20, 4, 10) == (400, 4 << 20) and common.portion(400, 4 << 20, 200, 10) == (20, (4 << 20) // 20)


def test_long_words_of_every_text_are_frequent(spark):
    line = "=" * 200
    docs = spark.createDataFrame([(k, f"{line} word{k % 5} {line} https://{'x' * 90}/{k % 2}") for k in range(60)], DOCS)
    path = str(public.path("piece_bpe_32k.model"))
    rows = [sorted(map(tuple, lm.lm_scores(docs, path, frequent=n).collect())) for n in (1, 1_000)]
    assert [r[:5] for r in rows[0]] == [r[:5] for r in rows[1]]
    assert all(abs(x - y) < 1e-6 * abs(x) for a, b in zip(*rows) for x, y in zip(a[5:], b[5:]))


# --- Pages of one template, which all but link ---


def jaccard_roots(rows, width, percent):
    """Components by all pairs of sets."""
    sets = {i: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in up}


def grid_pages(n, own, places, pool=0, seed=0):
    """Pages of 240 words, ``own`` of them their own or out of a pool, at some of ``places`` places four words apart."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = [f"t{k}" for k in range(240)]
        for j in rnd.sample(range(2, 236, 4)[:places], own):
            words[j] = f"own{rnd.randrange(pool)}" if pool else f"own{i}at{j}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("own", "places", "pool", "width", "percent"), [(3, 59, 0, 4, 85), (5, 59, 0, 4, 85), (3, 10, 30, 4, 85), (6, 30, 30, 5, 80)])
def test_pages_just_below_the_threshold(spark, own, places, pool, width, percent):
    rows = grid_pages(120, own, places, pool)
    got = near.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), width, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == jaccard_roots(rows, width, percent)


def test_work_on_such_pages_grows_with_them(spark, monkeypatch):
    """Tested pairs and rows of lists of 150 and of 600 pages, whose pairs are 16 times as many."""
    seen, real = Counter(), near.materialise

    def counted(df, name):
        out = real(df, name)
        seen[name] += out.count()
        return out

    monkeypatch.setattr(near, "materialise", counted)
    work = []
    for n in (150, 600):
        seen.clear()
        near.jaccard_components(spark.createDataFrame(grid_pages(n, 3, 59), DOCS)).count()
        work.append({k: seen[k] for k in ("near-pairs", "near-lists", "near-split")})
    assert work[1]["near-pairs"] <= 2 * 600 and all(work[1][k] <= 5 * max(work[0][k], 150) for k in work[0]), work
