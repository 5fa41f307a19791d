"""Each operator against a brute-force version on small tables that hold the awkward cases."""

import fractions
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from objectlog.llm import chunks, decontaminate, langid, lm, mixing, near, quality, tokens, topk, toxicity
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix liquid jugs of rum and pack five dozen boxes".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    long = prose(1, 60)
    base = prose(2, 200)
    near_ = base.split()
    near_[100] = "changed"
    out = [None, "", "   \n", "Word", "İΣ ﬁ ÉTÉ été 's <|endoftext|>x don't 12,345  z q", long, base, base, " ".join(near_), "x" * 3_000, prose(3, 5) + " " + long + " " + prose(4, 5), "日本語のテキスト " * 50, prose(5, 3_000), "a b c d", "a b c d e"]
    return [(i, t) for i, t in enumerate(out)] + [(None, "no id here"), (6, base), (3, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if t is None else "en" if k % 2 else "de", [None, "s1", "s2", "s3"][k % 4], 0) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"word": F.lit("w"), "row": F.lit(1), "n": F.lit(2), "score": F.lit(0.0), "size": F.lit(3), "node": F.lit("n")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(df, columns, expected):
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([tuple(r[c] for c in columns) for r in df.collect()], key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("frequent", [3, 1_000])
def test_token_counts(docs, empty, texts, frequent):
    from tokenizers import Tokenizer

    name = "word_bpe_49k.json"
    t = Tokenizer.from_file(str(public.path(name)))
    count = lambda x: len(t.encode(x or "", add_special_tokens=False))
    got = tokens.token_counts(docs, str(public.path(name)), frequent=frequent, limit=50)
    same(got, ("doc_id", "n_bytes", "n_tokens", "over_limit"), [(i, len((x or "").encode()), count(x), count(x) > 50) for i, x in texts])
    assert tokens.token_counts(empty, str(public.path(name))).count() == 0


def test_lattice_is_a_sum_over_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    model = lm.Lattice(pieces, np.log(np.full(7, 0.1)), np.full(256, math.log(1e-3)), math.log(0.1))

    def brute(s):
        if not s:
            return 1.0
        p = sum(0.1 * brute(s[len(x) :]) for x in pieces if s.startswith(x))
        return p + (1e-3 ** len(s[0].encode()) * brute(s[1:]) if s[0] not in pieces else 0.0)

    words = [b"a", b"abba", "aéb".encode(), b"", b"ab" * 40]
    got, uses, _ = model.words(words, np.ones(5))
    assert np.allclose(got[:4], [math.log(brute("▁" + w.decode())) for w in words[:4]])
    assert np.isfinite(got).all() and np.isclose(model.words([b"ab" * 300])[0][0], model._long("▁" + "ab" * 300, None, None, None)) and np.isclose(model.words([b"a"], np.ones(1))[1].sum(), (0.1 * 1 + 0.01 * 2) / 0.11)


def test_lm_scores(docs, empty, texts):
    path = str(public.path("piece_bpe_32k.model"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    bag = lambda t: (t or "").encode().lower().split() + [b" end"]
    c = Counter(w for i, t in texts if not held(i) for w in bag(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(bag(t)), sum(c[w] > 0 for w in bag(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in bag(t)), 5)) for i, t in texts]
    for frequent in (2, 1_000):
        got = lm.lm_scores(docs, path, frequent=frequent).withColumn("base_score", F.round("base_score", 5)).cache()
        same(got, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), want)
        scores = got.select("score").toPandas().score
        assert np.isfinite(scores).all() and (scores < 0).all()
        last = scores.sort_values().to_numpy()
        assert frequent == 2 or np.allclose(last, first)
        first = last
    assert lm.lm_scores(empty, path).count() == 0


def test_decontamination(spark, docs, empty, texts):
    bench = [(1, prose(1, 60)), (2, "a b c"), (10, None), (11, "!!"), (12, texts[6][1][:200]), (None, "lazy"), (2, "e")]
    windows = {}
    for i, t in bench:
        ws = decontaminate.words_of((t or "").encode())
        for k in range(max(len(ws) - 9, 0) + 1) if ws else ():
            windows.setdefault(tuple(ws[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in texts:
        ws, hit, items = decontaminate.words_of((t or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if tuple(ws[k : k + size]) in windows:
                    items |= windows[tuple(ws[k : k + size])]
                    hit |= set(range(k, k + size))
        want.append((i, len(ws), len(hit), ",".join(sorted(items))))
    table = spark.createDataFrame(bench, "item_id long, text string")
    for most in (1 << 20, 12):  # at once, and in several parts
        got = decontaminate.find_benchmark(docs, table, shard_words=40, item_words=most)
        n = F.aggregate("hit_spans", F.lit(0), lambda a, s: a + s["last"] - s["first"])
        same(got.select("doc_id", "n_words", n.alias("n"), F.array_join("hit_items", ",").alias("i")), ("doc_id", "n_words", "n", "i"), want)
    again = decontaminate.find_benchmark(decontaminate.remove_benchmark(docs, spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")), spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string"))
    assert again.filter("size(hit_spans) > 0").count() == 0
    assert decontaminate.find_benchmark(empty, table).count() == 0 and decontaminate.find_benchmark(docs, table.limit(0)).filter("size(hit_spans) > 0").count() == 0


def test_fm_index_on_random_text():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 3_000)
    text[-1] = 0
    index = decontaminate.FMIndex(text, 3)
    for size in (1, 2, 5):
        for p in itertools.islice(itertools.product((1, 2, 3), repeat=size), 40):
            low, high = index.search(np.array([p]), np.array([size]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [k for k in range(len(text) - size + 1) if tuple(text[k : k + size]) == p]


def jaccard_brute(texts, width, percent):
    sets = []
    for _, t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[k : k + width]) for k in range(max(len(ws) - width, 0) + 1)} if ws else set())
    own = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = own[a], own[b]
            own = [new if x == old else x for x in own]
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[own[k]] = min(least.get(own[k], i), i)
    return [(i, len(s), least.get(own[k]) if s else i) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True))]


def test_jaccard_components(docs, empty, texts):
    same(near.jaccard_components(docs), ("doc_id", "n_shingles", "component_id"), jaccard_brute(texts, 4, 85))
    assert near.jaccard_components(empty).count() == 0
    kept = near.one_of_each(docs, 5, 80).select("doc_id", "text").collect()
    assert len([r for r in kept if r.text and r.text == texts[6][1]]) == 1 and not [r for r in kept if r.doc_id == 8]


def test_jaccard_in_a_large_group(spark):
    """Hundreds of copies with edits around the threshold, so that hubs, lanes, blocks and the second round all take part."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    got = near.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=16, lane=30)
    same(got, ("doc_id", "n_shingles", "component_id"), jaccard_brute(rows, 4, 85))


def test_substring_dedup(spark, docs, empty, texts):
    passage = prose(77, 80)
    rows = [(k, f"{' '.join(f'a{k}b{j}' for j in range(40))} {passage} {' '.join(f'c{k}d{j}' for j in range(30 + k))}") for k in range(5)] + [(9, None), (10, "")]
    got = {r.doc_id: r for r in chunks.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[9].text is None and got[10].text == ""
    for k in range(1, 5):
        assert len(rows[k][1]) - len(got[k].text) > 0.5 * len(passage) and got[k].text.startswith(f"a{k}b0 ") and got[k].text.endswith(f"c{k}d{29 + k}") and got[k].n_runs == 1
    out = chunks.substring_dedup(docs.select("doc_id", "text")).collect()
    assert len(out) == len(texts) and {r.text for r in out if r.doc_id == 7} == {""} and {r.text for r in out if r.doc_id == 6} == {texts[6][1]}
    assert chunks.substring_dedup(empty).count() == 0
    raw = ("é日本語" * 3_000).encode()
    ends = chunks.boundaries(raw)
    assert ends[-1] == len(raw) and all(raw[a:b].decode() for a, b in zip([0, *ends], ends)) and ends == sorted(set(ends))
    shifted = chunks.boundaries(b"some new words here " + rows[0][1].encode())
    assert len({e - 20 for e in shifted} & set(chunks.boundaries(rows[0][1].encode()))) > 0.8 * len(shifted) - 2


def test_short_passages_are_found():
    """Passages of 55 words between other words: nearly all are found, and no chunk spans more than nine words."""
    rng, missed = np.random.default_rng(6), 0
    vocabulary = [f"{w}{k}" for w in WORDS for k in range(40)]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    for _ in range(1_000):
        passage = some(55)
        a, b = (f"{some(40)} {passage} {some(40)}".encode() for _ in range(2))
        first, ends = set(chunks.digests(a, chunks.boundaries(a))), chunks.boundaries(b)
        again = [k for k, d in enumerate(chunks.digests(b, ends)) if d in first]
        missed += not again or chunks.without(b, again, chunks.MIN_RUN)[2] == 0
        assert max(len(b[x:y].split()) for x, y in zip([0, *ends], ends)) <= 9
    assert missed <= 1


@pytest.mark.parametrize("seed", range(4))
def test_bit_slices(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (517, 7)) if seed < 3 else np.repeat(rng.integers(-2, 2, (40, 3)), 13, axis=0)
    q = rng.integers(-300, 300, (9, x.shape[1]))
    index = topk.BitSlices(x)
    for i, rows, score in index.top(q, 5, np.stack([index.full] * 9)):
        s = x @ q[i]
        best = sorted(range(len(x)), key=lambda r: (-s[r], r))[:5]
        assert sorted(rows) == sorted(best) and sorted(score) == sorted(s[best])


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(160)] + [(161, None), (162, [None] * 6), (163, [float("nan")] + [0.0] * 5), (164, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (50, [0.5] * 3), (200, [0.1] * 2)]
    rows += [(170 + k, rows[3][1]) for k in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in good if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for qi, v in good if qi == q for i, w in good if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    same(topk.exact_top_k(df, block=40, queries=2), ("query_id", "rank", "vec_id", "score"), want)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_exact_top_k_of_large_components(spark):
    """Finite components of any size take part; a score beyond a long is ranked and null."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(60)]
    rows += [(100, [2.0**20, 0.5, -1.0, 0.0]), (101, [-(2.0**21), 3.0, 0.25, 0.0]), (150, [1e30, -1e30, 2.0, 0.1]), (151, [-1e38, 5.0, 1e20, 0.3]), (152, [2.0**30 + 0.75, 0.0, 0.0, 1.0]), (153, [1e300, 0.0, 0.0, 0.0])]
    whole = lambda x: math.floor(fractions.Fraction(x) * 256)
    good = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]
            want += [(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(topk.exact_top_k(df, block=16, queries=2), ("query_id", "rank", "vec_id", "score"), want)
    assert {q for q, *_ in want} == {0, 50, 100, 150} and any(s is None for *_, s in want)


def test_mixing_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 100), ("c", 1_000)])
    assert got["a"] == 30 and math.isclose(sum(got.values()), 1_210) and all(got[s] <= 3 * n + 1e-9 for s, n in [("b", 100), (None, 100), ("c", 1_000)])
    assert mixing.targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0} and mixing.targets([]) == {}


def test_mixing(spark, docs, empty, texts):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(docs).collect()
    assert len(out) == len(texts) and all(0 <= r.taken <= 3 * r.size for r in out)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), None, ["a", "a", "a", "b", "c", None][i % 6], 0) for i in range(3_000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, block=50).collect()
    again = mixing.mix(df.repartition(7), block=50).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and len({r.copies for r in own}) <= 2
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 3  # documents are balanced too


def test_language_id(spark, empty, docs):
    rng = np.random.default_rng(0)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[g]), 5)) for _ in range(20)), g if i % 5 else None, "s", 0) for i, g in enumerate(["aa", "bb", "cc"] * 120)]
    df = spark.createDataFrame(rows + [(1_000, None, "aa", "s", 0), (1_001, "12 34 !!", "bb", "s", 0), (1_002, "", None, "s", 0)], DOCS)
    got = langid.language_id(df).collect()
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(360)}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got if r.doc_id < 360)
    assert all(r.lang_pred == "und" and r.ambiguous for r in got if r.doc_id >= 1_000)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    code = langid.codewords(6)
    assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= 5 and not (np.abs(code.sum(0)) == 6).any()
    assert langid.language_id(empty).count() == 0 and langid.language_id(docs).count() == docs.count()
    assert {r.lang_pred for r in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_learns_every_language(spark, monkeypatch):
    """Over 1 000 lang values; the rarest one is learned too."""
    rng = np.random.default_rng(1)
    learned = [i for i in range(4_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(6)), f"l{k % 1_005:04d}", "s", 0) for k, i in enumerate(learned[:2_010])]
    rows.append((learned[2_010], "αβγδ εζηθ αβεζ γδηθ", "zz", "s", 0))
    seen, real = [], langid.train
    monkeypatch.setattr(langid, "train", lambda targets, x: seen.extend(targets) or real(targets, x, epochs=1))
    got = langid.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert set(seen) == {r[2] for r in rows} and len(got) == len(rows)
    code = langid.codewords(1_500)
    assert len({tuple(c) for c in code}) == 1_500
    margins = rng.normal(0, 1, (700, code.shape[1]))
    parts = [langid.decode(m[None], code, np.full(code.shape[1], 1 / code.shape[1])) for m in margins[::100]]
    whole = langid.decode(margins, code, np.full(code.shape[1], 1 / code.shape[1]))
    assert all(whole[j][100 * k] == p[j][0] for k, p in enumerate(parts) for j in range(3))


def auc(scores, truth):
    s, y = np.array(scores), np.array(truth)
    a, b = s[y == 1], s[y == 0]
    return (a[:, None] > b[None]).mean()


def test_toxicity(spark, empty, docs):
    rng = np.random.default_rng(0)
    bad = [f"{p}blarghous{s}" for p in ("", "x", "un", "re") for s in ("", "ly", "er", "ing")]
    rows, marks = [], []
    for i in range(900):
        words, y = list(rng.choice(WORDS, 40)), int(i % 3 == 0)
        if y:
            words[int(rng.integers(0, 40))] = bad[int(rng.integers(0, 8)) if i < 600 else int(rng.integers(8, 16))]  # later spellings are new
        rows.append((i, " ".join(words), None, None, 0))
        marks.append((i, 1, y))
    labels = spark.createDataFrame(marks[:600] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels).collect()
    assert auc([r.score for r in got if r.doc_id >= 600], [marks[r.doc_id][2] for r in got if r.doc_id >= 600]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_quality(spark, empty, docs):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(900):
        g = i % 3
        words = [w + ("%%%" if g == 0 and rng.random() < 0.5 else "##" if g == 1 and rng.random() < 0.3 else "") for w in rng.choice(WORDS, 40)]
        rows.append((i, " ".join(words), None, None, 0))
        marks.append((i, g))
    ratings = spark.createDataFrame(marks + [(None, 1), (1, None)], "doc_id long, grade int")
    got = [r for r in quality.quality(spark.createDataFrame(rows, DOCS), ratings).collect() if r.held_out]
    assert auc([r.tail_prob for r in got], [int(r.doc_id % 3 >= 1) for r in got]) > 0.95 and auc([r.expected_grade for r in got], [int(r.doc_id % 3 == 2) for r in got]) > 0.9
    assert all(r.top_prob <= r.tail_prob + 1e-12 for r in got)
    assert quality.quality(empty, ratings).count() == 0
    assert all(r.tail_prob is None and not r.selected for r in quality.quality(docs, ratings.limit(0)).collect())


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", ["a", "b"][k % 2], 0) for k, (i, t) in enumerate(texts)] + [(100 + k, prose(50 + k, 150), "en", "a", 0) for k in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(60, 150)[:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:  # the mix draws, the stages before it keep clean documents
            assert {100 + k for k in range(40)} - {110} <= {r.doc_id for r in docs.collect()}, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
