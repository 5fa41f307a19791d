"""The learned, drawn and cutting operators against plain versions of what they do, and the tables that break operators:
columns of any name, ids of any type, repeated ids and rows, rows in another order."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from objectlog.llm import chunks, common, decontaminate, langid, lm, mixing, near, quality, tokens, topk, toxicity
from objectlog.llm.subword import BASE, LETTERS, MIX
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix liquid jugs of rum and pack five dozen boxes".split()
#: Names that operators use inside, as columns of the documents.
CLASHES = ["chunks", "doc_key", "text_hash", "k0", "k1", "k2", "n_words", "hit_spans", "hit_items", "row", "node", "root", "score", "lang_pred", "ambiguous", "held_out", "size", "copies", "copy", "p", "block", "base", "shingle", "number", "meta", "h1", "h2", "word", "n", "target", "draw", "n_runs", "kept_bytes", "a.b", "with space"]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def bucket(gram: bytes, n: int, buckets: int, whole: bool = False) -> int:
    """The bucket of one n-gram of bytes, letter by letter."""
    h, mask = 0, (1 << 64) - 1
    if whole:
        h = sum((b + 1) * pow(int(BASE), k, 1 << 64) for k, b in enumerate(gram)) & mask
        mixed = h * int(MIX) * int(MIX) & mask
    else:
        for b in gram:
            h = (h * int(BASE) + b + 1) & mask
        mixed = (h * int(MIX) + n) * int(MIX) & mask
    return mixed >> (64 - (buckets - 1).bit_length())


def word_score(word: bytes, weights: np.ndarray, sizes: tuple) -> np.ndarray:
    """The mean weight of a word's n-grams and of the word itself."""
    marked = b"<" + word + b">"
    ids = [bucket(marked[k : k + n], n, len(weights)) for n in sizes for k in range(len(marked) - n + 1)] + [bucket(marked, 0, len(weights), True)]
    return weights[ids].mean(0)


def plain(text):
    return (text or "").lower().encode().translate(LETTERS).split()


@pytest.fixture(scope="module")
def texts():
    return [(0, None), (1, ""), (2, "12 ?!"), (3, prose(1, 30)), (4, prose(2, 400)), (5, "Été ÉTÉ 日本語 " * 3), (6, prose(1, 30)), (6, prose(1, 30)), (None, prose(3, 9)), (7, "y" * 2_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


def test_toxicity_by_hand(docs, texts, monkeypatch):
    """Scores from given weights, n-gram by n-gram."""
    w, bias = np.random.default_rng(0).normal(0, 3, (toxicity.BUCKETS, 1)), -0.3
    monkeypatch.setattr(toxicity, "train", lambda *_: (w, bias))
    got = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, docs.selectExpr("doc_id", "1 as toxic")).withColumn("score", F.round("score", 5)).collect()}
    want = set()
    for i, t in texts:
        bag = set(plain(t))
        z = bias + (np.mean([word_score(x, w, toxicity.SIZES)[0] for x in bag]) if bag else 0.0)
        want.add((i, round(1 / (1 + math.exp(-z)), 5)))
    assert {i for i, _ in got} == {i for i, _ in want} and all(min(abs(s - x) for j, x in want if j == i) < 1e-4 for i, s in got)


def test_language_by_hand(docs, texts, monkeypatch):
    """Margins, losses and the nearest codeword from given weights."""
    rng = np.random.default_rng(1)
    names, code = ["aa", "bb", "cc"], langid.codewords(3)
    w, b, say = rng.normal(0, 2, (langid.BUCKETS, code.shape[1])), rng.normal(0, 0.1, code.shape[1]), rng.random(code.shape[1])
    monkeypatch.setattr(langid, "train", lambda *_: (names, code, w, b, say / say.sum()))
    got = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.language_id(docs).collect()]
    want = []
    for i, t in texts:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, "und", 0.0))
            continue
        margin = np.mean([word_score(x, w, langid.SIZES) for x in plain(t)], axis=0) + b
        loss = np.array([sum(say / say.sum() * np.log1p(np.exp(-margin * c))) * code.shape[1] for c in code])
        p = np.exp(-loss) / np.exp(-loss).sum()
        want.append((i, names[int(p.argmax())], round(float(p.max()), 3)))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))


def test_quality_by_hand(docs, texts, monkeypatch):
    """Expected grade and tails from given weights and thresholds."""
    w, cuts, grades = np.random.default_rng(2).normal(0, 0.2, (quality.BUCKETS, 1)), np.array([-0.4, 0.7]), [0, 1, 2]
    monkeypatch.setattr(quality, "train", lambda *_: (grades, w, cuts))
    got = quality.quality(docs, docs.selectExpr("doc_id", "1 as grade")).collect()
    for r in got:
        near_ = []
        for t in {t for i, t in texts if i == r.doc_id}:
            bag = set(quality.raw_words(t))
            f = (quality.GAIN * np.mean([word_score(x, w, quality.SIZES)[0] for x in bag]) if bag else 0.0) + sum(w[k, 0] for k in quality.style(t, quality.raw_words(t)))
            above = [1.0] + [1 - 1 / (1 + math.exp(-(c - f))) for c in cuts]
            near_.append((sum(above[1:]), above[1], above[2]))
        assert any(np.allclose(x, (r.expected_grade, r.tail_prob, r.top_prob), atol=1e-4) for x in near_) and r.selected == (r.tail_prob >= 0.5)


def test_quality_learns_every_grade(spark):
    """Twenty grades, more than any cap would leave."""
    rows = [(i, f"g{i % 20} " * 10 + prose(i, 5), "en", "s", 0) for i in range(900)]
    seen = []
    real = quality.train
    try:
        quality.train = lambda targets, x: seen.extend(targets) or real(targets, x, epochs=1)
        quality.quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 20) for i in range(900)], "doc_id long, grade int")).count()
    finally:
        quality.train = real
    assert set(seen) == set(range(20))


def test_samples_are_bounded(spark):
    """Whatever ids, labels and rows repeat, and however long texts are."""
    rows = [(1, f"{prose(k, 4)} {k}", "en", "s", 0) for k in range(3_000)] + [(k, prose(k, 6), "de", "s", 0) for k in range(2, 500)] + [(600, "z " * 50_000, "fr", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    marks = spark.createDataFrame([(1, 0)] * 50 + [(k, k % 2) for k in range(500)], "doc_id long, target long")
    got = common.labelled(marks, df, 3, 2, 1, 1 << 20).collect()
    assert 2 <= len(got) <= 6 and all(n <= 3 for n in Counter(r.target for r in got).values())
    few = common.bounded(df.withColumn("target", F.col("lang")), 10, 3, 1, 1_000).collect()
    assert Counter(r.target for r in few) == {"en": 10, "de": 10, "fr": 1} and sum(len(r.text) for r in few if r.target != "fr") <= 2_000
    nulls = spark.createDataFrame([(None, prose(k, 20), "en", "s", 0) for k in range(900)], DOCS)
    assert {r.lang_pred for r in langid.language_id(nulls).collect()} == {"en"}  # rows without an id are drawn one by one
    again = common.bounded(df.repartition(3).withColumn("target", F.col("lang")), 10, 3, 1, 1_000).collect()
    assert Counter(map(tuple, few)) == Counter(map(tuple, again))


def test_scores_of_the_lattice(spark, docs, texts):
    """The score of every document is the sum over its words' lattices and the end, repeated and long words included."""
    path, seen = str(public.path("piece_bpe_32k.model")), []
    real = lm.Lattice.refitted
    try:
        lm.Lattice.refitted = lambda self, *a: seen.append(real(self, *a)) or seen[-1]
        got = lm.lm_scores(docs.repartition(4), path, frequent=5).collect()
    finally:
        lm.Lattice.refitted = real
    model = seen[-1]
    score = lambda t: sum(model.words([w])[0][0] for w in lm.lower_words((t or "").encode())) + model.end_logp
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((i, score(t) / math.log(10)) for i, t in texts), key=key), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-6)


def naive_dedup(rows, least):
    """Digests of chunk pairs in a dictionary, in the order of ids; runs of repeats cut out."""
    first, marks = {}, []
    keyed = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in keyed:
        text = (rows[k][1] or "").encode()
        ends = chunks.boundaries(text)
        pairs = [text[([0, 0, *ends])[j] : e] for j, e in enumerate(ends)]
        marks.append((k, text, ends, [first.setdefault(p, (k, j)) != (k, j) for j, p in enumerate(pairs)]))
    out = {}
    for k, text, ends, again in marks:
        edge, gone = [0, *ends], np.zeros(len(text), bool)
        hit = [False] * len(ends)
        for j, x in enumerate(again):
            if x:
                hit[j] = True
                hit[max(j - 1, 0)] = True
        j = 0
        while j < len(hit):
            end = j
            while end < len(hit) and hit[end]:
                end += 1
            if end > j and edge[end] - edge[j] >= least:
                gone[edge[j] : edge[end]] = True
            j = max(end, j + 1)
        out[k] = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode()
    return out


def test_substring_dedup_by_hand(spark):
    rng = np.random.default_rng(5)
    pool = [prose(100 + k, 60) for k in range(5)]
    rows = [(int(i), " ".join([prose(200 + i, 30), pool[int(rng.integers(5))], prose(300 + i, 25), pool[int(rng.integers(5))]])) for i in rng.permutation(40)] + [(41, pool[0] + " " + pool[0]), (42, None), (43, "")]
    got = {r.doc_id: r for r in chunks.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = naive_dedup(rows, chunks.MIN_RUN)
    for k, (i, t) in enumerate(rows):
        assert (got[i].text or "") == want[k] and got[i].kept_bytes == len(want[k].encode()) and (got[i].n_runs > 0) == (want[k] != (t or ""))


def test_targets_as_fractions():
    """The reshared targets against exact arithmetic."""
    from fractions import Fraction

    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = [(f"s{k}" if k else None, int(rng.integers(0, 1_000) ** 2)) for k in range(int(rng.integers(1, 12)))]
        order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        weight, left, total, goal = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}, dict(order), sum(n for _, n in order), {}
        while left:
            rest, share = total - sum(goal.values()), sum(weight[s] for s in left)
            above = [s for s in left if Fraction(rest * weight[s], share) > 3 * left[s]]
            for s in above or list(left):
                goal[s] = Fraction(3 * left[s]) if above else Fraction(rest * weight[s], share)
            left = {s: n for s, n in left.items() if s not in goal}
        got = mixing.targets(sizes)
        assert all(math.isclose(got[s], float(goal[s]), rel_tol=1e-9, abs_tol=1e-6) for s in goal)


def test_mixing_of_repeated_rows(spark):
    """A third of all rows agree: they are dealt over blocks, and any order of rows gives the same."""
    rows = [(1, "w " * 9, None, "a", 0)] * 1_000 + [(k, "w " * (k % 30 + 1), None, "ab"[k % 2], 0) for k in range(2, 2_000)]
    df = spark.createDataFrame(rows, DOCS)
    one, two = (Counter((r.doc_id, r.taken) for r in mixing.mix(d, block=100).collect()) for d in (df, df.repartition(9)))
    assert one == two and sum(one.values()) == len(rows)
    total = {s: sum(r.taken for r in mixing.mix(df, block=100).collect() if r.source == s) for s in "ab"}
    goal = mixing.mix(df).select("source", "target").distinct().collect()
    assert all(abs(total[r.source] - r.target) <= 31 for r in goal)


def test_columns_of_any_name(spark, texts):
    """Every stage and every operator that keeps columns, over documents that have columns named as its own."""
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    wide = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(1, prose(2, 400)[50:150])], "item_id long, text string")
    out = {"near": near.one_of_each(wide, 5, 80), "chunks": chunks.deduplicated(wide).select("row.*"), "bench": decontaminate.remove_benchmark(wide, bench), "lang": langid.identified(wide).select("row.*")}
    for name, got in out.items():
        assert got.columns == wide.columns, name
        held = [r.asDict() for r in got.collect()]
        assert held and all(r[c] == f"own {c}" for r in held for c in CLASHES), name
    assert langid.language_id(wide).columns.count("score") == 1 and chunks.substring_dedup(wide).count() == len(texts)
    assert decontaminate.find_benchmark(wide, bench).filter("size(hit_spans) > 0").count() == 1
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(wide, labels).count() == quality.quality(wide, labels.withColumnRenamed("quality", "grade")).count() == mixing.mix(wide).count() == len(texts)
    assert tokens.token_counts(wide, str(public.path("word_bpe_49k.json"))).count() == near.jaccard_components(wide).count() == len(texts)
    vectors = spark.createDataFrame([(k, [0.1 * k, 1.0]) for k in range(60)], "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("v", "wide", "dim", "q", "c", "copy", "n")])
    assert topk.exact_top_k(vectors).count() == 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "source_mixing"]


def test_ids_as_text(spark, texts):
    """Ids that are text: the smallest one of a group stays, first occurrences are told by them."""
    df = spark.createDataFrame([("b", prose(1, 60)), ("a", prose(1, 60)), ("z", "x " + prose(2, 80)), ("y", prose(2, 80) + " q"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in near.one_of_each(df, 5, 80).collect()} == {"a", "y", None}
    got = {r.doc_id: r for r in chunks.substring_dedup(df).collect()}
    assert got["a"].n_runs == 0 and got["b"].n_runs == 1 and got["y"].n_runs == 0 and got["z"].n_runs == 1
    assert {r.component_id for r in near.jaccard_components(df).collect()} == {"a", "y", None}
    assert tokens.token_counts(df, str(public.path("word_bpe_49k.json"))).count() == lm.lm_scores(df, str(public.path("piece_bpe_32k.model"))).count() == 5


def test_rows_in_another_order(spark, texts):
    """Token counts and scores don't depend on how rows lie in tasks, rows that agree included."""
    rows = [(i, t, None, None, 0) for i, t in texts] * 3
    a = spark.createDataFrame(rows, DOCS)
    b = a.repartition(11).orderBy(F.rand(3))
    count = lambda d: Counter(map(tuple, tokens.token_counts(d, str(public.path("word_bpe_49k.json")), frequent=2).collect()))
    score = lambda d: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in lm.lm_scores(d, str(public.path("piece_bpe_32k.model")), frequent=2).collect())
    assert count(a) == count(b) and sum(count(a).values()) == len(rows) and score(a) == score(b) and sum(score(a).values()) == len(rows)


def test_repeated_vectors(spark):
    """Many copies of one row: as many as a result can hold take part."""
    rows = [(7, [1.0, 1.0])] * 500 + [(k, [0.5, k / 100]) for k in range(100)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, k, 7) for q in (0, 50) for k in range(1, 6)}


def test_template_pages_need_no_pairs(spark, monkeypatch):
    """Pages of one template with a tenth of own words don't link, and are not compared with each other."""
    base, rng, seen = [f"t{k}" for k in range(300)], np.random.default_rng(0), []
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(0, 300, 36):
            words[int(k + rng.integers(0, 8))] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    real = near.materialise
    monkeypatch.setattr(near, "materialise", lambda df, name: (seen.append(out.count()) if name == "near-pairs" else None, out)[1] if (out := real(df, name)) is not None else None)
    got = near.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got) and sum(seen) < 4 * len(rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
