"""The queries of the corpus operators over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chunks, decontaminate, dialogue, langid, lm, mixing, near, quality, sharding, tokens, topk, toxicity


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; null and empty texts have none. Each of repeated rows has its row."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows, and the items that occur; null texts have no words, null items no windows."""
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, null and empty ones included (the bias alone); learned from labels of rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; null sources are one source, null texts have size 0 and nothing is taken of them."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; null texts and texts without a letter are `und`."""
    found = langid.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return quality.quality(table(spark, sf_dir, "documents"), ratings, at_least=1)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document; null and wordless texts link with nothing, rows with equal sets link."""
    return near.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text; null and empty texts hold only the end. Repeated rows are scored and counted each."""
    return lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query vector; vectors that are null or hold null or non-finite components take no part."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without passages that occur before by id; null and empty texts stay as they are."""
    return chunks.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards by doc_id, of bytes as equal as whole documents allow."""
    return sharding.shard_table(table(spark, sf_dir, "documents"), 40)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the operator's groups their digest; the table of pairs is its other result."""
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), text_of_groups=False)[0]


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after their damage; every original conv_id has its row."""
    found = table(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damage(found), found)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_benchmark_decontamination, op3_toxicity, op4_source_mixing, op5_language_id, op6_quality_classifier, op7_ngram_jaccard_join, op8_lm_scoring, op9_exact_top_k, op10_substring_dedup, op11_sharding, op12_cross_tokenizer_alignment, op13_conversation_repair)}
#: crc32 of a list of bytes, by its table of 256 entries.
_CRC = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"
_CRC_OF = "xor(4294967295, list_reduce([4294967295] || {}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _repair_sql() -> str:
    """op13 as a forward dynamic programme: of each conversation, after each of its rows, the least (cost, audit, turns) by grammar
    state. States that can't be reached cost very much."""
    go = lambda s, cost, edit, turn="[]::VARCHAR[]": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {turn}}}"
    least = lambda *of: f"list_min([{', '.join(of)}])"
    opened = lambda rows: f"SELECT conv_id, i, s0, s1, s2, {least('s3', go('s2', 2, 'I', "['assistant:']"))} AS s3 FROM (SELECT conv_id, i, s0, s1, {least('s2', *(go(f's{k}', 2, 'I', "['user:']") for k in (0, 1, 3)))} AS s2, s3 FROM {rows})"
    far = "CASE WHEN {} THEN 0 ELSE 1000000000 END + cut"
    kept, turned = "[role || ':' || text]", lambda r: f"['{r}:' || text]"
    ok = "fault NOT IN ('b', 'd')"
    to2 = [x for k in (0, 1, 3) for x in (go(f"s{k}", far.format(ok + " AND role[1] = 'u'"), "K", kept), go(f"s{k}", "2 + " + far.format(ok), "R", turned("user")))]
    step = f"""SELECT x.conv_id, x.i + 1 AS i, {go('s0', 3, 'D')} AS s0, {least(go('s1', 3, 'D'), go('s0', far.format(ok + " AND role[1] = 's'"), 'K', kept))} AS s1,
       {least(go('s2', 3, 'D'), *to2)} AS s2, {least(go('s3', 3, 'D'), go('s2', far.format(ok + " AND role[1] = 'a'"), 'K', kept), go('s2', '2 + ' + far.format(ok), 'R', turned('assistant')))} AS s3
FROM way x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1"""
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    return f"""WITH RECURSIVE {_CRC},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
act AS (SELECT *, {_CRC_OF.format("list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)")} % 20 AS act FROM src, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE WHEN act = 1 THEN '' WHEN act = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN act = 3 THEN [0, 1] ELSE [0] END) AS again FROM act WHERE act <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM dmg),
f AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS then_role FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM pos)),
way AS ({opened("(SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, " + f"{none} AS s1, {none} AS s2, {none} AS s3 FROM conversations)")}
UNION ALL {opened(f"({step})")}),
done AS (SELECT conv_id, list_min([s0, s3]) AS s FROM way QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
      count(*) FILTER (then_role IS NOT NULL AND role[1] || then_role NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit, sha256(array_to_string(s.t, chr(10))) AS repaired_sha256
FROM done LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op11_sharding": f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, sum(strlen(coalesce(text, '')) + 16) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(strlen(coalesce(text, '')) + 16) OVER () AS total FROM documents),
s AS (SELECT *, CAST((2 * upto - size) * 40 // (2 * total) AS INTEGER) AS shard FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({_CRC_OF.format("list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, tab""",
    "op13_conversation_repair": _repair_sql(),
    "op2_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS p
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
spot AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, a.n, k, item FROM spot a JOIN win USING (n, p)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
c AS (SELECT row_number() OVER () AS c, g, len(g) AS n, min(doc_id) AS least FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
t AS (SELECT c, n, unnest(g) AS t FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b USING (t) WHERE a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT reach.a AS c, min(c.least) AS component FROM reach JOIN c ON reach.b = c.c GROUP BY reach.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE component END AS component_id
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN comp ON comp.c = c.c""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
