"""Full-text search over chunks: an inverted index as a table, BM25, phrases and their combination."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..log import ObjectLog
from ..sources.staging import staged
from .crowds import dealt

#: Fixed value: a token is a run of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.5, 0.75
#: Which chunk types the groups `schema` and `data` stand for.
GROUPS = {"schema": ("event_types", "object_types"), "data": ("events", "objects")}


def tokens_of(text: Column) -> Column:
    """Lower-cased tokens of a text, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_terms(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


def term_table(chunks: DataFrame) -> DataFrame:
    """term, df, cf: in how many chunks a token stands and how often."""
    words = chunks.select("id", F.explode(tokens_of(F.col("content"))).alias("term"))
    per = words.groupBy("id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _several(chunks: DataFrame) -> DataFrame:
    """id2, type2: the chunks of several rows."""
    return chunks.groupBy("id", "chunk_type").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("id2"), F.col("chunk_type").alias("type2"))


#: How many chunks of several rows are broadcast when an index is built.
MERGED = 100_000


def inverted_index(chunks: DataFrame) -> DataFrame:
    """term, id, chunk_type, tf, positions (from 0): one row for each token of each chunk; rows that share id and type are
    one chunk.

    A chunk of one row gets its postings inside the row, by a sort of its tokens; only those of several rows are shuffled
    as tokens.
    """
    return _postings(chunks, _several(chunks)).drop("dl")


def _postings(chunks: DataFrame, several: DataFrame) -> DataFrame:
    """`inverted_index` with dl, the number of the chunk's tokens; ``several`` are its chunks of several rows."""
    key = ("id", "chunk_type")
    rows = chunks.select(*key, "content")
    same = F.col("id").eqNullSafe(F.col("id2")) & F.col("chunk_type").eqNullSafe(F.col("type2"))
    pairs = F.transform(tokens_of(F.col("content")), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    alone = rows.join(several, same, "left_anti").select(*key, F.sort_array(pairs).alias("at"))
    term = lambda i: F.col("at")[i]["term"]
    starts = F.filter(F.transform("at", lambda _, i: i), lambda i: (i == 0) | (term(i) != term(F.greatest(i - 1, F.lit(0)))))
    alone = alone.select(*key, "at", starts.alias("starts"))
    run = lambda a, k: F.slice("at", a + 1, F.coalesce(F.try_element_at("starts", k + 2), F.size("at")) - a)
    runs = F.transform("starts", lambda a, k: F.struct(term(a).alias("term"), F.transform(run(a, k), lambda x: x["pos"]).alias("positions")))
    one = alone.select(*key, F.size("at").cast("long").alias("dl"), F.inline(runs)).select("term", *key, F.size("positions").cast("long").alias("tf"), "positions", "dl")
    at = rows.join(several, same, "left_semi").select(*key, F.posexplode(tokens_of(F.col("content"))).alias("pos", "term"))
    of_chunk = at.groupBy("term", *key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return one.unionByName(of_chunk.withColumn("dl", F.sum("tf").over(Window.partitionBy(*key))))


def _of_types(chunks: DataFrame, types: list[str] | None) -> DataFrame:
    if not types:
        return chunks
    names = [t for x in types for t in GROUPS.get(x, (x,))]
    return chunks.filter(F.col("chunk_type").isin(names))


def _ranked(scored: DataFrame, k: int | None) -> DataFrame:
    """id and score, the best k first (all, in any order, without k)."""
    out = scored.select("id", "score")
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def _nothing(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "chunk_type", F.lit(0.0).alias("score")).limit(0)


def _bm25(chunks: DataFrame, query: str, types: list[str] | None, k1: float = K1, b: float = B) -> DataFrame:
    """id, chunk_type, score of every chunk with a term of the query."""
    terms = list(dict.fromkeys(query_terms(query)))
    if not terms:
        return _nothing(chunks)
    toks = chunks.select("id", "chunk_type", tokens_of(F.col("content")).alias("t"))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [times(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = toks.select("id", "chunk_type", F.size("t").alias("dl"), *tf)
    whole = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    hit = F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0
    score = sum(
        (
            F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
            for i in range(len(terms))
        ),
        F.lit(0.0),
    )
    return _of_types(counted.filter(hit), types).crossJoin(F.broadcast(whole)).select("id", "chunk_type", F.round(score, 6).alias("score"))  # one row


def bm25(chunks: DataFrame, query: str, k: int | None = 5, types: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """id, score (rounded to 6): Okapi BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)), over the idf and length of all
    chunks; types filter what is returned. Only the query's terms are counted, inside each chunk, with no shuffle of
    tokens. Ties by id."""
    return _ranked(_bm25(chunks, query, types, k1, b), k)


def _phrase(chunks: DataFrame, query: str, types: list[str] | None) -> DataFrame:
    terms = query_terms(query)
    if not terms:
        return _nothing(chunks)
    # Tokens hold no space, so neighbours can be found in their joined text, which is built once.
    here = F.contains(F.concat(F.lit(" "), F.array_join(tokens_of(F.col("content")), " "), F.lit(" ")), F.lit(f" {' '.join(terms)} "))
    return _kept(_bm25(chunks, query, types), chunks.filter(here))


def phrase(chunks: DataFrame, query: str, k: int | None = 5, types: list[str] | None = None) -> DataFrame:
    """id, score (rounded to 6): chunks in which the query's tokens stand next to each other, by BM25 of its terms."""
    return _ranked(_phrase(chunks, query, types), k)


def hybrid(chunks: DataFrame, query: str, k: int = 5, types: list[str] | None = None) -> DataFrame:
    """id, score: the best 2k by phrase and by BM25, half of each score, summed where both have the chunk."""
    return _halves(_phrase(chunks, query, types), _bm25(chunks, query, types), k)


def _kept(scored: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks of ``scored`` that are in ``found``; a chunk is known by its id and its type."""
    ids = found.select(F.col("id").alias("id_"), F.col("chunk_type").alias("type_"))
    return scored.join(ids, F.col("id").eqNullSafe(F.col("id_")) & F.col("chunk_type").eqNullSafe(F.col("type_")), "left_semi")


def _halves(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    best = lambda df, name: df.orderBy(F.desc("score"), "id").limit(2 * k).select("id", F.coalesce("chunk_type", F.lit("")).alias("type"), F.col("score").alias(name))
    score = F.round(0.5 * F.coalesce("p", F.lit(0.0)) + 0.5 * F.coalesce("s", F.lit(0.0)), 6)
    return best(first, "p").join(best(second, "s"), ["id", "type"], "full").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


MODES = {"bm25": bm25, "phrase": phrase, "hybrid": hybrid}


def search(chunks: DataFrame, query: str, k: int = 5, types: list[str] | None = None, mode: str = "bm25") -> DataFrame:
    """Search by mode: bm25, phrase or hybrid."""
    return MODES[mode](chunks, query, k, types)


#: Up to how many bytes of a log phrases are searched alone, and from where on BM25 alone.
SMALL, LARGE = 5_000_000, 100_000_000


def strategy(size: int, force: str | None = None) -> str:
    """How a log of so many bytes is searched: phrase, hybrid or bm25; ``force`` names one."""
    if force is not None and force not in MODES:
        raise ValueError(f"no strategy {force!r}; there are {sorted(MODES)}")
    return force or ("phrase" if size < SMALL else "bm25" if size > LARGE else "hybrid")


@dataclass(frozen=True)
class Index:
    """A stored inverted index: postings by bucket of their term, sorted by it, so that a search reads those of its own terms."""

    postings: DataFrame  # bucket, term, id, chunk_type, tf, positions, dl
    totals: DataFrame  # one row: n, avgdl, bytes
    buckets: int
    mode: str = "bm25"

    @staticmethod
    def build(chunks: DataFrame, folder: str, buckets: int = 64, force: str | None = None) -> Index:
        """Index ``chunks`` (id, content, chunk_type) into a folder; rows that share id and type are one chunk."""
        several = staged(_several(chunks), "several")
        if several.limit(MERGED + 1).count() <= MERGED:
            several = F.broadcast(several)  # so that texts stay where they are
        posted = _postings(chunks, several).withColumn("bucket", _bucket(F.col("term"), buckets))
        # Lengths are counted from the texts once more, which costs less than to write and join all postings for them.
        said = chunks.select("id", "chunk_type", F.size(tokens_of(F.col("content"))).alias("dl"), F.octet_length("content").alias("bytes"))
        lengths = said.groupBy("id", "chunk_type").agg(F.sum("dl").alias("dl"), F.sum("bytes").alias("bytes"))
        # Several files a bucket at scale: the order of rows within each is what lets row groups be skipped.
        posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
        lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/totals")
        return Index.open(chunks.sparkSession, folder, force)

    @staticmethod
    def open(spark: SparkSession, folder: str, force: str | None = None) -> Index:
        """An index that `build` has written."""
        totals = spark.read.parquet(f"{folder}/totals")
        said = totals.first()
        schema = "term string, id string, chunk_type string, tf long, positions array<int>, dl long, bucket int"
        return Index(spark.read.schema(schema).parquet(f"{folder}/postings"), totals.drop("buckets"), said.buckets, strategy(said.bytes, force))

    def info(self) -> dict:
        """The strategy, megabytes of text, chunks, and that there is an index."""
        said = self.totals.first()
        return {"strategy": self.mode, "size_mb": round(said.bytes / 1e6, 2), "chunks": said.n, "indexed": True}

    def _of(self, terms: list[str]) -> DataFrame:
        spark = self.postings.sparkSession
        wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets)).collect()})
        return self.postings.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))

    def _bm25(self, query: str, types: list[str] | None, k1: float = K1, b: float = B) -> DataFrame:
        terms = list(dict.fromkeys(query_terms(query)))
        if not terms:
            return _nothing(self.postings)
        mine = self._of(terms)
        df = mine.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        rows = _of_types(mine, types).join(F.broadcast(df), "term").crossJoin(F.broadcast(self.totals.select("n", "avgdl")))  # one row
        return rows.groupBy("id", "chunk_type").agg(F.round(F.sum(part), 6).alias("score"))

    def bm25(self, query: str, k: int | None = 5, types: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """As `bm25` over the chunks."""
        return _ranked(self._bm25(query, types, k1, b), k)

    def _phrase(self, query: str, types: list[str] | None) -> DataFrame:
        terms = query_terms(query)
        if not terms:
            return _nothing(self.postings)
        wide = self._of(terms).groupBy("id", "chunk_type").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)])
        follows = lambda p: F.forall(F.array(*[F.array_contains(F.col(f"p{i}"), p + i) for i in range(1, len(terms))]), lambda x: x) if len(terms) > 1 else F.lit(True)
        return _kept(self._bm25(query, types), wide.filter(F.forall(F.array(*[F.col(f"p{i}").isNotNull() for i in range(len(terms))]), lambda x: x)).filter(F.exists("p0", follows)))

    def phrase(self, query: str, k: int | None = 5, types: list[str] | None = None) -> DataFrame:
        """As `phrase` over the chunks: by the positions of the query's terms."""
        return _ranked(self._phrase(query, types), k)

    def hybrid(self, query: str, k: int = 5, types: list[str] | None = None) -> DataFrame:
        """As `hybrid` over the chunks."""
        return _halves(self._phrase(query, types), self._bm25(query, types), k)

    def search(self, query: str, k: int = 5, types: list[str] | None = None, mode: str | None = None) -> DataFrame:
        """Search by a mode, or by the index's own strategy."""
        return {"bm25": self.bm25, "phrase": self.phrase, "hybrid": self.hybrid}[mode or self.mode](query, k, types)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Values of a label that a chunk lists with their counts; of more than these it lists some.
FULL, SOME = 1_000, 10


def _hex(c: str, digits: int) -> Column:
    """The first hexadecimal digits of a text's MD5, as a number: batches that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(c), F.lit(""))), 1, digits), 16, 10).cast("long")


def _told(said: DataFrame, keys: list[str], full: int = FULL, some: int = SOME) -> DataFrame:
    """keys and content: of rows (keys, label, value) a line for each label with its values and how often they occur, all of
    them if there are at most ``full``, else their number and ``some`` of them. Labels and values in order."""
    # Dealt by value first, so that a label of very many values is counted by many tasks.
    values = dealt(said.filter("value is not null"), *keys, "label", "value").groupBy(*keys, "label", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys, "label").orderBy("value")
    both = dealt(values, *keys).withColumn("distinct", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # Of very many values only about ten times those wanted are numbered.
    both = both.filter((F.col("distinct") <= full) | (F.pmod(F.xxhash64("value"), F.col("distinct")) < 10 * some))
    both = both.withColumn("_place", F.row_number().over(order)).filter((F.col("distinct") <= full) | (F.col("_place") <= some))
    entry = F.concat_ws(" ", "value", F.when(F.col("distinct") <= full, F.col("n").cast("string")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("value", entry.alias("entry")))), lambda x: x["entry"]), ", ")
    lines = both.groupBy(*keys, "label", "distinct").agg(listed.alias("listed"))
    line = F.concat(F.ltrim("label"), F.lit(": "), F.when(F.col("distinct") > full, F.concat(F.col("distinct").cast("string"), F.lit(" values, such as "))).otherwise(""), F.col("listed"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))


def event_chunks(log: ObjectLog, per: int = 100) -> DataFrame:
    """id, content, chunk_type, n: events in batches of ``per`` by time. The content tells the activities, the span of time, the ids of the
    events and of their objects, and the values of each attribute, with counts (see `_told`).

    Batches are cut within days and sixteen lanes of ids, so no window holds more than a lane of a day.
    """
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))
    order = Window.partitionBy("day", "lane").orderBy("ts", "eid")
    rows = dealt(log.events.withColumn("day", day).withColumn("lane", _hex("eid", 1)), "day", "lane").withColumn("batch", F.floor((F.row_number().over(order) - 1) / per))
    keys = ["day", "lane", "batch"]
    rows = rows.select(*keys, "eid", "activity", "ts", "attrs")
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    attrs = F.transform(F.map_entries("attrs"), lambda a: pair(a["key"], a["value"]))
    own = F.array(pair(F.lit(" activities"), F.col("activity")), pair(F.lit(" events"), F.col("eid")))
    own = rows.select(*keys, F.inline(F.concat(own, F.coalesce(attrs, F.array().cast("array<struct<label:string,value:string>>")))))
    related = dealt(log.e2o.select("eid", "oid"), "eid", beside=(log.events,)).distinct()
    objects = dealt(rows.select(*keys, "eid"), "eid", beside=(log.e2o,)).join(related, "eid").select(*keys, F.lit(" objects").alias("label"), F.col("oid").alias("value"))
    told = _told(own.unionByName(objects), keys)
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws(" ", F.lit("time:"), F.min("ts").cast("string"), F.max("ts").cast("string")).alias("span"))
    return span.join(told, keys, "left").select(F.concat_ws("_", F.lit("events"), *keys).alias("id"), F.concat_ws("\n", "span", "content").alias("content"), F.lit("events").alias("chunk_type"), "n")


def object_chunks(log: ObjectLog, per: int = 100) -> DataFrame:
    """id, content, chunk_type, n: objects of a type in hashed batches of about ``per``, with their ids, the values that their
    attributes have had and the objects that they are related to, with counts (see `_told`)."""
    sizes = log.objects.groupBy("otype").agg(F.ceil(F.count("*") / per).alias("batches"))
    keys = ["otype", "batch"]
    rows = log.objects.join(sizes, "otype").select(F.col("otype"), (_hex("oid", 8) % F.col("batches")).alias("batch"), "oid")
    of = lambda df, label, value: df.select(*keys, F.lit(label).alias("label"), F.col(value).alias("value"))
    attrs = rows.join(log.changes.select("otype", "oid", F.explode("attrs").alias("label", "value")), ["otype", "oid"]).select(*keys, "label", "value")
    related = rows.join(log.o2o.select(F.col("src_oid").alias("oid"), "tgt_oid"), "oid")
    told = _told(of(rows, " objects", "oid").unionByName(of(related, " related", "tgt_oid")).unionByName(attrs), keys, max(FULL, 2 * per))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(told, keys, "left").select(F.concat_ws("_", F.lit("objects"), *keys).alias("id"), F.concat_ws("\n", F.concat_ws(" ", F.lit("objects"), "otype"), "content").alias("content"), F.lit("objects").alias("chunk_type"), "n")


def type_chunks(log: ObjectLog) -> DataFrame:
    """id, content, chunk_type, n: one chunk each for event types and object types, with their attributes."""
    said = F.concat_ws(" ", "name", F.transform("attributes", lambda a: F.concat_ws(":", a["name"], a["type"])))
    one = lambda df, name: df.agg(F.concat_ws("\n", F.sort_array(F.collect_list(said))).alias("content"), F.count("*").alias("n")).select(F.lit(name).alias("id"), "content", F.lit(name).alias("chunk_type"), "n")
    return one(log.event_types, "event_types").unionByName(one(log.object_types, "object_types"))


def chunks(log: ObjectLog, per: int = 100) -> DataFrame:
    """All chunks of a log."""
    return type_chunks(log).unionByName(event_chunks(log, per)).unionByName(object_chunks(log, per))


def value_summary(log: ObjectLog, full: int = 20, samples: int = 10) -> DataFrame:
    """attribute, distinct_values, histogram (value to count; all values if there are at most ``full``, else the ``samples``
    most frequent ones) of the events' attributes."""
    values = log.events.select(F.explode("attrs").alias("attribute", "value")).filter("value is not null").groupBy("attribute", "value").agg(F.count("*").alias("n"))
    n = values.groupBy("attribute").agg(F.count("*").alias("distinct_values"))
    top = Window.partitionBy("attribute").orderBy(F.desc("n"), "value")
    lane = Window.partitionBy("attribute", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("n"), "value")
    few = values.withColumn("k", F.row_number().over(lane)).filter(F.col("k") <= full).withColumn("k", F.row_number().over(top)).filter(F.col("k") <= full)
    kept = few.join(n, "attribute").filter((F.col("distinct_values") <= full) | (F.col("k") <= samples))
    return kept.groupBy("attribute", "distinct_values").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("histogram"))
