"""N-gram Jaccard join with adaptive multi-match prefixes (after Wang, Li and Feng 2012).

Documents become sets of word shingles; equal sets are one class. All sets are ordered alike, rare shingles first. Two sets
that link share at least l shingles within their l-prefixes, so a longer prefix may ask for more matches. Each class takes
the l with the least estimated cost from the frequencies of its prefix and emits that prefix as postings. Of a prefix, a
first part is indexed: a pair meets only in shingles that the smaller set has in that part, which is shorter since the
larger set must share as much of itself. A pair with min(l, l') such shingles is a candidate, and is verified by its sets.

Pairs come from the posting lists in two rounds. First each list pairs its classes with one hub, the same for most lists of
a group of near copies: the class whose prefix holds most frequent shingles, since edits leave shingles that no other has. What verified links join to one hub isn't compared again: the second round pairs, in each list, the
classes outside its largest group with all others of other groups, in blocks. A group of near copies so costs about as much
as its size, and no list of it is paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OUT_ROWS, cleaned, discard, lean, materialise, rowed, send, slices
from .components import components

#: Shingles whose frequency orders the prefixes (the most frequent ones); all others come first, in the order of their hash.
FREQUENT = 500_000
#: One in how many of a task's single shingles is counted, for so many.
CHANCE = 16
#: Cost, against passing on a posting, of a pair that meets in a list, and of verifying one for each shingle of the set; and
#: how many others hold a shingle outside the frequent ones.
MEET, VERIFY, RARE = 1.0, 0.1, 0.25
#: l is at least this many percent of a set, so that its longest lists, of which one less than l is out, make no candidates.
LEAST_SHARE = 6
#: Postings of a frequent shingle in a lane, and of any list in a block.
LANE, LIST = 10_000, 2_048
#: Keys of a class of which pairs are made.
PAIRED = 32
#: What may stand for l and for a set's size in a posting.
MOST, SIZES = (1 << 24) - 1, (1 << 32) - 1
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Shingler:
    """Sets of shingle hashes (sorted, 64 bits) of texts; words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""

    def __init__(self, width: int = 4):
        self.width, self.known = width, {}

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        known, out = self.known, []
        if len(known) > 400_000:
            known.clear()
        for text in texts:
            words = text.lower().split() if text else []
            ids = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxh3_64_intdigest(w)
                ids.append(h)
            a = np.array(ids, np.uint64)
            if not ids:
                out.append(a)
                continue
            w = min(self.width, len(a))
            h = np.full(len(a) - w + 1, np.uint64(w), np.uint64)
            for k in range(w):
                h = (h ^ a[k : len(a) - w + 1 + k]) * _P[k % 8]
                h ^= h >> np.uint64(29)
            out.append(np.unique(h))
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[list]:
    for part in slices(batch, "text"):
        yield part.column("text").to_pylist()


def frequent_shingles(texts: DataFrame, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and document counts of the most frequent shingles, at most ``most``.

    Counts leave a part of a task's documents as they are from two on; a shingle that is there once leaves with the chance of
    one in ``CHANCE`` and counts so many times, if that happens twice. So shingles that many tasks see once are found, at
    little to shuffle. Counts order the prefixes and choose l; the links are the same whatever they are.
    """

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(width), [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, size / (5 * most))
            mixed = (h ^ h[0] ^ np.uint64(size)) * _P[0]
            drawn = ~often & (((mixed ^ mixed >> np.uint64(32)) * _P[1]) >> np.uint64(32) < np.uint64((1 << 32) // CHANCE))
            return pa.record_batch([pa.array(np.concatenate([h[often], h[drawn]]).view(np.int64)), pa.array(np.concatenate([n[often], n[drawn] * CHANCE])), pa.array(np.repeat([True, False], [often.sum(), drawn.sum()]))], names=["shingle", "n", "sure"])

        for batch in found:
            for texts_ in _texts(batch):
                own = shingler(texts_)
                held += own
                size += sum(map(len, own))
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counted = texts.mapInArrow(lean(count), "shingle long, n long, sure boolean").groupBy("shingle").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"), F.count("*").alias("parts"))
    with cleaned(texts.sparkSession):
        # One draw alone tells nothing: most shingles are there once.
        got = counted.filter("sure or parts > 1").select("shingle", "n").orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    h = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("n").to_numpy()[order]


def prefix(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The adaptive prefix of a set, how often its shingles occur (0: not a frequent one), and l."""
    n = len(own)
    least = -(-percent * n // 100)  # a linked set of this size or a smaller one shares at least so many
    most = -(-2 * percent * n // (100 + percent))  # and one of this size or a larger one so many
    times = np.zeros(n, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], own), len(frequent[0]) - 1)
        times = np.where(frequent[0][at] == own, frequent[1][at], 0)
    order = np.lexsort((own, times))
    low = -(-LEAST_SHARE * n // 100)
    reach = np.arange(low, max(low, min(least, n // 6, MOST)) + 1)
    meets = np.cumsum(times[order] + RARE)[n - most + reach - 1]
    l = int(reach[np.argmin(reach + meets * (MEET + VERIFY * n / reach))])  # noqa: E741
    order = order[: n - least + l]
    return own[order], times[order], l


def verified(found: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (node_a, node_b, linked, size_a, size_b, diff) of pairs (node_a, node_b, home, set_a, set_b): those that link, and those
    of which a is the home of b, with the shingles that only one of them has if these are few."""
    for batch in found:
        for at in range(0, batch.num_rows, 1_024):
            part = batch.slice(at, 1_024)
            out: list[list] = [[], [], [], [], []]
            for x, y, home in zip(part.column("set_a"), part.column("set_b"), part.column("home"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                diff = np.setxor1d(x, y, assume_unique=True)
                linked = (100 + percent) * len(diff) <= (100 - percent) * (len(x) + len(y))
                shown = home.as_py() and 2 * len(diff) <= len(y)
                for c, v in zip(out, (linked or shown, linked, len(x), len(y), diff.view(np.int64) if shown else None), strict=True):
                    c.append(v)
            keep, *rest = out
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = [part.column("node_a"), part.column("node_b"), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]]
            yield pa.record_batch(columns, names=["node_a", "node_b", "linked", "size_a", "size_b", "diff"]).filter(pa.array(keep, pa.bool_()))


def _number(node: Column) -> Column:
    """The first eight bytes of a name as the long that numpy reads from them."""
    return F.conv(F.hex(F.concat(*[F.substring(node, k, 1) for k in range(8, 0, -1)])), 16, -10).cast("long")


def _size(meta: str) -> Column:
    return F.shiftright(meta, 24).bitwiseAND(F.lit(SIZES))


def _l(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(MOST))


def _least(size: Column, percent: int) -> Column:
    """How many shingles sets must share that hold ``size`` in all."""
    return F.ceil(size * percent / (100 + percent))


def _can_link(percent: int, before: str) -> Column:
    """Whether a pair that meets in a shingle at pos_a and pos_b of its prefixes can link: by the sizes, and since it shares no
    more than ``before`` (_a and _b) says of what stands before these places, and what stands from there on."""
    a, b = _size("meta_a"), _size("meta_b")
    most = F.least(f"{before}_a", f"{before}_b") + F.least(a - F.col("pos_a"), b - F.col("pos_b"))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (most >= _least(a + b, percent))


def _low(size: Column) -> Column:
    """The least l of a set of this size; of a larger one it is no less."""
    return F.ceil(size * LEAST_SHARE / 100)


def _candidates(met: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of rows (a, meta_a, b, meta_b) that share enough shingles. ``whole`` says that a is the smaller set, and
    that the shingles in which it meets others are all there but for its least l - 1 longest lists."""
    size = lambda k: _size(f"meta_{k}")
    n = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("meta_a").alias("meta_a"), F.max("meta_b").alias("meta_b"))
    enough = F.least(_l("meta_a"), _l("meta_b"))
    if whole:
        after = F.greatest(_least(2 * size("a"), percent) - _l("meta_a"), F.ceil(size("b") * percent / 100) - _l("meta_b"))
        enough = F.greatest(enough, _least(size("a") + size("b"), percent) - after) - (_low(size("a")) - 1)
    return n.filter(F.col("n") >= enough).select("a", "b", "n")


def _members(first: DataFrame) -> DataFrame:
    """node, number, size, home, home_number, diff (the shingles that only one of node and home has): each class at its home, or at
    its home's home if it is close enough to that; and each home at itself."""
    at = first.filter("diff is not null").select(F.col("node_b").alias("node"), F.col("size_b").alias("size"), F.col("node_a").alias("home"), F.col("size_a").alias("home_size"), "diff")
    for _ in range(2):
        up = at.select(F.col("node").alias("home"), F.col("home").alias("up"), F.col("home_size").alias("up_size"), F.col("diff").alias("up_diff"))
        far = F.array_union(F.array_except("diff", "up_diff"), F.array_except("up_diff", "diff"))
        met = at.join(up, "home", "left").withColumn("far", far)
        moved = F.coalesce(2 * F.size("far") <= F.col("size"), F.lit(False))
        at = met.select("node", "size", *[F.when(moved, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("up", "home"), ("up_size", "home_size"), ("far", "diff"))])
    homes = at.select("home", "home_size").distinct().select(F.col("home").alias("node"), F.col("home_size").alias("size"), "home", "home_size", F.array().cast("array<long>").alias("diff"))
    return at.unionByName(homes).select("node", _number(F.col("node")).alias("number"), "size", "home", _number(F.col("home")).alias("home_number"), "diff")


def _links_of_groups(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join all classes of a home that link with each other, by what tells them from the home.

    Two sets differ in what exactly one of their differences has. With slack (100 - percent) * size - (100 + percent) * |diff| they
    link if both slacks and 2 * (100 + percent) for each difference that they share come to 0 at least. So all that can link
    without sharing any link with the class of most slack. The others need some shared ones: differences that the same
    classes have are one key that weighs as many. Keys are ordered rare first, and of each class only a prefix counts, whose rest
    weighs too little; where one key is never enough, a pair of keys stands for a list, else a key does. In a list all link with
    its class of most slack if what the key weighs is enough; only what is left over is paired in blocks, and tested.
    """
    each = 2 * (100 + percent)
    slack = (100 - percent) * F.col("size") - (100 + percent) * F.size("diff")
    rated = members.select("node", "home", "diff", slack.alias("slack"))
    tops = rated.groupBy("home").agg(F.max(F.struct("slack", "node")).alias("top"))
    met = rated.join(tops, "home").withColumn("open", F.col("slack") + F.col("top.slack") < 0)
    links = met.filter("not open and node <> top.node").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    left = met.groupBy("home").agg(F.max(F.when(F.col("open"), F.col("slack"))).alias("most_open"), F.first("top.slack").alias("most")).filter("most_open is not null")
    if left.isEmpty():
        return links
    need = lambda other: F.ceil((-F.col("slack") - other) / each)  # noqa: E731  shared differences, with one of so much slack
    # Whom an open class may meet has any slack up to the most; whom another one may meet is open.
    some = met.drop("top").join(left, "home").withColumn("need", F.greatest(F.when(F.col("open"), need(F.col("most"))).otherwise(need(F.col("most_open"))), need_of_open(F.col("most_open"), F.col("most"), each)))
    some = materialise(some, "near-open")
    has = some.select("home", "node", "open", F.explode("diff").alias("shingle"))
    alike = has.groupBy("home", "shingle").agg(F.count("*").alias("n"), F.max("open").alias("open"), *[F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]).filter("n > 1 and open")
    keys = alike.groupBy("home", "n", "h1", "h2").agg(F.count("*").alias("weight"), F.min("shingle").alias("shingle")).select("home", "shingle", "n", "weight")
    own = has.select("home", "node", "shingle").join(keys, ["home", "shingle"])
    order = Window.partitionBy("home", "node").orderBy("n", "shingle")
    own = own.withColumns({"rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "heaviest": F.max("weight").over(Window.partitionBy("home", "node"))})
    own = own.join(some.select("home", "node", "open", "slack", "need"), ["home", "node"])
    # A home's lists are of pairs of keys if no class can link by one, and if none has very many.
    single = own.filter("rest >= need")
    double = own.filter("rest >= need - heaviest")
    by_two = double.groupBy("home", "node").agg(F.count("*").alias("keys"), F.max("heaviest").alias("heaviest"), F.max("need").alias("need"), F.max("open").alias("open")).groupBy("home").agg((F.max("keys") <= PAIRED).alias("few"), F.min(F.when(F.col("open"), F.col("need") > F.col("heaviest"))).alias("short")).select("home", (F.col("few") & F.coalesce("short", F.lit(True))).alias("two"))
    plain = single.join(by_two.filter("two"), "home", "left_anti").select("home", "node", "open", "slack", F.col("shingle").alias("k1"), F.lit(None).cast("long").alias("k2"), "weight")
    listed = double.join(by_two.filter("two"), "home", "left_semi").groupBy("home", "node", "open", "slack").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "weight"))).alias("own"))
    second = F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("y")
    two = listed.select("home", "node", "open", "slack", "own", F.posexplode("own").alias("i", "x")).select("home", "node", "open", "slack", "x", second)
    pairs = two.select("home", "node", "open", "slack", F.col("x.shingle").alias("k1"), F.col("y.shingle").alias("k2"), (F.col("x.weight") + F.col("y.weight")).alias("weight"))
    lists = materialise(plain.unionByName(pairs).withColumn("key", F.struct("k1", F.coalesce("k2", "k1").alias("k2"))).drop("k1", "k2"), "near-lists")
    best = lists.groupBy("home", "key").agg(F.max(F.struct("slack", "node")).alias("top"), F.count("*").alias("n"), F.max("open").alias("any")).filter("any and n > 1").drop("any")
    here = lists.join(best, ["home", "key"]).withColumn("sure", F.col("slack") + F.col("top.slack") + each * F.col("weight") >= 0)
    joined = here.filter("sure and node <> top.node").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    x = here.filter("open and not sure").select("home", "key", F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    y = here.select("home", "key", F.col("node").alias("b"), F.col("open").alias("open_b"), F.col("sure").alias("sure_b"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"))
    tried = x.join(y, ["home", "key", "part"]).filter((F.col("a") != F.col("b")) & (F.col("sure_b") | ~F.col("open_b") | (F.col("a") < F.col("b")))).select("home", "a", "b").distinct()
    side = lambda k: some.select("home", F.col("node").alias(k), F.col("diff").alias(f"diff_{k}"), F.col("slack").alias(f"slack_{k}"))
    tested = tried.join(side("a"), ["home", "a"]).join(side("b"), ["home", "b"]).filter(F.col("slack_a") + F.col("slack_b") + each * F.size(F.array_intersect("diff_a", "diff_b")) >= 0).select("a", "b")
    return links.unionByName(joined).unionByName(tested)


def need_of_open(most_open: Column, most: Column, each: int) -> Column:
    """How many differences any open class must share at least, with whomever."""
    return F.greatest(F.ceil((-most_open - most) / each), F.lit(1))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, lane: int = LANE, block: int = LIST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id (the smallest doc_id over links), root
    (names the component, null without shingles).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles; a text of fewer
    words has its whole sequence as its one shingle; null, empty and wordless texts have no shingle and link with nothing
    (component_id is their own id). Null ids take no part in the minimum; a component of null ids only has a null one.
    Rows with equal sets link. Other columns take no part. Shingles are compared by 64-bit hashes, sets by 128-bit ones.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    often = send(spark, frequent_shingles(texts.select("text"), width, frequent))

    def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and the postings of each class about once a task."""
        from xxhash import xxh3_128_digest

        shingler, seen = Shingler(width), set()
        for batch in found:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            names, n, new, waiting = [], [], [], 0
            for texts_ in _texts(batch):
                for own in shingler(texts_):
                    name = xxh3_128_digest(own.tobytes())
                    names.append(name if len(own) else None)
                    n.append(len(own))
                    if len(own) and name not in seen:
                        seen.add(name)
                        new.append((name, len(own), *prefix(own, often.value, percent)))
                        waiting += len(new[-1][2])
                if len(seen) > 200_000:
                    seen.clear()
                if waiting > OUT_ROWS:
                    yield postings(new, ids.type)
                    new, waiting = [], 0
            if new:
                yield postings(new, ids.type)
            none = pa.nulls(len(n), pa.int64())
            yield pa.record_batch([none, pa.nulls(len(n), pa.int32()), none, none, pa.nulls(len(n), pa.int32()), pa.array(names, pa.binary()), ids, hashes, pa.array(n, pa.int64())], names=columns)

    def postings(new: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        """Rows (shingle, lane, number, meta, pos): a number is half of a class's name, enough to find candidates by; meta packs
        how much of the prefix is frequent, the size of the set, and its l; pos is the place in the prefix. Very frequent
        shingles are dealt over lanes from 1 by number; others are in lane 0."""
        h = np.concatenate([x[2] for x in new]).view(np.int64)
        each = [len(x[2]) for x in new]
        numbers = np.repeat(np.frombuffer(b"".join(x[0][:8] for x in new), np.int64), each)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(each) - each, each)
        meta = np.repeat([int(127 * (x[3] > 1).mean()) << 56 | x[1] << 24 | x[4] for x in new], each)
        many = np.concatenate([x[3] for x in new]).astype(np.uint64) // np.uint64(lane)
        lanes = np.where(many > 0, numbers.view(np.uint64) % (many + np.uint64(1)) + np.uint64(1), 0).astype(np.int32)
        return pa.record_batch([pa.array(h), pa.array(lanes), pa.array(numbers), pa.array(meta), pa.array(pos, pa.int32()), pa.nulls(len(h), pa.binary()), pa.nulls(len(h), id_kind), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64())], names=columns)

    columns = ["shingle", "lane", "number", "meta", "pos", "node", "doc_id", "text_hash", "n"]
    rows = texts.mapInArrow(lean(emit), f"shingle long, lane int, number long, meta long, pos int, node binary, doc_id {id_type}, text_hash long, n long")
    # One shuffle by shingle finds the shared ones; rows of documents go along under keys of their own.
    over = Window.partitionBy(F.coalesce("shingle", F.xxhash64("doc_id", "text_hash")), F.coalesce("lane", F.lit(-1)))
    shared = (F.min("number").over(over) != F.max("number").over(over)) | (F.col("lane") > 0)
    kept = materialise(rows.withColumn("shared", F.isnull("shingle") | shared).filter("shared").drop("shared"), "near-rows")
    own = kept.filter("shingle is null").select("doc_id", "text_hash", "n", "node")
    classes = own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "text_hash"), F.struct("doc_id", "text_hash")).alias("row"))
    numbered = classes.select("node", "row", _number(F.col("node")).alias("number"))
    over = Window.partitionBy("shingle", "lane")
    posted = kept.filter("shingle is not null").select("shingle", "lane", "number", "meta", "pos").withColumn("hub", F.max(F.struct(F.shiftright("meta", 56).alias("shared"), "number", "meta", "pos")).over(over)).dropDuplicates(["shingle", "lane", "number"])

    def sets_of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in found:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingler(part.column("text").to_pylist())]
                yield pa.record_batch([part.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    def links_of(pairs: DataFrame, homes: bool) -> DataFrame:
        """What `verified` says of the pairs of numbers (a, b); the home of b is the a that it meets most often."""
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a")) == 1
        pairs = materialise(pairs.select("a", "b", best.alias("home")) if homes else pairs.select("a", "b", F.lit(False).alias("home")), "near-pairs")
        wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        rows_ = numbered.join(wanted, numbered.number == wanted.a, "left_semi").select("node", F.col("row.doc_id").alias("want_id"), F.col("row.text_hash").alias("want_hash"))
        found = texts.join(rows_, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_hash") == F.col("want_hash"))).select("node", "text").dropDuplicates(["node"])
        sets = materialise(found.mapInArrow(lean(sets_of), "node binary, set binary"), "near-sets")
        side = lambda k: sets.select(_number(F.col("node")).alias(k), F.col("node").alias(f"node_{k}"), F.col("set").alias(f"set_{k}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("node_a", "node_b", "home", "set_a", "set_b")
        links = materialise(both.mapInArrow(lean(lambda found: verified(found, percent)), "node_a binary, node_b binary, linked boolean, size_a long, size_b long, diff array<long>"), "near-links")
        discard(pairs, sets)
        return links

    # Round one: a list's classes with its lane's hub, and the lanes' hubs with the first of them.
    posted = materialise(posted, "near-posted")
    hubs = posted.filter("number = hub.number").withColumn("top", F.max("hub").over(Window.partitionBy("shingle")))
    spokes = posted.select("hub", "number", "meta", "pos").unionByName(hubs.select(F.col("top").alias("hub"), "number", "meta", "pos")).filter("number <> hub.number")
    spokes = spokes.select(F.col("hub.number").alias("a"), F.col("hub.meta").alias("meta_a"), F.col("hub.pos").alias("pos_a"), F.col("number").alias("b"), F.col("meta").alias("meta_b"), F.col("pos").alias("pos_b"))
    first = links_of(_candidates(spokes.filter(_can_link(percent, "pos")), percent, False), True)
    members = materialise(_members(first), "near-members")
    inside = _links_of_groups(members, percent, block)

    # Round two: what isn't of the same group.
    to = members.filter("node <> home").select("number", F.col("home_number").alias("up"))
    # What a class shares with others before a shingle that both have in their prefixes is among its postings.
    rank = (F.row_number().over(Window.partitionBy("number").orderBy("pos")) - 1).alias("rank")
    ranked = posted.select("shingle", "number", "meta", "pos", rank)
    grouped = ranked.join(to, "number", "left").select("shingle", "number", "meta", "pos", "rank", F.coalesce("up", "number").alias("group"))
    lists = grouped.groupBy("shingle", "group").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    split = grouped.join(lists.filter("groups > 1").select("shingle", "main", F.col("n").alias("length"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shingle")
    # As the smaller set a class needs its least l indexed postings in such lists at least, and meets others in the shorter ones
    # of them; as the larger set it needs as many of any kind as a set of the least size that it can link with.
    size, of = _size("meta"), Window.partitionBy("number")
    indexed = (F.col("pos") < size - _least(2 * size, percent) + _l("meta")).alias("indexed")
    split = split.select("*", indexed).withColumns({"inside": F.sum(F.col("indexed").cast("int")).over(of), "postings": F.count("*").over(of)})
    split = split.withColumn("place", F.row_number().over(Window.partitionBy("number", "indexed").orderBy(F.desc("length"), F.desc("shingle"))))
    split = split.withColumn("use", F.col("indexed") & (F.col("inside") >= _low(size)) & (F.col("place") >= _low(size)))
    split = materialise(split.filter(F.col("use") | (F.col("postings") >= _low(F.ceil(size * percent / 100)))).drop("indexed", "inside", "postings", "place", "length"), "near-split")
    side = lambda k: [F.col("number").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("meta", "pos", "rank", "use", "group")]]
    left = split.filter("group <> main").select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *side("x"))
    right = split.select("shingle", F.pmod("number", "blocks").cast("int").alias("part"), *side("y"), "main")
    met = left.join(right, ["shingle", "part"]).filter((F.col("use_x") | F.col("use_y")) & (F.col("group_x") != F.col("group_y")) & ((F.col("group_y") == F.col("main")) | (F.col("x") < F.col("y"))))
    # Of each pair the smaller set comes first.
    turn = F.struct(_size("meta_x"), F.col("x")) > F.struct(_size("meta_y"), F.col("y"))
    met = met.select(*[F.when(turn, F.col(f"{c}{k}")).otherwise(F.col(f"{c}{j}")).alias(f"{c}{m}") for c in ("", "meta_", "pos_", "rank_", "use_") for m, j, k in (("a", "x", "y"), ("b", "y", "x"))])
    met = met.filter(F.col("use_a") & _can_link(percent, "rank"))
    named = [F.col("node_a").alias("a"), F.col("node_b").alias("b")]
    links = first.filter("linked").select(*named).unionByName(links_of(_candidates(met, percent, True), False).filter("linked").select(*named)).unionByName(inside)
    discard(posted, split)

    group = components(links)
    labelled = group.join(classes.select("node", "least"), "node")
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of_node = classes.select("node", "least").join(group.join(least, "root").select("node", "root", "component"), "node", "left").select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), F.coalesce("root", "node").alias("root"))
    return own.join(of_node, "node", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "root")


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id (null ids only if there is no other).

    Texts without shingles are groups of their own; rows that agree in id and text count as one, of which any may stay.
    Ids may be of any type that has an order, other columns of any name.
    """
    found = jaccard_components(docs.select("doc_id", "text"), width, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = found.filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    kept = kept.unionByName(found.filter("n_shingles = 0").select("doc_id", "text_hash"))
    key = lambda id_, text_hash: [id_.isNull().alias("k0"), F.coalesce(id_.cast("string"), F.lit("")).alias("k1"), text_hash.alias("k2")]
    keyed = rowed(docs).select("row", *key(F.col("row.doc_id"), F.xxhash64("row.text")))
    kept = kept.select(*key(F.col("doc_id"), F.col("text_hash")))
    return keyed.join(kept, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"]).select("row.*")
