"""Which keys have so many rows that one task should not hold them.

Rows are counted by slot, a hash of their key, so the counts are few whatever the number of keys. A key of a slot that isn't crowded
has no more rows than the slot. Where a key falls decides how it is worked on, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots that keys are counted by, and how many rows crowd one.
SLOTS, CROWD = 1 << 16, 200_000


#: Bytes of source files for each task that `dealt` deals rows over; sizes from this one on are unknown.
SHARE, UNKNOWN = 2_000_000, 1 << 50
#: The same for rows of a key or two that are only counted or looked up. Up to 200 tasks Spark writes rows for them unsorted.
LIGHT = 32_000_000


def tasks(*of: DataFrame, share: int | None = None) -> int:
    """Over how many tasks rows of these are to be dealt: one for each ``share`` bytes (`SHARE`) of the files they are read from. 0
    if Spark may choose, for small ones and those that don't come from files."""
    size = 0
    for df in of:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < UNKNOWN)
    n = -(-size // (share or SHARE))
    return max(n, of[0].sparkSession.sparkContext.defaultParallelism) if n > 1 else 0


def dealt(rows: DataFrame, *by: Column | str, beside: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``rows`` dealt by columns over a number of tasks that grows with the files that they and those ``beside`` them are read
    from. Spark's own number is fixed, and it joins partitions up to a size on disk that is many times as large in a sort."""
    n = tasks(rows, *beside)
    return rows.repartition(n, *by) if n else rows


def slot(keys: list[str]) -> Column:
    """The slot of a row's key."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("_slot")


def crowded(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """The slots with more than ``most`` rows (`CROWD`): `SLOTS` at most, and one for each ``most`` rows."""
    return rows.select(slot(keys)).groupBy("_slot").agg(F.count("*").alias("n")).filter(F.col("n") > (CROWD if most is None else most)).select("_slot")


def parted(rows: DataFrame, keys: list[str], crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys lie in no slot of ``crowd``, and the others."""
    marked = rows.withColumn("_slot", slot(keys))
    return tuple(marked.join(F.broadcast(crowd), "_slot", how).drop("_slot") for how in ("left_anti", "left_semi"))  # SLOTS rows at most


def met(rows: DataFrame, known: DataFrame, key: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined to ``known``, which has each key once. Keys that more than ``most`` of ``rows`` have (`CROWD`) are
    met by a broadcast, so their rows stay where they are; there is one such key for each ``most`` rows at most."""
    often = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > (CROWD if most is None else most)).select(key)
    many = rows.join(F.broadcast(known.join(F.broadcast(often), key, "left_semi")), key, how)
    return rows.join(F.broadcast(often), key, "left_anti").join(known, key, how).unionByName(many)


def counted(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """key, n: how many of ``rows`` have each key. They are dealt; only those of crowded slots are counted before they move, as
    a map of keys that are nearly all different would grow with what a task reads."""
    rows = rows.select(key)
    count = lambda df: df.groupBy(key).agg(F.count("*").alias("n"))
    n = tasks(rows, share=LIGHT)
    if not n:
        return count(rows)
    few, many = parted(rows, [key], crowded(rows, [key], most))
    return count(few.repartition(n, key)).unionByName(count(many))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """_hash: hashes of the keys that more than one of ``rows`` has. Only the 8 bytes of a hash are shuffled; keys that share one
    with another key are in it too, so what is done with repeated keys must be right for others as well."""
    hashes = rows.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_hash"))
    n = tasks(rows, share=LIGHT)
    return (hashes.repartition(n, "_hash") if n else hashes).groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash")


def lacking(rows: DataFrame, known: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The ``rows`` whose key is null or not in ``known``. Both are dealt; rows of crowded slots are left to Spark's join,
    which splits partitions that are much larger than others."""
    known = known.select(key).filter(F.col(key).isNotNull())
    n = tasks(rows, known, share=LIGHT)
    if not n:
        return rows.join(known, key, "left_anti")
    crowd = crowded(rows, [key], most)
    few, many = parted(rows, [key], crowd)
    # An anti join would be moved below the dealing, to tasks of Spark's own number.
    once = known.repartition(n, key).distinct().withColumn("_known", F.lit(True))
    few = few.repartition(n, key).join(once, key, "left").filter("_known is null").drop("_known")
    return few.unionByName(many.join(parted(known, [key], crowd)[1], key, "left_anti"))
