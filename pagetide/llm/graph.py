"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import written


#: A key with so many rows (and one of each HEAVY_KEYS rows) is hot: there are at most HEAVY_KEYS such keys, or one for each HEAVY rows.
HEAVY, HEAVY_KEYS = 256, 100_000


def hot_size(rows: int) -> int:
    return max(HEAVY, rows // HEAVY_KEYS)


def join_by_heat(many: DataFrame, one: DataFrame, key: str, size: int) -> DataFrame:
    """many joined with one (a narrow row for each key, with n, how many rows of many have it): rows of hot keys, which are few, are met by broadcast where they lie."""
    hot = F.broadcast(one.where(F.col("n") >= size))
    rest = many.join(hot.select(key), key, "left_anti").join(one.where(F.col("n") < size), key)
    return many.join(hot, key).unionByName(rest).drop("n")


def join_salted(many: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """many joined with one (a wide row for each key): a hot key's rows are dealt by the column other to as many copies of its row as it has loads."""
    size = hot_size(many.count())
    hot = F.broadcast(many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= size))
    loads = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("int")
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.hash(other), loads)).drop("_n")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), loads - 1))).drop("_n")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _is_forest(e: DataFrame) -> bool:
    """Each node hangs from one root, and no root hangs from another."""
    n = e.groupBy("a").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return n <= 1 and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of edges (a, b longs).

    Large and small stars in turn, each written to the shared folder, until
    every node hangs from its root; a hub's edges are combined per task before they meet.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _is_forest(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        size = hot_size(2 * e.count())
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_by_heat(both, least, "a", size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_by_heat(large, low, "a", size).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
