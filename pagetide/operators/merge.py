"""Latest-wins merges of page versions, and what the write-ahead log commits.

All are one aggregation by page with partial (map-side) combining; no window over a page's versions and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAG = -(1 << 63)


def latest_wins(versions: DataFrame, order: str | Column, *values: str, key: str = "pgno") -> DataFrame:
    """The values of each key's newest version."""
    order = F.col(order) if isinstance(order, str) else order
    best = F.max_by(F.struct(*values), order).alias("v")
    return versions.groupBy(key).agg(best).select(key, *(F.col(f"v.{c}").alias(c) for c in values))


def compact(versions: DataFrame, order: str | Column, *values: str, key: str = "pgno") -> DataFrame:
    """Latest wins, and pages beyond the newest input's size go. One aggregation finds the newest of each page and, beside
    it, the newest size that the page's versions name; a second, over one row a page, the size itself."""
    order = F.col(order) if isinstance(order, str) else order
    best = F.max_by(F.struct(*values), order).alias("v")
    sized = F.max(F.when(F.col("commit") > 0, F.struct(order.alias("o"), F.col("commit").alias("c")))).alias("s")
    one = versions.groupBy(key).agg(best, sized)
    size = one.agg(F.max("s").alias("s")).select(F.col("s.c").alias("db_pages"))
    return one.join(F.broadcast(size), F.col(key) <= F.col("db_pages")).select(key, *(F.col(f"v.{c}").alias(c) for c in values))


def committed(frames: DataFrame, order: str = "seq") -> DataFrame:
    """Frames that a commit at or after them makes visible: one scalar, broadcast (a single row)."""
    last = frames.where("commit > 0").agg(F.max(order).alias("last_commit"))
    return frames.join(F.broadcast(last), F.col(order) <= F.col("last_commit")).drop("last_commit")


def page_map(frames: DataFrame, order: str = "seq") -> DataFrame:
    done = committed(frames, order)
    return compact(done, order, order)


def overlay(pages: DataFrame, wal: DataFrame, size: int) -> DataFrame:
    """For each page of 1..size the log's image, else the database's."""
    all_ = pages.sparkSession.range(1, size + 1).withColumnRenamed("id", "pgno")
    j = all_.join(wal.select("pgno", F.col("data").alias("w")), "pgno", "left").join(pages.select("pgno", F.col("data").alias("d")), "pgno", "left")
    return j.select("pgno", F.coalesce("w", "d").alias("data"), F.when(F.col("w").isNotNull(), "wal").when(F.col("d").isNotNull(), "db").otherwise("zero").alias("origin"))


def apply_delta(state: DataFrame, delta: DataFrame, commit: int) -> DataFrame:
    """The state after a newer delta: upsert, then truncation (a commit of 0 does not truncate)."""
    both = state.select("pgno", "data", "txid").unionByName(delta.select("pgno", "data", "txid"))
    out = latest_wins(both, "txid", "data", "txid")
    return out.where(F.col("pgno") <= commit) if commit else out


def rolling_checksum(pages: DataFrame, checksum: Column, *by: str) -> DataFrame:
    """Order-independent: the checksums' exclusive or, with the flag bit."""
    return pages.groupBy(*by).agg(F.bit_xor(checksum).bitwiseOR(F.lit(FLAG)).alias("checksum"), F.count("*").alias("pages"))


def gaps(files: DataFrame, by: str = "level") -> DataFrame:
    """Neighbours of a level that leave TXIDs out or overlap."""
    w = W.partitionBy(by).orderBy("min_txid", "max_txid")
    f = files.withColumn("prev_max", F.lag("max_txid").over(w)).where("prev_max is not null")
    return f.where((F.col("min_txid") > F.col("prev_max") + 1) | (F.col("max_txid") <= F.col("prev_max")))


def last_image_match(versions: DataFrame) -> DataFrame:
    """txid, pgno, match: whether a version (txid, pgno, image) is as the one of the same page before it; a first one is not."""
    before = F.lag("image").over(W.partitionBy("pgno").orderBy("txid"))
    return versions.select("txid", "pgno", F.coalesce(F.col("image") == before, F.lit(False)).alias("match"))
