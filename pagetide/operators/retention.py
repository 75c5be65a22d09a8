"""Retention and scheduling rules on the manifest.

The prefix rules ("delete until the first that must stay") become one minimum: of the order keys that must stay. That is an aggregation, not a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SNAPSHOT_LEVEL


def expired_snapshots(manifest: DataFrame, cutoff: Column) -> DataFrame:
    """The leading snapshots older than cutoff, but never the newest; max_txid of the last of them is the floor if any snapshot is retained after them."""
    s = manifest.where(F.col("level") == SNAPSHOT_LEVEL)
    newest = s.agg(F.max("max_txid").alias("newest"))
    s = s.join(F.broadcast(newest), F.lit(True))
    stays = ~F.coalesce(F.col("created_at") < cutoff, F.lit(False)) | (F.col("max_txid") == F.col("newest"))
    first = s.where(stays).agg(F.min(F.struct("min_txid", "max_txid")).alias("first"))
    return s.join(F.broadcast(first), F.struct("min_txid", "max_txid") < F.col("first")).drop("newest", "first")


def cascade(manifest: DataFrame, cutoff: Column) -> DataFrame:
    """Files of levels 1 to 8 wholly below the floor, but the last of each level; nothing if no snapshot expired."""
    floor = expired_snapshots(manifest, cutoff).agg(F.max("max_txid").alias("floor"))
    low = manifest.where(F.col("level").between(1, SNAPSHOT_LEVEL - 1))
    last = low.groupBy("level").agg(F.max(F.struct("min_txid", "max_txid")).alias("last"))
    j = low.join(F.broadcast(last), "level").join(F.broadcast(floor), F.col("max_txid") < F.col("floor"))
    return j.where(F.struct("min_txid", "max_txid") < F.col("last")).drop("last", "floor")


def covered_l0(manifest: DataFrame, cutoff: Column) -> DataFrame:
    """The leading files of level 0 that level 1 covers and that are old enough, but never the newest."""
    tops = manifest.where("level < 2").agg(F.max(F.when(F.col("level") == 1, F.col("max_txid"))).alias("l1"), F.max(F.when(F.col("level") == 0, F.col("max_txid"))).alias("newest"))
    f = manifest.where("level = 0").join(F.broadcast(tops), F.lit(True)).where("l1 is not null")
    stays = (F.col("max_txid") > F.col("l1")) | (F.col("max_txid") == F.col("newest")) | ~F.coalesce(F.col("created_at") <= cutoff, F.lit(False))
    first = f.where(stays).agg(F.min(F.struct("min_txid", "max_txid")).alias("first"))
    return f.join(F.broadcast(first), F.struct("min_txid", "max_txid") < F.col("first")).drop("l1", "newest", "first")


def due(manifest: DataFrame, intervals: dict[int, int], now: Column) -> DataFrame:
    """Which levels are due: no file, or the newest is intervals[level] seconds old."""
    spark = manifest.sparkSession
    want = spark.createDataFrame(sorted(intervals.items()), "level int, seconds long")
    newest = manifest.groupBy("level").agg(F.max_by("created_at", "max_txid").alias("newest_at"))
    age = F.unix_timestamp(now) - F.unix_timestamp("newest_at")
    return want.join(newest, "level", "left").select("level", F.coalesce(age >= F.col("seconds"), F.lit(True)).alias("due"))


def compaction_inputs(manifest: DataFrame, level: int) -> DataFrame:
    """Files of the level below that begin after the level's end."""
    top = manifest.where(F.col("level") == level).agg(F.coalesce(F.max("max_txid"), F.lit(0)).alias("top"))
    return manifest.where(F.col("level") == level - 1).join(F.broadcast(top), F.col("min_txid") >= F.col("top") + 1).drop("top")
