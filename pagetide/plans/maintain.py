"""Maintenance of a bucket: compaction of a level, snapshots, retention, in the order that keeps every moment restorable.

Files are written before any is deleted, and each step can be repeated: a run that is cut short is made good by the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import FormatError
from ..functions.columns import SNAPSHOT_LEVEL, is_contiguous
from ..operators import retention
from ..operators.merge import latest_wins
from ..sinks import log_files as sink
from ..sources import log_files
from .restore import TxNotAvailable, plan_frame, restore


@dataclass
class Options:
    """Seconds. Levels and snapshots are due when their newest file is as old as their interval."""

    intervals: dict[int, int] = field(default_factory=lambda: {1: 30, 2: 300, 3: 3600})
    snapshot_interval: int = 86400
    snapshot_retention: int = 86400
    l0_grace: int = 300
    retention: bool = True


@dataclass
class Report:
    compacted: list[int] = field(default_factory=list)
    snapshot: int | None = None
    deleted: int = 0


def check_inputs(files: DataFrame) -> None:
    """FormatError unless the files (min_txid, max_txid, page_size) follow one another and have one page size."""
    from pyspark.sql import Window as W

    prev = F.lag("max_txid").over(W.orderBy("min_txid", "max_txid"))  # one row a file of one level
    f = files.withColumn("prev", prev)
    broken = F.sum((F.col("prev").isNotNull() & ~is_contiguous(F.col("prev"), F.col("min_txid"), F.col("max_txid"))).cast("int"))
    sizes, holes = f.agg(F.countDistinct("page_size"), broken).first()
    if sizes > 1:
        raise FormatError("inputs have different page sizes")
    if holes:
        raise FormatError("inputs are not contiguous")


def merged(pages: DataFrame, level: int) -> DataFrame:
    """The pages of one file that replaces those that pages come from: newest version of each, within the newest commit."""
    ends = pages.agg(F.min("min_txid").alias("low"), F.max("max_txid").alias("high"), F.max_by(F.struct("commit", "ts_ms", "page_size"), "max_txid").alias("last"))
    one = latest_wins(pages, "max_txid", "data")
    whole = ends.select(F.lit(level).alias("level"), F.col("low").alias("min_txid"), F.col("high").alias("max_txid"), "last.commit", "last.ts_ms", "last.page_size")
    return whole.join(one, F.col("pgno") <= F.col("commit"), "left")  # no page left: a file without pages


def compact_level(spark: SparkSession, root: str, level: int) -> DataFrame | None:
    """Merges the new files of the level below into one of this level; None if there are none."""
    m = log_files.manifest(spark, root)
    inputs = retention.compaction_inputs(m, level)
    if not inputs.limit(1).count():
        return None
    check_inputs(log_files._headers_of(inputs))
    pages = log_files.pages(spark, root, inputs)
    headers = log_files._headers_of(inputs).select("min_txid", "max_txid", "commit", "ts_ms", "page_size")
    known = pages.select("min_txid", "max_txid", "commit", "ts_ms", "page_size", "pgno", "data").unionByName(headers.withColumns({"pgno": F.lit(None).cast("long"), "data": F.lit(None).cast("binary")}))
    return sink.write_files(merged(known, level).where("level is not null"), root)


def snapshot(spark: SparkSession, root: str, txid: int = 0) -> int | None:
    """Writes the state at the bucket's end (or at txid) as a file of the snapshot level; gives its transaction, or None in an empty bucket."""
    m = log_files.manifest(spark, root)
    try:
        plan = plan_frame(m, txid)
    except TxNotAvailable:
        if txid:
            raise
        return None
    end = plan.agg(F.max("max_txid")).first()[0]
    head = log_files._headers_of(m.join(plan, ["level", "min_txid", "max_txid"], "left_semi")).agg(F.max_by(F.struct("commit", "ts_ms", "page_size"), "max_txid").alias("h")).first()["h"]
    p = restore(m, log_files.pages(spark, root, plan), txid)
    one = p.select(F.lit(SNAPSHOT_LEVEL).alias("level"), F.lit(1).cast("long").alias("min_txid"), F.lit(end).cast("long").alias("max_txid"), F.lit(head["commit"]).alias("commit"), F.lit(head["ts_ms"]).alias("ts_ms"), "pgno", "data")
    sink.write_files(one, root)
    return end


def _expire(spark: SparkSession, root: str, files: DataFrame) -> int:
    return sink.delete_files(files.select("level", "min_txid", "max_txid"), root)


def maintain(spark: SparkSession, root: str, now: Column, options: Options | None = None) -> Report:
    """Compacts due levels from below, prunes level 0 after level 1 grew, snapshots when due, then expires snapshots and what they alone kept."""
    o, out = options or Options(), Report()
    ago = lambda seconds: F.timestamp_seconds(F.unix_timestamp(now) - seconds)
    m = lambda: log_files.manifest(spark, root, exact_time=True)
    for level in sorted(o.intervals):
        if retention.due(m(), {level: o.intervals[level]}, now).first()["due"] and compact_level(spark, root, level) is not None:
            out.compacted.append(level)
            if level == 1 and o.retention:
                out.deleted += _expire(spark, root, retention.covered_l0(m(), ago(o.l0_grace)))
    if retention.due(m(), {SNAPSHOT_LEVEL: o.snapshot_interval}, now).first()["due"]:
        out.snapshot = snapshot(spark, root)
    if o.retention:
        cutoff = ago(o.snapshot_retention)
        below = retention.cascade(m(), cutoff).select("level", "min_txid", "max_txid")
        old = retention.expired_snapshots(m(), cutoff).select("level", "min_txid", "max_txid")
        both = [tuple(r) for r in below.unionByName(old).collect()]  # decided before the first deletion
        out.deleted += _expire(spark, root, spark.createDataFrame(both, "level int, min_txid long, max_txid long"))
        out.deleted += _expire(spark, root, retention.covered_l0(m(), ago(o.l0_grace)))
    return out


def prune_local(local: DataFrame, remote_max: int) -> DataFrame:
    """Local files of level 0 that the bucket has already, but never the newest."""
    newest = local.where("level = 0").agg(F.max("max_txid").alias("newest"))
    f = local.where("level = 0").join(F.broadcast(newest), F.col("max_txid") < F.col("newest"))
    return f.where(F.col("max_txid") < remote_max).drop("newest")
