"""From a write-ahead log (and the database image below it) to files of level 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SNAPSHOT_LEVEL, lock_page
from ..operators.merge import compact, committed, overlay
from ..sinks import log_files as sink
from ..sources import log_files


def committed_pages(frames: DataFrame, after: int = 0) -> DataFrame:
    """pgno, data of the newest committed version of each page among the frames at offset `after` or beyond, within the last commit; without the lock page."""
    done = committed(frames.where(F.col("error").isNull() & (F.col("offset") >= after)), "frame_n")
    size = F.length("data")
    return compact(done.where(F.col("pgno") != lock_page(size)), "frame_n", "data")


def push(spark: SparkSession, wal: str, root: str, txid: int, ts_ms: int = 0, after: int = 0) -> DataFrame:
    """Writes what the log at `wal` commits beyond an offset as the transaction txid of level 0; gives the file written, or no row if nothing is committed."""
    frames = log_files.wal_frames(spark, wal)
    done = committed(frames.where(F.col("error").isNull() & (F.col("offset") >= after)), "frame_n")
    commit = done.where("commit > 0").agg(F.max_by("commit", "frame_n")).first()[0]
    if not commit:
        return spark.createDataFrame([], sink.WRITTEN)
    p = committed_pages(frames, after)
    return sink.write_files(p.select(F.lit(0).alias("level"), F.lit(txid).alias("min_txid"), F.lit(txid).alias("max_txid"), F.lit(commit).alias("commit"), F.lit(ts_ms).alias("ts_ms"), "pgno", "data"), root)


def push_snapshot(spark: SparkSession, database: str, wal: str | None, root: str, txid: int, ts_ms: int = 0, level: int = SNAPSHOT_LEVEL) -> DataFrame:
    """Writes the whole database, pages of the log before those of the image, as one file from transaction 1."""
    image = spark.read.format("binaryFile").load(database).select("path", "length")
    head = log_files.database_header(image).first()
    if head["error"]:
        raise ValueError(head["error"])
    page_size = head["page_size"]
    own = log_files.database_pages(image, page_size).select("pgno", "data")
    newest, commit = own.limit(0), None
    if wal:
        frames = log_files.wal_frames(spark, wal)
        done = committed(frames.where("error is null"), "frame_n")
        commit = done.where("commit > 0").agg(F.max_by("commit", "frame_n")).first()[0]
        newest = committed_pages(frames)
    commit = commit or image.first()["length"] // page_size
    whole = overlay(own, newest, commit).where(F.col("pgno") != lock_page(F.lit(page_size)))
    return sink.write_files(whole.select(F.lit(level).alias("level"), F.lit(1).alias("min_txid"), F.lit(txid).alias("max_txid"), F.lit(commit).alias("commit"), F.lit(ts_ms).alias("ts_ms"), "pgno", "data"), root)
