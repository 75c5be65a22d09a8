"""A bucket's level 0 as a stream, and its other levels as bridges over holes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SNAPSHOT_LEVEL
from ..sources import log_files
from .follow import Follower, follow

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _rows(pages: DataFrame) -> DataFrame:
    """Pages of files as the follower takes them."""
    return pages.select(F.col("max_txid").alias("txid"), F.col("min_txid").alias("low"), "pgno", "data", "commit", F.col("pgno").alias("seq"))


def l0_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """The pages of new files of level 0, file by file; what a batch reads is bounded by its number of files."""
    src = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.ltx").option("maxFilesPerTrigger", files_per_batch).load(f"{root}/0")
    return _rows(log_files.pages_of(src))


def next_bridge(manifest: DataFrame, position: int) -> tuple[int, int, int] | None:
    """The file (level, min, max) that leads on from position: of the lowest level from 1 to 8 that has one, else the newest snapshot that is newer."""
    ahead = manifest.where(F.col("max_txid") > position)
    file = F.struct("level", "min_txid", "max_txid")
    across = ahead.where(F.col("level").between(1, SNAPSHOT_LEVEL - 1) & (F.col("min_txid") <= position + 1)).agg(F.min(file)).first()[0]
    best = across or ahead.where(F.col("level") == SNAPSHOT_LEVEL).agg(F.max_by(file, "max_txid")).first()[0]
    return tuple(best) if best else None


def bridges(spark: SparkSession, root: str) -> Callable[[int, int], DataFrame | None]:
    def on_gap(position: int, _next: int) -> DataFrame | None:
        best = next_bridge(log_files.manifest(spark, root), position)
        if best is None:
            return None
        return _rows(log_files.pages(spark, root, spark.createDataFrame([best], "level int, min_txid long, max_txid long")))

    return on_gap


def follow_bucket(spark: SparkSession, root: str, state: str, checkpoint: str, **trigger) -> tuple[Follower, object]:
    """Keeps the state folder at the bucket's end; gives the follower and the running query."""
    follower = Follower(spark, state, bridges(spark, root))
    return follower, follow(l0_stream(spark, root), follower, checkpoint, **trigger)
