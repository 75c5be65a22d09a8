"""Append fences, writer leases, and the decisions of writer and replica."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import wal_size


def fenced(offers: DataFrame, manifest: DataFrame, content: str | None = None) -> DataFrame:
    """Offers with a verdict: level 0 appends at the end or repeats a file exactly, other levels stay within the bucket. content: a column of both, a digest, that a repeat must share."""
    tops = manifest.agg(F.coalesce(F.max(F.when(F.col("level") == 0, F.col("max_txid"))), F.lit(0)).alias("cur"), F.coalesce(F.max("max_txid"), F.lit(0)).alias("bucket_max"))
    same = manifest.select("level", "min_txid", "max_txid", (F.col(content) if content else F.lit(True)).alias("stored"))
    o = offers.join(same, ["level", "min_txid", "max_txid"], "left").join(F.broadcast(tops), F.lit(True))
    equal = F.col("stored") == F.col(content) if content else F.col("stored")
    l0 = F.when(F.coalesce(equal, F.lit(False)), "repeat").when(F.col("stored").isNotNull(), "conflict").when((F.col("cur") == 0) | (F.col("min_txid") == F.col("cur") + 1), "append").otherwise("conflict")
    verdict = F.when(F.col("level") == 0, l0).when(F.col("max_txid") <= F.col("bucket_max"), "within").otherwise("conflict")
    return o.withColumn("verdict", verdict).drop("stored", "cur", "bucket_max")


def lease_fold(offers: Iterator[tuple], holder: str | None, seen: float | None, ttl: float) -> Iterator[tuple[str, str | None, float | None]]:
    """Folds (writer_id, takeover, time, accepted) in order. A lease is free after ttl; takeover takes it; only accepted writes refresh it."""
    for writer, takeover, at, accepted in offers:
        live = holder is not None and at - seen < ttl
        if live and holder != writer and not takeover:
            yield "refused", holder, seen
            continue
        if accepted:
            holder, seen = writer, at
        yield ("granted" if accepted else "rejected"), holder, seen


def leases(offers: DataFrame, ttl: float, bucket: str = "bucket") -> DataFrame:
    """The lease fold of each bucket's offers (offer_n, writer_id, takeover, at_s, accepted). A bucket's offers are a single writer's log and are ordered, so they stay together."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offer_n")
        got = list(lease_fold(pdf[["writer_id", "takeover", "at_s", "accepted"]].itertuples(index=False), None, None, ttl))
        return pd.DataFrame({bucket: pdf[bucket], "offer_n": pdf["offer_n"], "outcome": [g[0] for g in got], "holder": [g[1] for g in got]})

    kind = offers.schema[bucket].dataType.simpleString()
    return offers.groupBy(bucket).applyInPandas(fold, f"{bucket} {kind}, offer_n long, outcome string, holder string")


def verify_outcome(d: DataFrame) -> DataFrame:
    """Where a writer resumes. Columns: pos, resume (end of the newest local file's log range), wal_size, synced_to_end, salt_match, page_match, missed (unseen generations), frame_size."""
    prev = F.col("resume") - F.col("frame_size")
    edge = F.when(F.col("salt_match"), "resume").otherwise("snapshot: salt reset")
    outcome = (
        F.when(F.col("pos") == 0, "snapshot: first")
        .when(F.col("resume") > F.col("wal_size"), F.when(F.col("synced_to_end"), "restart: own checkpoint").otherwise("snapshot: truncated"))
        .when((F.col("resume") == 32) | (prev == 32), edge)
        .when(prev < 32, "error: offset before header")
        .when(~F.col("page_match"), "snapshot: overwritten")
        .when(F.col("salt_match"), "resume")
        .when(F.col("missed"), "snapshot: missed generation")
        .otherwise("restart: new salts")
    )
    return d.withColumn("outcome", outcome)


def lineage(remote_max: Column, verified: Column, provisional: Column) -> Column:
    """What a writer does before it first changes a bucket: it goes on where the bucket ends where it left it; if not, another's files are there or its own are gone.

    A provisional position, known from local files only, may lie ahead of the bucket. Outcomes: ours, adopt (take the newest remote file as base), reseed (the bucket is empty)."""
    foreign = F.when(provisional, remote_max > verified).otherwise(remote_max != verified)
    return F.when(~foreign, "ours").when(remote_max > 0, "adopt").otherwise("reseed")


def checkpoint(page_size: Column, size_before: Column, size_now: Column, passive: int = 1000, truncate: int = 121_359) -> Column:
    """Which checkpoint a log of these sizes needs, by its number of pages; a truncate of 0 is none."""
    big = (size_before >= wal_size(page_size, F.lit(truncate).cast("long"))) & F.lit(truncate > 0)
    return F.when(page_size == 0, "none").when(big, "truncate").when(size_now >= wal_size(page_size, F.lit(passive).cast("long")), "passive").otherwise("none")


def divergence(bucket_max: Column, position: Column) -> Column:
    """diverged if the bucket ends before the replica's position, unless it is empty."""
    return F.when(bucket_max == 0, "empty").when(bucket_max < position, "diverged").when(bucket_max == position, "current").otherwise("behind")


def backlog(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local files that the bucket lacks, and where one does not follow on from the one before it or from the bucket's end: txid, gap."""
    end = remote.agg(F.coalesce(F.max("max_txid"), F.lit(0)).alias("r"))
    left = local.join(F.broadcast(end), F.col("min_txid") > F.col("r"))
    have = left.select((F.col("max_txid") + 1).alias("min_txid"), F.lit(True).alias("follows"))
    return left.join(have, "min_txid", "left").select(F.col("min_txid").alias("txid"), (F.col("follows").isNull() & (F.col("min_txid") != F.col("r") + 1)).alias("gap"))


#: Transactions whose polls and files meet in one task.
_SPAN = 4096


def feed_events(polls: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each poll (poll_n, cursor = next TXID wanted): reset, gap with the next TXID there is, file, or idle.

    The next file is the smallest min_txid of those that end at the cursor or beyond: the least of the cursor's own span of transactions,
    by a running minimum, and of the spans after it, of which there is one row each.
    """
    span = lambda c: F.floor(c / _SPAN).alias("span")
    files = manifest.where("level = 0").select(span(F.col("max_txid")), F.col("max_txid").alias("at"), "min_txid", F.lit(None).cast("long").alias("poll_n"))
    asked = polls.select(span(F.col("cursor")), F.col("cursor").alias("at"), F.lit(None).cast("long").alias("min_txid"), F.col("poll_n").cast("long").alias("poll_n"))
    both = files.unionByName(asked)
    down = W.partitionBy("span").orderBy(F.desc("at"), F.col("poll_n").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    here = both.withColumn("here", F.min("min_txid").over(down)).where("poll_n is not null")
    spans = both.groupBy("span").agg(F.min("min_txid").alias("least"))
    later = spans.select("span", F.min("least").over(W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))
    top = manifest.agg(F.coalesce(F.max("max_txid"), F.lit(0)).alias("bucket_max"))
    nexts = here.join(later, "span").select("poll_n", F.col("at").alias("cursor"), F.least("here", "later").alias("next_min")).join(F.broadcast(top), F.lit(True))
    event = F.when((F.col("bucket_max") > 0) & (F.col("bucket_max") < F.col("cursor") - 1), "reset").when(F.col("next_min").isNull(), "idle").when(F.col("next_min") > F.col("cursor"), "gap").otherwise("ltx")
    return nexts.select("poll_n", "cursor", event.alias("event"), F.when(event.isin("gap", "ltx"), F.col("next_min")).alias("next_min"))
