"""Restore planning: a greedy cover of TXIDs by a manifest's files.

The manifest of a database is small next to its pages (a row a file), but most
of it can never be chosen; per starting TXID only the best file goes to the driver, where the
chain, sequential by nature, is swept with a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SNAPSHOT_LEVEL
from ..operators.merge import compact


class TxNotAvailable(LookupError):
    pass


class LogGap(LookupError):
    pass


def greedy(seed: tuple | None, files: list[tuple], target: int) -> list[tuple]:
    """Chains (min, max, level) files from the seed: always the largest max, then the smallest min, then the higher level."""
    plan = [seed] if seed else []
    cur = seed[1] if seed else 0
    ready: list[tuple] = []
    rest = sorted(files)
    i = 0
    while not target or cur < target:
        while i < len(rest) and rest[i][0] <= cur + 1:
            low, high, level = rest[i]
            heapq.heappush(ready, (-high, low, -level))
            i += 1
        if not ready or -ready[0][0] <= cur:
            break
        high, low, level = heapq.heappop(ready)
        plan.append((low, -high, -level))
        cur = -high
    if target and cur != target:
        raise TxNotAvailable(target)
    if not target and i < len(rest):
        raise LogGap(f"{rest[i][0]} follows {cur}")
    if not plan:
        raise TxNotAvailable(target)
    return plan


def restore_plan(manifest: DataFrame, target: int = 0) -> list[tuple]:
    """The chain of (min, max, level). Files that end within the seed snapshot are never chosen and don't reach the driver."""
    m = manifest.where(F.col("max_txid") <= target) if target else manifest
    seed = m.where(F.col("level") == SNAPSHOT_LEVEL).agg(F.max_by(F.struct("min_txid", "max_txid", "level"), F.struct("max_txid", "min_txid")).alias("s")).first()["s"]
    m = m.where(F.col("level") < SNAPSHOT_LEVEL)
    if seed:
        m = m.where(F.col("max_txid") > seed["max_txid"])
    best = m.groupBy("min_txid").agg(F.max(F.struct("max_txid", "level")).alias("b")).select("min_txid", "b.max_txid", "b.level")
    return greedy(tuple(seed) if seed else None, [tuple(r) for r in best.toLocalIterator()], target)


def plan_frame(manifest: DataFrame, target: int = 0) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(restore_plan(manifest, target))]
    return manifest.sparkSession.createDataFrame(rows, "ord int, min_txid long, max_txid long, level int")


#: Transactions of one bucket when intervals meet transactions.
_SPAN = 4096


def versions_of(versions: DataFrame, plan: DataFrame) -> DataFrame:
    """The versions whose txid lies in a file of the plan, with the file's ord, once for each such file. An equal join on buckets of transactions, whatever the plan's size."""
    files = plan.select("ord", F.col("min_txid").alias("_lo"), F.col("max_txid").alias("_hi"), F.explode(F.expr(f"sequence(min_txid div {_SPAN}, max_txid div {_SPAN})")).alias("_span"))
    v = versions.withColumn("_span", F.expr(f"txid div {_SPAN}"))
    return v.join(files, "_span").where("txid between _lo and _hi").drop("_span", "_lo", "_hi")


def restore(manifest: DataFrame, pages: DataFrame, target: int = 0) -> DataFrame:
    """The image that a plan's files give: latest file wins, pages beyond the last commit go. pages: level, min_txid, max_txid, commit, pgno, data."""
    plan = plan_frame(manifest, target)
    p = pages.join(F.broadcast(plan), ["level", "min_txid", "max_txid"])
    return compact(p, "ord", "data")


def bridge(manifest: DataFrame, position: int) -> DataFrame:
    """Files that carry a replica on from its position, the level to use first marked."""
    c = manifest.where((F.col("level").between(1, 8)) & (F.col("min_txid") <= position + 1) & (F.col("max_txid") > position))
    first = c.agg(F.min("level").alias("first"))
    return c.join(F.broadcast(first), F.lit(True)).select("level", "min_txid", "max_txid", (F.col("level") == F.col("first")).alias("chosen"))


def sync_plan(manifest: DataFrame, position: int) -> tuple[list[tuple], str]:
    """The files (level, min, max) that lead a replica on from its position, in order, and what became of it.

    Level 0 leads; a hole in it is bridged by the lowest level that has a file across it, as far as that level reaches or
    the hole does, again and again. Without any step the newest snapshot is taken, if it is newer. Outcomes: empty, diverged,
    current, applied, snapshot, stuck. Only files that end beyond the position reach the driver.
    """
    top = manifest.agg(F.coalesce(F.max("max_txid"), F.lit(0))).first()[0]
    if top <= position:
        return [], "empty" if top == 0 else "diverged" if top < position else "current"
    ahead = sorted(tuple(r) for r in manifest.where(F.col("max_txid") > position).select("level", "min_txid", "max_txid").toLocalIterator())
    levels = [[(low, high) for lv, low, high in ahead if lv == level] for level in range(SNAPSHOT_LEVEL + 1)]
    at, plan, cur = [0] * len(levels), [], position

    def step(level: int) -> bool:
        nonlocal cur
        files = levels[level]
        while at[level] < len(files) and files[at[level]][1] <= cur:
            at[level] += 1
        if at[level] < len(files) and files[at[level]][0] <= cur + 1:
            plan.append((level, *files[at[level]]))
            cur = files[at[level]][1]
            return True
        return False

    while True:
        if step(0):
            continue
        hole = levels[0][at[0]][0] if at[0] < len(levels[0]) else cur + 1
        for level in range(1, SNAPSHOT_LEVEL):
            before = cur
            while step(level) and cur + 1 < hole:
                pass
            if cur > before:
                break
        else:
            break
    if plan:
        return plan, "applied"
    low, high = max(levels[SNAPSHOT_LEVEL], key=lambda f: f[1], default=(0, 0))
    return ([(SNAPSHOT_LEVEL, low, high)], "snapshot") if high > cur else ([], "stuck")
