"""Following a log as a stream: ordered, contiguous, resumable.

A micro-batch holds rows (txid, pgno, data, commit, seq) of transactions in any order. The position is the end of the longest run of
transactions without a hole; what lies beyond a hole is held back until the hole is filled by a later batch or bridged by
compacted files, and no transaction is ever passed over. A transaction's rows come in one batch, as a log file's do; if they may
be split, a column n_rows says how many rows it has, and it counts as there when all have come. Rows of a file of many transactions carry
its last as txid and its first as low. Rows at or below the position are repeats and dropped.

The state is a log-structured table: each batch adds one *run* (the newest version of each page that it touched, and a
tombstone for each page that a smaller commit cut off), and `fanout` runs of a level are merged into one of the next. A batch
costs its own size, and a page is rewritten once a level. The pointer (batch, position, size in pages, runs, held rows) is one
small file that is replaced at once, so a batch that fails half-way leaves the old state in place and is applied again;
what a pointer no longer names is deleted one batch later.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import Store

_LAST = (1 << 63) - 1
_NOTHING = {"batch": -1, "position": 0, "commit": 0, "runs": [], "held": None, "garbage": []}


def contiguous_end(rows: DataFrame, position: int) -> tuple[int, int | None]:
    """The end of the run of whole transactions that follows position, and the first transaction beyond it (None: none)."""
    there = rows.groupBy("txid").agg(F.count("*").alias("n"), F.max("n_rows").alias("n_rows"), F.min("low").alias("low")).where("n >= coalesce(n_rows, n)")
    first = F.least("txid", F.greatest("low", F.lit(position + 1)))
    whole = there.select(F.explode(F.sequence(first, "txid")).alias("txid")).distinct()
    heads = whole.join(whole.select((F.col("txid") + 1).alias("txid")), "txid", "left_anti")  # each begins a run
    hole = heads.where(F.col("txid") > position + 1).agg(F.min("txid")).first()[0]
    before = whole.where(F.col("txid") < hole) if hole else whole
    end = before.agg(F.max("txid")).first()[0]
    return max(position, end or 0), hole


class Follower:
    """Applies batches; on_gap(position, next transaction there is) may give rows of a compacted file that leads on from position."""

    def __init__(self, spark: SparkSession, root: str, on_gap: Callable[[int, int], DataFrame | None] | None = None, fanout: int = 8):
        self.spark, self.root, self.on_gap, self.fanout, self.events = spark, root.rstrip("/"), on_gap, fanout, []
        self.store = Store(self.root)

    def pointer(self) -> dict:
        return json.loads(self.store.get("pointer.json")) if self.store.exists("pointer.json") else dict(_NOTHING)

    def position(self) -> int:
        return self.pointer()["position"]

    def _runs(self, runs: list) -> DataFrame:
        """The newest version of each page in these runs, tombstones too."""
        df = self.spark.read.parquet(*(f"{self.root}/{name}" for _, name in runs))
        best = df.groupBy("pgno").agg(F.max_by(F.struct("data", "gone"), "txid").alias("v"), F.max("txid").alias("txid"))
        return best.select("pgno", "v.data", "txid", "v.gone")

    def state(self) -> DataFrame | None:
        """pgno, data, txid of the pages there are."""
        runs = self.pointer()["runs"]
        return self._runs(runs).where("not gone").select("pgno", "data", "txid") if runs else None

    def _delta(self, rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        """What rows of consecutive transactions leave of each page, after a state of so many pages; and the size after them."""
        sizes = rows.where("commit > 0").groupBy("txid").agg(F.max_by("commit", "seq").alias("db_pages"))
        last = sizes.agg(F.max_by("db_pages", "txid")).first()[0]
        steps = sizes.withColumn("before", F.lag("db_pages", 1, size).over(W.orderBy("txid")))  # one row a transaction of the batch
        cut = steps.where("db_pages < before")
        cut = cut.select(F.explode(F.sequence(F.col("db_pages") + 1, F.col("before"))).alias("pgno"), "txid")
        data = rows.schema["data"].dataType
        dead = cut.select("pgno", F.lit(None).cast(data).alias("data"), "txid", F.lit(True).alias("gone"), F.lit(_LAST).alias("seq"))
        live = rows.join(sizes, "txid", "left").where("db_pages is null or pgno <= db_pages").select("pgno", "data", "txid", F.lit(False).alias("gone"), "seq")
        best = live.unionByName(dead).groupBy("pgno").agg(F.max_by(F.struct("data", "txid", "gone"), F.struct("txid", "seq")).alias("v"))
        return best.select("pgno", "v.data", "v.txid", "v.gone"), last or size

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        p = self.pointer()
        if batch_id <= p["batch"]:
            return
        for name in {"n_rows", "low"} - set(df.columns):
            df = df.withColumn(name, F.lit(None).cast("long"))
        names = ["txid", "low", "pgno", "data", "commit", "seq", "n_rows"]
        df = df.withColumn("low", F.coalesce("low", "txid"))
        rows = df.select(*names).where(F.col("txid") > p["position"])
        if p["held"]:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.root}/{p['held']}").select(*names))
        stage = f"stage-{batch_id}"
        rows.distinct().write.mode("overwrite").parquet(f"{self.root}/{stage}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{stage}")
        position, size, runs, garbage, step = p["position"], p["commit"], [list(r) for r in p["runs"]], [stage, *([p["held"]] if p["held"] else [])], 0
        while True:
            end, hole = contiguous_end(rows.where(F.col("txid") > position), position)
            new = rows.where((F.col("txid") > position) & (F.col("txid") <= end)) if end > position else None
            if new is None and hole:
                new = self.on_gap(position, hole) if self.on_gap else None
                end = (new.agg(F.max("txid")).first()[0] or 0) if new is not None else 0
                if end <= position:
                    self.events.append((batch_id, "gap", hole))
                    break
                self.events.append((batch_id, "bridged", end))
            if new is None:
                break
            delta, size = self._delta(new.withColumn("seq", F.col("seq").cast("long")), size)
            name = f"run-{batch_id}-{step}"
            delta.write.mode("overwrite").parquet(f"{self.root}/{name}")
            runs.append([0, name])
            position, step = end, step + 1
        rest, held = rows.where(F.col("txid") > position), None
        if rest.limit(1).count():
            held = f"held-{batch_id}"
            rest.write.mode("overwrite").parquet(f"{self.root}/{held}")
        runs, old = self._compacted(runs, batch_id)
        done = {"batch": batch_id, "position": position, "commit": size, "runs": runs, "held": held, "garbage": garbage + old}
        self.store.put("pointer.json", json.dumps(done).encode())
        self.store.delete(*p["garbage"])
        self.events.append((batch_id, "applied" if position > p["position"] else "idle", position))

    def _compacted(self, runs: list, batch_id: int) -> tuple[list, list]:
        """Merges full levels; gives the runs, oldest first, and the names that they replace. Below the oldest run tombstones hide nothing and go."""
        old: list = []
        level = 0
        while (full := [r for r in runs if r[0] == level]) and len(full) >= self.fanout:
            merged, name = self._runs(full), f"run-{batch_id}-level-{level + 1}"
            bottom = full[0] is runs[0]
            (merged.where("not gone") if bottom else merged).write.mode("overwrite").parquet(f"{self.root}/{name}")
            at = runs.index(full[0])
            runs = runs[:at] + [[level + 1, name]] + runs[at + len(full) :]
            old += [r[1] for r in full]
            level += 1
        return runs, old


def follow(stream: DataFrame, follower: Follower, checkpoint: str, **trigger):
    """Starts a query that applies the stream."""
    return stream.writeStream.foreachBatch(follower).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
