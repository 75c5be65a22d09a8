"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

A *run* is a table of line keys, sorted by hash, with the number of documents
that hold each and the largest doc_id among them. Each new batch of line keys
is merge-anti-joined with the runs: the keys that no run has are the batch's own run of level 0, so that a key lies
in one run only. Keys that a run has already are no new lines; the batch adds what it
knows of them to the *additions*. A key's total is its run's count and the sum of its additions, which is what
decides whether its lines go. When a level holds ``fanout`` runs they are
merged into one run of the next level, so a key is rewritten once per level,
and k batches leave O(log k) runs to join; as many additions are summed into one.

A line's key is the line without 0x20 and 0x09-0x0D at both ends and with A-Z
lower-cased, as a 128-bit hash. Keys of fewer than ``min_chars`` code points are never
dropped. A document's repeats of a line count once, before any shuffle, and counts are
combined per task before they are shuffled: a line that all documents
share is one row per task. To find the lines that go, keys in ``HEAVY`` documents or more (and in one of each
HEAVY_KEYS lines) are broadcast, so their lines stay where they are: there are at most HEAVY_KEYS of them,
or one for each HEAVY lines. The other keys meet their lines in a merge join, where no key has many.

Null or empty texts are one empty line. A row without doc_id takes part as the
smallest id; rows that share a doc_id are one document. Every input row gives one row out; ``line_deduped`` keeps all other columns,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import shared_dir, written

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
HEAVY, HEAVY_KEYS = 1000, 100_000


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, SMALL)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """The places of the line in its document, a row for each distinct key of a document."""
    line = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = line.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


class LineRuns:
    """The levelled runs and additions in a folder of the shared store."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels, self.additions = spark, fanout, [[]], []
        self.dir, self.n = shared_dir(spark), 0

    def _write(self, df: DataFrame) -> DataFrame:
        path = f"{self.dir}/run-{self.n}"
        self.n += 1
        df.sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    def known(self) -> DataFrame | None:
        """h1, h2, n, last of all runs: what the batch that brought a key knew of it."""
        runs = [run for level in self.levels for run in level]
        return self._union(runs) if runs else None

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, h1, h2; a row for each key of a document); returns its run, the keys that no run had."""
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        known, fresh = self.known(), own
        if known is not None:
            of_runs = known.select("h1", "h2").hint("merge")
            fresh = own.join(of_runs, ["h1", "h2"], "left_anti")
            self.additions.append(self._write(own.join(of_runs, ["h1", "h2"], "left_semi")))
        run = self._write(fresh)
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        if len(self.additions) >= self.fanout:
            self.additions = [self._write(self._added())]
        for k in range(64):
            if k == len(self.levels) or len(self.levels[k]) < self.fanout:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = self._union(self.levels[k]).repartition("h1", "h2")  # no key is in two runs
            self.levels[k + 1].append(self._write(merged))
            self.levels[k] = []

    def _added(self) -> DataFrame:
        return self._union(self.additions).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def total(self) -> DataFrame | None:
        """h1, h2, n, last over all batches: each key of the runs with what later batches added."""
        known = self.known()
        if known is None or not self.additions:
            return known
        more = self._added().select("h1", "h2", F.col("n").alias("more"), F.col("last").alias("later"))
        n, last = F.col("n") + F.coalesce("more", F.lit(0)), F.greatest("last", "later")
        return known.join(more.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", n.alias("n"), last.alias("last"))


def _gone(lines: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """The lines that go: those of a key held by min_docs documents, but in the last of these."""
    size = max(HEAVY, lines.count() // HEAVY_KEYS)
    hot = written(runs.total().where(F.col("n") >= min_docs))
    heavy = F.broadcast(hot.where(F.col("n") >= size).select("h1", "h2", "last"))
    rest = hot.where(F.col("n") < size).select("h1", "h2", "last").hint("merge")
    here = lines.join(heavy, ["h1", "h2"])
    there = lines.join(heavy, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"])
    return here.unionByName(there).where(F.col("doc_id") < F.col("last"))


def _with_places(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """row (all of a row of docs) and at, the places of its dropped lines in order (null: none)."""
    spark = docs.sparkSession
    staged = shared_dir(spark)
    per_doc = _hashed(docs, min_chars).withColumn("batch", F.pmod(F.hash("doc_id"), F.lit(batches)))
    per_doc.write.partitionBy("batch").parquet(staged)
    lines = spark.read.schema("doc_id long, th long, pos int, h1 long, h2 long, batch int").parquet(staged)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", "h1", "h2").distinct())
    places = _gone(lines, runs, min_docs).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    return d.join(places, ["doc_id", "th"], "left").select("row", "at")


def _kept(text: Column) -> Column:
    """Between two dropped places everything stays: slices, so that work is linear in the number of lines."""
    lines, at = _lines(text), F.col("at")
    edges = F.concat(F.array(F.lit(-1)), at, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda i: F.slice(lines, F.element_at(edges, i) + 2, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1))
    return F.when(at.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of each row of docs (doc_id, text).

    A key held by min_docs documents loses its lines everywhere but in the largest doc_id that holds it.
    """
    d = _with_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs, batches, fanout)
    n_dropped = F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long")
    return d.select("row.doc_id", F.size(_lines(F.col("row.text"))).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), _kept(F.col("row.text")).alias("kept"))


def line_deduped(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the kept text in place of text, and all other columns as they are."""
    d = _with_places(docs, min_chars, min_docs, batches, fanout)
    return d.select(F.col("row").withField("text", _kept(F.col("row.text"))).alias("row")).select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (
  SELECT doc_id, pos, ls[pos] AS line, translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM l)),
hot AS (SELECT k, max(doc_id) AS last FROM e WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT e.doc_id, e.pos, e.line, coalesce(e.doc_id < hot.last, false) AS gone FROM e LEFT JOIN hot USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
