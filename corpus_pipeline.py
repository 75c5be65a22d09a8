"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and reread as the next one's input.

quality: rows that the classifier rejects go.
lines: lines that three documents share go, but from the largest doc_id.
near_copies: of each group of rows linked at a 5-word-shingle similarity of 0.8 one stays, that of the smallest doc_id; rows without doc_id come after all others.
benchmark: documents that hold a benchmark passage go.
pieces: what is left, encoded and decoded.

The stages that drop rows decide row by row, so repeated ids and rows without doc_id are treated like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.chunks import shared_dir, written
from pagetide.llm.decontaminate import decontaminated
from pagetide.llm.line_dedup import line_deduped
from pagetide.llm.ngram_join import ngram_components
from pagetide.llm.pieces import encode_pieces
from pagetide.llm.quality import quality_scores


def _numbered(docs: DataFrame) -> DataFrame:
    """n, a number of each row, and row, all of its columns whatever their names."""
    return written(docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row")), compression="zstd")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A score depends on the text alone, so a row is told by its id and its text's hash."""
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias("k")
    scores = quality_scores(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), spark.read.parquet(f"{sf_dir}/labels.parquet"), row="th")
    rejected = scores.where("predicted = 0").select(known("doc_id"), F.col("row").alias("th")).distinct()
    return docs.select(known("doc_id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row")).join(rejected, ["k", "th"], "left_anti").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_deduped(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = ngram_components(rows.select(F.col("n").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("n"), "component_id")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "n")
    kept = groups.join(rows.select("n", F.col("row.doc_id").alias("id")), "n").groupBy("component_id").agg(F.min(order).alias("first")).select("first.n")
    return rows.join(kept, "n", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, real=False)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pieces", pieces)]

#: A classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
    return df
