"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read as the next one's input.

toxicity -> quality -> near_dedup -> mixing -> packing. The first four return the columns of documents; a row that
mixing takes n times stands n times in its result. Packing returns one row per piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import compression, minhash, mixing, packing, toxicity
from tessera.llm.common import cut, held_out, table
from tessera.llm.queries import vocabulary

THRESHOLD = 0.3
ROW = "__row"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 4, 2))
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0))
    return compression.score(docs, model, "__quality").where(F.col("__quality") >= THRESHOLD).drop("__quality")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for every row, written once so that it stays."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts: the one with the smallest id. Rows are compared, not ids, so
    different texts under one id are told apart; of empty texts one stays per id. Rows without an id all stay."""
    docs_in = numbered(docs)
    named = docs_in.where(F.col("doc_id").isNotNull())
    found = minhash.near_duplicates(named.select(F.col(ROW).alias("doc_id"), "text")).withColumnRenamed("doc_id", ROW)
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")), F.when(empty, F.col("doc_id"))]
    stay = (found.join(named.select(ROW, "doc_id"), ROW).groupBy(*[g.alias(f"__g{i}") for i, g in enumerate(group)])
            .agg(F.min(F.struct("doc_id", ROW))[ROW].alias(ROW)).select(ROW))
    left = named.join(stay, ROW, "left_semi").select(*docs.columns)
    return left.unionByName(docs_in.where(F.col("doc_id").isNull()).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    docs_in = numbered(docs)
    n = mixing.mix(docs_in, row=ROW).where(F.col("copies") > 0).select(ROW, "copies")
    return (docs_in.join(n, ROW)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    made = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), "bytes", end_id=2)
    digest = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixed), ("packing", packed)]

#: Trained models and tokenizers: not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
