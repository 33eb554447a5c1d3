"""A training corpus from raw documents: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import IDS, saved, small
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.mixing import mixed_text
from tidemark.llm.toxicity import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids of gone; ids alone are broadcast, up to a counted bound, so that texts stay where they are."""
    ids = small(saved(gone.select("doc_id").distinct(), "gone"), IDS)
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do documents of which nothing but blank lines is left by that."""
    cut = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied | F.col("text").isNull()).withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id; of repeated rows, too, one stays. Rows without an id are no copies of others."""
    left = _without(docs, near_duplicates(docs).where("not kept"))
    twice = small(saved(left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice"), IDS)
    return left.join(twice, "doc_id", "left_anti").union(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, those without an id too."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: shard, slot, part, doc_id and text of each piece of a document that a slot takes."""
    return mixed_text(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Training and scoring of the classifier cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
