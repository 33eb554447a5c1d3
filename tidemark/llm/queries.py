"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id",))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import as_text, find_personal_data

    out = find_personal_data(_table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(n, ("email", "ip", "card", "phone")), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import IDS, saved, small
    from tidemark.llm.lm_scoring import cross_entropy_difference

    good = _table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").join(small(saved(good, "good"), IDS), "doc_id", "left")
    return cross_entropy_difference(docs, "good")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import held_out, score, train

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.pieces import encode

    out = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",), packed=True, round_trip=True)
    digests = (F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), *digests)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hard_negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", relabelled), anchors=F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_pieces": op12_pieces,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": sql.OP3,
    "op4_line_dedup": sql.OP4,
    "op6_decontamination": sql.OP6,
    "op8_minhash_dedup": sql.OP8,
    "op9_mixing": sql.OP9,
    "op11_divergence": sql.OP11,
    "op13_hard_negatives": sql.OP13,
}
