"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, line_dedup, mixing, quality, repeats, shingle_join, topk, toxicity
from .shared import documents


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    coded = bpe.encode_documents(documents(spark, sf_dir, "doc_id", "text"), path, keep_text=False, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, table="labels"), keep_text=False)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count_tokens(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path())
    return counted.select("doc_id", bpe.n_bytes().alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
}
SQL = {"op3_mixing": mixing.ORACLE_ROWS.replace("{docs}", "documents")}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, table="labels"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(documents(spark, sf_dir, table="embeddings"))


QUERIES |= {"op7_toxicity": op7_toxicity, "op10_top_k": op10_top_k}
SQL["op10_top_k"] = topk.ORACLE


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = language.language(documents(spark, sf_dir, "doc_id", "text", "lang"), keep_text=False)
    return named.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


QUERIES["op8_language"] = op8_language


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(documents(spark, sf_dir, "doc_id", "text"))


QUERIES["op1_repeats"] = op1_repeats


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_documents(documents(spark, sf_dir, "doc_id", "text"))


QUERIES["op4_shingle_join"] = op4_shingle_join


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.later_lines(documents(spark, sf_dir, "doc_id", "text"))


QUERIES["op9_line_dedup"] = op9_line_dedup
