"""The operators of this package applied to the supplied tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkin.llm import compression_bands, hyperplane_tree, jaccard_join, kd_shards, line_spread, lm_scores, merkle_manifest, sentence_pieces, source_mix, suffix_dedup, telephony, token_counts, url_filter

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(_documents(spark, sf_dir), PIECE_MODEL)


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.assign_shards(_documents(spark, sf_dir), n_shards=8)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_documents(spark, sf_dir), words=4, percent=85)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored_digests(_documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rules_frame(spark, url_filter.RULES))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "kept", "converged")


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.cross_entropy_difference(_documents(spark, sf_dir), good_documents(spark, sf_dir))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return compression_bands.judge(docs, compression_bands.fitted(docs, good_documents(spark, sf_dir)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), PIECE_MODEL)


def op11_hyperplane_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane_tree.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_documents(spark, sf_dir))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sentence_pieces, op2_kd_shards, op3_jaccard_join, op4_telephony, op5_url_filter, op6_line_spread, op7_source_mix, op8_lm_scores,
            op9_compression_bands, op10_token_counts, op11_hyperplane_tree, op12_merkle_manifest, op13_suffix_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.oracle_sql(4, 85), "op5_url_filter": url_filter.ORACLE_SQL, "op6_line_spread": line_spread.oracle_sql(), "op11_hyperplane_tree": hyperplane_tree.ORACLE_SQL, "op12_merkle_manifest": merkle_manifest.oracle_sql()}
