"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, exact_dedup, language_id, lm_scoring, minhash, packing, quality, sharding, token_counts, toxicity
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)),
        "op2_token_counts": lambda spark, d: token_counts.token_counts(documents(spark, d)),
        "op3_bpe_codec": lambda spark, d: bpe_codec.codec_digests(documents(spark, d)),
        "op4_lm_scoring": lambda spark, d: lm_scoring.lm_scores(documents(spark, d)),
        "op5_toxicity": lambda spark, d: toxicity.toxicity(documents(spark, d), _labels(spark, d)),
        "op6_language_id": lambda spark, d: language_id.language_id(documents(spark, d)),
        "op7_sharding": lambda spark, d: sharding.shard(documents(spark, d)),
        "op8_minhash_near_dedup": lambda spark, d: minhash.near_duplicates(documents(spark, d)),
        "op9_packing": lambda spark, d: packing.pack(documents(spark, d)),
        "op10_quality_rules": lambda spark, d: quality.quality(documents(spark, d), _labels(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op7_sharding": sharding.ORACLE_SQL,
        "op8_minhash_near_dedup": minhash.ORACLE_SQL,
        "op10_quality_rules": quality.ORACLE_SQL,
    }
