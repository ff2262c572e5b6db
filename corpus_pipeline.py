"""A cleaning pipeline over the documents table: five stages, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes and reads again
for the next stage. All but the last return the columns of ``docs``; the last returns packed pieces.

Near-duplicates are those of a similarity of 0.8 or more over five-word shingles.

doc_id is the key of the documents: rows repeated with the same doc_id and text are one document and
stay or go together. A null doc_id is an id like any other where rows are kept by id; null texts are
empty, fail the quality rules and go there. Empty tables pass through; other columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelkit.llm import exact_dedup, minhash, packing, quality, toxicity
from parcelkit.llm.common import text_of
from parcelkit.plans.lineage import checkpoint_folder, delete

#: Near copies share at least so many per cent of their shingles.
NEAR = 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among those of ``kept``; null ids match null ids."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return _of(docs, exact_dedup.exact_dedup(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return _of(docs, minhash.near_duplicates(docs, NEAR).where("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs.select("doc_id", text_of().alias("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Learned scores and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written to the checkpoint folder and read again.

    A stage's table is deleted once the next one's is written; that of the last but one stays, for the result reads it.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
