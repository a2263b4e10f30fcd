"""A corpus from raw documents to token ids: quality, near duplicates, secrets, mixing, encoding.

Every stage takes the documents its predecessor kept, written and read again, and returns the columns of ``documents``;
the last returns one row per kept copy with its ids by number and hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.llm import gam_quality, minhash_dedup, poisson_mix, q_classes, q_tokens, secret_owners, shared

#: The models that the last stages need cannot be said in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects. Rows without an id are scored like others and kept if they pass."""
    model = q_classes.quality_model(docs, shared.table(spark, sf_dir, "labels"))
    return gam_quality.kept(docs, model, q_classes.LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates."""
    gone = minhash_dedup.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return minhash_dedup.pick(docs, shared.written(gone, "gone"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace found secrets in the texts."""
    return secret_owners.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources in equal shares of characters, as many as there are."""
    return poisson_mix.mixed(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, told by number and hash."""
    return q_tokens.digests(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs.select(*[F.col(f"`{c}`") for c in columns]), name)
    return docs
