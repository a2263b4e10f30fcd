"""Queries: language, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import compress_lang, gam_quality, shared
from daygrid.llm.catalog import query

LEAST_SCORE = 0.3


@query("op4_compress_lang")
def language(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    held_out = F.coalesce(shared.bucket_of("doc_id", 4) == 2, F.lit(False))
    model = compress_lang.learn(docs.filter(~held_out).select("lang", "text"))
    found = compress_lang.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def quality_model(docs, labels):
    """Learned from the labels whose ids are not held out."""
    return gam_quality.learn(docs, labels.filter(shared.bucket_of("doc_id", 5) != 0))


@query("op5_gam_quality")
def quality(spark, sf_dir):
    docs, labels = (shared.table(spark, sf_dir, name) for name in ("documents", "labels"))
    found = gam_quality.score(docs, quality_model(docs, labels))
    return found.select("doc_id", F.coalesce(shared.bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
