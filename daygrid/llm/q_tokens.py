"""Queries: token record files, BPE."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import bpe_words, record_files, shared
from daygrid.llm.catalog import query

END_ID = 2


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_record_files")
def record_file_digests(spark, sf_dir):
    folder = shared.shared_folder(spark, "records")
    index = record_files.write_records(shared.table(spark, sf_dir, "documents"), folder, vocabulary_file(), END_ID)
    placed = record_files.with_starts(index).repartition("file").sortWithinPartitions("file", "offset")
    return record_files.read_records(placed, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "file", "offset")


@query("op7_bpe_words")
def bpe_digests(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs)


def digests(docs):
    """Encoded, decoded, and told by their hashes."""
    both = bpe_words.encode(docs, vocabulary_file(), keep=["doc_id"], decoded="decoded")
    return both.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
