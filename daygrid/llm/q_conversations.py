"""Queries: structure repair of damaged conversations, prefix trie of rebuilt ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import cyk_repair, prefix_trie, shared
from daygrid.llm.catalog import query


def damaged(conversations):
    """Rows after damage by crc32 of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated or sent by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth")).drop("nth")


@query("op12_cyk_repair")
def repairs(spark, sf_dir):
    table = shared.table(spark, sf_dir, "conversations")
    rows = damaged(table)
    told = cyk_repair.summary(rows, table.select("conv_id"))
    lines = cyk_repair.repaired(rows, told)
    hashes = cyk_repair.line_hashes(lines)
    return told.join(hashes, F.expr("conv_id <=> of"), "left").select(
        *told.columns, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def rebuilt(conversations):
    """Keys of conversations that begin with up to three turns of the first one of their twenty."""
    placed = shared.written(prefix_trie.turns(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = placed.select("conv_id").distinct().select("conv_id", h.alias("h"), F.expr("conv_id - conv_id % 20").alias("base"))
    base = placed.filter("conv_id % 20 = 0 AND place <= 3").select(F.col("conv_id").alias("base"), "place", "id", "words")
    begun = convs.join(base, "base").filter("place <= h").select("conv_id", "place", "id", "words")
    every = convs.select("conv_id", F.lit(0).alias("place"), F.lit(b"").alias("id"), F.lit(None).cast("int").alias("words"))
    return prefix_trie.keys(placed.filter(F.col("place") > h).unionByName(begun).unionByName(every))


@query("op13_prefix_trie")
def shared_beginnings(spark, sf_dir):
    return prefix_trie.trie(rebuilt(shared.table(spark, sf_dir, "conversations")))
