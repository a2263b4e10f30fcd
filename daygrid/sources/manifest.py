"""What a stored copy holds, as a small table kept beside it: one row per (source, year).

An increment is compared with the manifest and not with the archive: both sides are counted per (source, year) with an
order-free hash of their cell-days, and years that agree are never read. The manifest lies in ``_manifest`` inside the
copy (a name Spark passes over when it lists data) and is written after the data of its years, so a job that dies in
between leaves a manifest that tells too little: such a year is looked at again, never skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "_manifest"
SCHEMA = "n_rows long, n_cells long, first_day date, last_day date, digest long, source string, year int"


def manifest(df: DataFrame) -> DataFrame:
    """source, year, n_rows, n_cells (about), first_day, last_day and digest of rows with source, cell_id and day.

    The digest is a sum of 32-bit hashes of (cell_id, day): the order of rows and files does not matter, a row held twice
    does. A null day belongs to no year and is left out. Only the three key columns are read.
    """
    hashed = F.shiftright(F.xxhash64("cell_id", "day"), 32)
    return df.filter("day IS NOT NULL").groupBy("source", F.year("day").alias("year")).agg(
        F.count("*").alias("n_rows"), F.approx_count_distinct("cell_id").alias("n_cells"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), F.sum(hashed).alias("digest"))


def stored(spark: SparkSession, path: str, exists) -> DataFrame:
    """The manifest of the copy at ``path``; of a copy that has none, counted from its rows."""
    if exists(spark, f"{path}/{NAME}"):
        return spark.read.schema(SCHEMA).parquet(f"{path}/{NAME}")
    return manifest(spark.read.parquet(path))


def write(of: DataFrame, path: str) -> None:
    """Write the manifest rows ``of`` (source, year, ...); those of other years stay."""
    one = of.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1)
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "year").parquet(f"{path}/{NAME}")


def unlike(here: DataFrame, held: DataFrame) -> DataFrame:
    """(source, year) of the manifest ``here`` whose rows or digest are not those of the manifest ``held``."""
    same = ["source", "year", "n_rows", "digest"]
    return here.select(*same).join(held.select(*same), same, "left_anti").select("source", "year")


def differing(df: DataFrame, held: DataFrame) -> DataFrame:
    """(source, year) of ``df`` whose rows or digest are not those of the manifest ``held``."""
    return unlike(manifest(df), held)
