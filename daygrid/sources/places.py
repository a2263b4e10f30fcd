"""The list of towns: read as a tab-separated file, or built from a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.functions.expr import half_even

# Feature codes left out (sections of a town, historical, destroyed).
LEFT_OUT = ("PPLX", "PPLH", "PPLQ")
SCHEMA = "name STRING, latitude DOUBLE, longitude DOUBLE, country STRING, population BIGINT"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", schema=SCHEMA)


def write_places(places: DataFrame, path: str) -> None:
    places.write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def build_places(cities: DataFrame, names: DataFrame, south: float, north: float, west: float, east: float,
                 own_country: str = "FR") -> DataFrame:
    """Towns of the box under their best name, the largest first.

    ``cities``: gid, name, lat, lon, code, country, population.
    ``names``: gid, position (order in the file), name, preferred, short,
    colloquial, historic (booleans). The best name is one aggregate per town,
    so a town with very many names is combined before the shuffle.
    """
    rank = F.when(F.col("preferred"), 0).when(~F.col("short"), 1).otherwise(2)
    best = (names.filter(~F.col("colloquial") & ~F.col("historic"))
            .groupBy("gid").agg(F.min_by("name", F.struct(rank.alias("r"), "position")).alias("best_name")))
    kept = cities.filter(~F.col("code").isin(*LEFT_OUT)
                         & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    named = kept.join(best, "gid", "left").withColumn(
        "name", F.when(F.col("country") == own_country, F.col("name")).otherwise(F.coalesce("best_name", "name")))
    return named.select("gid", "name", half_even("lat", 4).alias("lat"), half_even("lon", 4).alias("lon"), "country",
                        "population").orderBy(F.desc("population"), "gid")


def largest(places: DataFrame, minimum: int, order: str = "place_id") -> DataFrame:
    """Towns of ``minimum`` people or more, the largest first, file order on a tie."""
    return places.filter(F.col("population") >= minimum).orderBy(F.desc("population"), order)
