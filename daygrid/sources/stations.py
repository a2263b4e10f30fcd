"""Station text files: quality-coded daily values and station lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def dms_to_degrees(text: Column) -> Column:
    """"+47:12:30" to degrees."""
    t = F.trim(text)
    parts = F.split(F.regexp_replace(t, "^[+-]", ""), ":")
    size = (F.get(parts, F.lit(0)).cast("double") + F.get(parts, F.lit(1)).cast("double") / 60.0
            + F.get(parts, F.lit(2)).cast("double") / 3600.0)
    return F.when(t.startswith("-"), -size).otherwise(size)


def parse_daily(lines: DataFrame, scale: float = 10.0, keep_negative: bool = True) -> DataFrame:
    """Station, day and value of lines "station, source, yyyymmdd, value, quality".

    Headers and lines of another quality than 0 are left out. Anything that is
    not such a line parses to NULL and is dropped, so headers need no counting.
    """
    p = F.split(F.col("value"), ",")
    out = lines.select(
        F.trim(F.get(p, F.lit(0))).try_cast("bigint").alias("station_id"),
        F.try_to_date(F.trim(F.get(p, F.lit(2))), "yyyyMMdd").alias("day"),
        (F.trim(F.get(p, F.lit(3))).try_cast("double") / scale).alias("value"),
        F.trim(F.get(p, F.lit(4))).try_cast("int").alias("quality"),
    ).filter("station_id IS NOT NULL AND day IS NOT NULL AND quality = 0")
    if not keep_negative:
        out = out.filter("value >= 0")
    return out.select("station_id", "day", "value")


def parse_stations(lines: DataFrame) -> DataFrame:
    """Id, name, country, position in degrees and altitude of a station list."""
    p = F.split(F.col("value"), ",")
    return lines.select(
        F.trim(F.get(p, F.lit(0))).try_cast("bigint").alias("station_id"),
        F.trim(F.get(p, F.lit(1))).alias("name"), F.trim(F.get(p, F.lit(2))).alias("country"),
        dms_to_degrees(F.get(p, F.lit(3))).alias("lat"), dms_to_degrees(F.get(p, F.lit(4))).alias("lon"),
        F.trim(F.get(p, F.lit(5))).try_cast("double").alias("elevation"),
    ).filter("station_id IS NOT NULL AND elevation IS NOT NULL")


def well_observed(daily: DataFrame, days: int, share: float, value: str = "value") -> DataFrame:
    """Stations with at least ``share`` of ``days`` known values."""
    return (daily.groupBy("station_id").agg(F.count(value).alias("valid"))
            .filter(F.col("valid") >= share * days))
