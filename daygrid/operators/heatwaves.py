"""Heat waves on a daily series: three quantile thresholds, in window form.

An episode is what lies between barriers (a day under S3, a gap, or any day of
three or more in a row under S2), trimmed to its first and last day at S2 or
more, if it lasts three days or more and one of its days is above S1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config


def thresholds(series: DataFrame, name: str, keys: Sequence[str], first: int, last: int,
               levels: tuple[float, float, float] = (config.HEAT_S1, config.HEAT_S2, config.HEAT_S3)) -> DataFrame:
    kept = series.filter(F.year("day").between(first, last))
    q = F.percentile(name, F.array(*[F.lit(v) for v in levels]))
    return kept.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.get("_q", F.lit(k)).alias(f"s{k + 1}") for k in range(3)])


def episodes(series: DataFrame, limits: DataFrame, name: str, keys: Sequence[str], min_days: int = config.HEAT_MIN_DAYS,
             max_dip: int = config.HEAT_MAX_DIP) -> DataFrame:
    """First and last day, length and peak of each heat wave (``limits``: keys, s1, s2, s3; dense days).

    A dip under S2 of more than ``max_dip`` days in a row ends it."""
    w = W.partitionBy(*keys).orderBy("day")
    s = series.select(*keys, "day", F.col(name).alias("v")).join(limits, list(keys))
    s = s.withColumn("_low", F.coalesce((F.col("v") < F.col("s2")).cast("int"), F.lit(0)))
    # A low day ends the wave if one of the stretches of max_dip + 1 days it lies in is low throughout.
    stretch = F.sum("_low").over(w.rowsBetween(0, max_dip))
    s = s.withColumn("_from", stretch == max_dip + 1)
    s = s.withColumn("_dip", F.max("_from").over(w.rowsBetween(-max_dip, 0)))
    kept = s.filter(~F.coalesce(F.col("v") < F.col("s3"), F.lit(True)) & ~F.col("_dip"))
    kept = kept.withColumn("_run", F.date_sub("day", F.row_number().over(w)))
    strong = F.when(F.col("v") >= F.col("s2"), F.col("day"))
    e = kept.groupBy(*keys, "_run").agg(
        F.min(strong).alias("first_day"), F.max(strong).alias("last_day"), F.max("v").alias("peak"), F.first("s1").alias("_s1"))
    return e.filter(F.col("peak") > F.col("_s1")).withColumn(
        "days", F.datediff("last_day", "first_day") + 1).filter(F.col("days") >= min_days).drop("_run", "_s1")


def days_per_year(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day")).groupBy(
        *keys, F.year("day").alias("year")).agg(F.count("*").alias("days"))
