"""Climate indices of a cell: counts, extremes, spells, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import season, season_year
from daygrid.operators.runs import run_figures

# The yearly indices, and the thresholds they count.
YEARLY = {
    "days_over_25": "count_if(tasmax > 25)", "days_over_30": "count_if(tasmax > 30)", "hottest": "max(tasmax)",
    "tropical_nights": "count_if(tasmin > 20)", "frost_days": "count_if(tasmin < 0)", "coldest": "min(tasmin)",
    "rain": "sum(pr)", "wet_days": "count_if(pr >= 1)", "rx1day": "max(pr)",
}


def yearly(daily: DataFrame, keys: Sequence[str] = config.KEY) -> DataFrame:
    return daily.groupBy(*keys, F.year("day").alias("year")).agg(*[F.expr(e).cast("double").alias(n) for n, e in YEARLY.items()])


def over_years(per_year: DataFrame, keys: Sequence[str] = config.KEY) -> DataFrame:
    names = [c for c in per_year.columns if c not in (*keys, "year")]
    return per_year.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def rain_of_days(daily: DataFrame, days: int = 5, keys: Sequence[str] = config.KEY) -> DataFrame:
    """Highest rain of ``days`` consecutive days inside each year (dense rows; a window with a gap is left out)."""
    w = W.partitionBy(*keys, "year").orderBy("day").rowsBetween(-(days - 1), 0)
    d = daily.withColumn("year", F.year("day")).withColumn(
        "_s", F.when(F.count("pr").over(w) == days, F.sum("pr").over(w)))
    return d.groupBy(*keys, "year").agg(F.max("_s").alias("value"))


def runs_per_year(daily: DataFrame, condition: Column, keys: Sequence[str] = config.KEY) -> DataFrame:
    """Longest run and mean run length of each year (a run is cut at the new year)."""
    return run_figures(daily.withColumn("year", F.year("day")), condition, (*keys, "year"))


def dry_spells(daily: DataFrame, keys: Sequence[str] = config.KEY, wet: float = config.WET_DAY_MM,
               first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Dry spells by season, cut at its edges: mean length (dry days over spells) and mean of the longest.

    Winters missing their December (or their new year) are left out.
    """
    d = daily.withColumns({"season": season("day"), "season_year": season_year("day")})
    if first_year is not None:
        d = d.filter(F.col("season_year") <= last_year).filter(
            F.when(F.col("season") == "DJF", F.col("season_year") > first_year).otherwise(F.col("season_year") >= first_year))
    per = run_figures(d, F.col("pr") < wet, (*keys, "season", "season_year"))
    return per.groupBy(*keys, "season").agg(
        F.coalesce(F.sum("days") / F.nullif(F.sum("runs"), F.lit(0)), F.lit(0.0)).alias("mean_length"),
        F.avg("longest").alias("longest"))


def month_anomalies(daily: DataFrame, name: str, keys: Sequence[str] = config.KEY, extra: Sequence[str] = ()) -> DataFrame:
    """Each value minus the mean of its calendar month."""
    w = W.partitionBy(*keys, F.month("day"))
    return daily.select(*keys, "day", *extra, (F.col(name) - F.avg(name).over(w)).alias("a"))


def persistence(daily: DataFrame, name: str, keys: Sequence[str] = config.KEY) -> DataFrame:
    """Correlation of a day's anomaly with the next day's, uncentred, over pairs both known (dense rows)."""
    w = W.partitionBy(*keys).orderBy("day")
    p = month_anomalies(daily, name, keys).withColumns({
        "b": F.lead("a").over(w), "_next": F.lead("day").over(w)}).filter(
        "a IS NOT NULL AND b IS NOT NULL AND datediff(_next, day) = 1")
    return p.groupBy(*keys).agg(
        (F.sum(F.col("a") * F.col("b")) / F.nullif(F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))), F.lit(0.0))
         ).alias("persistence"), F.count("*").alias("pairs"))
