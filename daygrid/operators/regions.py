"""Regional series, indicators, trends and warming levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import season, season_year


def members(cells: DataFrame, inside: DataFrame) -> DataFrame:
    """(region, cell) with the area weight of the cell; a cell can be in several regions."""
    return inside.join(cells.select("cell_id", "lat"), "cell_id").select(
        "region", "cell_id", F.cos(F.radians("lat")).alias("w"))


def valid_cells(daily: DataFrame, name: str, share: float = 1.0) -> DataFrame:
    """Cells known on at least ``share`` of their days (every day by default)."""
    return daily.groupBy("source", "cell_id").agg(F.count(name).alias("_v"), F.count("*").alias("_n")).filter(
        F.col("_v") >= share * F.col("_n")).select("source", "cell_id")


def weighted(value: Column, w: str = "w") -> Column:
    known = F.when(value.isNotNull(), F.col(w))
    return F.sum(known * value) / F.sum(known)


def daily_mean(daily: DataFrame, regions: DataFrame, name: str, share: float = 1.0) -> DataFrame:
    """Area-weighted mean and plain maximum of each region and day, over its valid cells."""
    kept = daily.join(valid_cells(daily, name, share), ["source", "cell_id"], "left_semi")
    return kept.join(regions, "cell_id").groupBy("source", "region", "day").agg(
        weighted(F.col(name)).alias(name), F.max(name).alias(f"{name}_max"))


def yearly_and_seasonal(series: DataFrame, name: str, total: bool, keys: Sequence[str] = ("source", "region")) -> DataFrame:
    """One value per year and per season with its days; December goes with the next winter.

    Each day counts in two groups, so it is exploded once: one shuffle for both sets.
    """
    slots = F.explode(F.array(F.struct(F.year("day").alias("year"), F.lit("year").alias("season")),
                              F.struct(season_year("day").alias("year"), season("day").alias("season")))).alias("s")
    value = F.sum(name) if total else F.avg(name)
    return series.select(*keys, name, slots).groupBy(*keys, "s.year", "s.season").agg(
        value.alias("value"), F.count(name).alias("days"))


# Yearly indicators of a cell.
INDICATORS = {"tx35": "count_if(tasmax >= 35)", "tn20": "count_if(tasmin > 20)", "frost": "count_if(tasmin < 0)",
              "txx": "max(tasmax)", "rain": "sum(pr)", "rx1day": "max(pr)"}


def indicators(daily: DataFrame, regions: DataFrame, names: Sequence[str] = tuple(INDICATORS), share: float = 1.0) -> DataFrame:
    """Indicators of each cell and year, then their area-weighted mean by region."""
    kept = daily.join(valid_cells(daily, "tasmax", share), ["source", "cell_id"], "left_semi")
    per_cell = kept.groupBy("source", "cell_id", F.year("day").alias("year")).agg(
        *[F.expr(INDICATORS[n]).cast("double").alias(n) for n in names])
    return per_cell.join(regions, "cell_id").groupBy("source", "region", "year").agg(
        *[weighted(F.col(n)).alias(n) for n in names])


def centred_mean(yearly: DataFrame, keys: Sequence[str], value: str = "value", width: int = config.TREND_YEARS) -> DataFrame:
    """Mean of ``width`` years around each ([y - width/2, y + width/2 - 1]); NULL unless all are known."""
    half = width // 2
    w = W.partitionBy(*keys).orderBy("year").rangeBetween(-half, half - 1)
    return yearly.withColumn("smooth", F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def warming_levels(smooth: DataFrame, keys: Sequence[str], levels: Sequence[float] = config.WARMING_LEVELS) -> DataFrame:
    """First year the smoothed anomaly reaches each level, and its maximum."""
    return smooth.groupBy(*keys).agg(
        *[F.min(F.when(F.col("smooth") >= v - 1e-9, F.col("year"))).alias(f"level_{k + 1}") for k, v in enumerate(levels)],
        F.max("smooth").alias("highest"))


def anomalies(yearly: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value") -> DataFrame:
    """Each value minus the mean of its own series over first..last."""
    w = W.partitionBy(*keys)
    return yearly.withColumn("anomaly", F.col(value) - F.avg(F.when(F.col("year").between(first, last), F.col(value))).over(w))


def trend(yearly: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Linear trend per decade."""
    return yearly.groupBy(*keys).agg((10 * F.regr_slope(F.col(value), F.col("year").cast("double"))).alias("per_decade"),
                                     F.count(value).alias("years"))


def summer_figures(series: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """June to August: mean, P90, P99, days at 30 degC or more."""
    s = series.filter(F.month("day").isin(6, 7, 8))
    q = F.percentile(name, F.array(F.lit(0.9), F.lit(0.99)))
    return s.groupBy(*keys).agg(F.avg(name).alias("mean"), q.alias("_q"), F.count_if(F.col(name) >= 30).alias("hot_days")).select(
        *keys, "mean", F.get("_q", F.lit(0)).alias("p90"), F.get("_q", F.lit(1)).alias("p99"), "hot_days")


def from_months(monthly: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Annual and June-August means of monthly values weighted by the length of the month; whole years only."""
    length = F.dayofmonth(F.last_day(F.make_date(F.col("year"), F.col("month"), F.lit(1))))
    m = monthly.filter(F.col(value).isNotNull()).withColumn("_d", length)
    summer = F.when(F.col("month").isin(6, 7, 8), F.col("_d"))
    return m.groupBy(*keys, "year").agg(
        F.count("*").alias("_n"), (F.sum(F.col(value) * F.col("_d")) / F.sum("_d")).alias("annual"),
        (F.sum(F.col(value) * summer) / F.sum(summer)).alias("jja")).filter("_n = 12").drop("_n")


def lag_behind(yearly: DataFrame, keys: Sequence[str], observed: str, recent: tuple[int, int],
               calibrations: Sequence[tuple[int, int]], value: str = "value") -> DataFrame:
    """What a corrected source lacks of the observed change from each calibration period to a recent one."""
    within = lambda p: F.avg(F.when(F.col("year").between(*p), F.col(value)))
    cols = [(within(recent) - within(c)).alias(f"c{k}") for k, c in enumerate(calibrations)]
    moved = yearly.groupBy("source", *keys).agg(*cols)
    obs = moved.filter(F.col("source") == observed).select(*keys, *[F.col(f"c{k}").alias(f"o{k}") for k in range(len(cols))])
    met = moved.filter(F.col("source") != observed).join(obs, list(keys))
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("from_year"), F.lit(b).alias("to_year"), (F.col(f"c{k}") - F.col(f"o{k}")).alias("lag"))
        for k, (a, b) in enumerate(calibrations)])).alias("r")
    return met.select("source", *keys, rows).select("source", *keys, "r.*")


def annual_maximum(daily: DataFrame, keys: Sequence[str], name: str = "tasmax") -> DataFrame:
    return daily.groupBy(*keys, F.year("day").alias("year")).agg(F.max(name).alias("value"))
