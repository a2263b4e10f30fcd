"""Monthly climate diagrams and the windows they are drawn over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import window_first
from daygrid.functions.expr import half_even


def windows(requests: DataFrame, periods: DataFrame, year: str, span: int = config.CLIMATE_SPAN) -> DataFrame:
    """The served period holding each year, and ``span`` years of it centred on the year.

    ``periods`` is a handful of disjoint rows: broadcast."""
    p = periods.select("source", F.year("first_day").alias("_from"), F.year("last_day").alias("_to"))
    met = requests.join(F.broadcast(p), F.col(year).between(F.col("_from"), F.col("_to")))
    first = window_first(year, span, F.col("_from"), F.col("_to"))
    return met.withColumns({"window_from": first, "window_to": first + span - 1}).drop("_from", "_to")


def month_sums(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, year and month: sums and counts every window is later cut from.

    Windows of different searches overlap; the daily rows are reduced once and
    the few rows per month are what the windows re-read."""
    return daily.groupBy(*keys, F.year("day").alias("year"), F.month("day").alias("month")).agg(
        *[F.sum(n).alias(f"sum_{n}") for n in ("tas", "tasmin", "tasmax", "pr")],
        *[F.count(n).alias(f"n_{n}") for n in ("tas", "tasmin", "tasmax", "pr")],
        F.count("*").alias("days"))


def diagram(sums: DataFrame, keys: Sequence[str], years: int | None = None) -> DataFrame:
    """Twelve months: means, the rain of an average month, whether it is dry (P <= 2T).

    Rules read the full values; callers round last."""
    return _drawn(sums, keys, F.lit(years) if years else F.countDistinct("year"))


def _drawn(sums: DataFrame, keys: Sequence[str], years: Column) -> DataFrame:
    g = sums.groupBy(*keys, "month").agg(
        *[(F.sum(f"sum_{n}") / F.nullif(F.sum(f"n_{n}"), F.lit(0))).alias(n) for n in ("tas", "tasmin", "tasmax")],
        (F.sum("sum_pr") / F.nullif(F.sum("n_pr"), F.lit(0))).alias("_rain"),
        (F.sum("days") / years).alias("_length"))
    rain = F.col("_rain") * F.col("_length")
    return g.withColumns({"precipitation": rain, "dry": rain <= 2 * F.col("tas")}).drop("_rain", "_length")


#: Years of a window are bits of as many longs: 192 years on end.
YEAR_WORDS = 3


def window_diagram(sums: DataFrame, requests: DataFrame, keys: Sequence[str], request: str) -> DataFrame:
    """The diagram of each request (its source, window_from, window_to) out of the monthly sums.

    A window is summed once for all requests that share it, so that a request meets twelve rows and not twelve a year."""
    at = [*keys, "window_from", "window_to"]
    asked = requests.select(*at).distinct().withColumn("year", F.explode(F.sequence("window_from", "window_to")))
    names = [c for c in sums.columns if c.startswith(("sum_", "n_"))] + ["days"]
    word, bit = F.pmod(F.floor(F.col("year") / 64), F.lit(YEAR_WORDS)), F.expr("shiftleft(1L, CAST(year % 64 AS INT))")
    held = [F.bit_or(F.when(word == k, bit).otherwise(0)).alias(f"_y{k}") for k in range(YEAR_WORDS)]
    each = asked.join(sums, [*keys, "year"]).groupBy(*at, "month").agg(*[F.sum(n).alias(n) for n in names], *held)
    years = sum((F.bit_count(F.bit_or(f"_y{k}")) for k in range(1, YEAR_WORDS)), F.bit_count(F.bit_or("_y0")))
    return _drawn(requests.select(request, *at).join(each, at), (request,), years)


def rounded(months: DataFrame, digits: int = 1) -> DataFrame:
    return months.withColumns({
        n: half_even(n, digits) for n in ("tas", "tasmin", "tasmax", "precipitation")})


def annual_line(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the twelve months, total rain (both only when all twelve are known), the dry months."""
    full = lambda n, value: F.when(F.count(n) == 12, value)
    return months.groupBy(*keys).agg(
        full("tas", F.sum("tas") / 12).alias("temperature"),
        full("precipitation", F.sum("precipitation")).alias("rain"),
        F.array_sort(F.collect_list(F.when(F.col("dry"), F.col("month")))).alias("dry_months"))


def axis_window(months: DataFrame, keys: Sequence[str], rain_per_degree: float = 2.0) -> DataFrame:
    """Temperature axis of a diagram: from 0 (or the five under the coldest month) to the ten above."""
    high = F.greatest(F.max("tas"), F.max(F.col("precipitation") / rain_per_degree), F.lit(0.0))
    low = F.least(F.min("tas"), F.lit(0.0))
    return months.groupBy(*keys).agg(
        F.least(F.lit(0.0), F.floor(low / 5) * 5.0).alias("bottom"),
        F.greatest(F.lit(20.0), F.ceil(high / 10) * 10.0).alias("top"),
        F.greatest(F.lit(10.0), F.ceil(F.greatest(F.max("tas"), F.lit(0.0)) / 10) * 10.0).alias("label_top"))
