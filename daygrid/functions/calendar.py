"""Calendar columns: leap-safe slots, snow years, seasons, shifted dates, windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import Value, col

# First day (month * 100 + day) of each display season, in calendar order.
SEASON_STARTS = ((321, "spring"), (621, "summer"), (921, "autumn"), (1221, "winter"))
OPPOSITE = {"spring": "autumn", "summer": "winter", "autumn": "spring", "winter": "summer"}


def slot366(day: Value) -> Column:
    """Position of the month and day in a leap year, 0 to 365."""
    d = col(day)
    return F.datediff(F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d)), F.lit(date(2000, 1, 1)))


def is_leap(year: Value) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def slot365(day: Value) -> Column:
    """Day of the year, 0 to 364; 29 February takes the slot of the 28th."""
    d = col(day)
    of_year = F.dayofyear(d) - 1
    return of_year - F.when(is_leap(F.year(d)) & (of_year >= 59), 1).otherwise(0)


def snow_year(day: Value, reset_month: int = config.SNOW_RESET_MONTH) -> Column:
    """The year a winter counted from 1 August ends in."""
    d = col(day)
    return F.year(d) + F.when(F.month(d) >= reset_month, 1).otherwise(0)


def in_snow_season(day: Value) -> Column:
    return F.month(col(day)).isin(*config.SNOW_SEASON_MONTHS)


def season(day: Value) -> Column:
    """Meteorological season."""
    m = F.month(col(day))
    return (F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM")
            .when(m.isin(6, 7, 8), "JJA").otherwise("SON"))


def season_year(day: Value) -> Column:
    """Year of the season: December belongs to the next winter."""
    d = col(day)
    return F.year(d) + F.when(F.month(d) == 12, 1).otherwise(0)


def shifted(day: Value, years: Value) -> Column:
    """The same date some years later; 29 February becomes the 28th."""
    return F.add_months(col(day), (col(years) * 12).cast("int"))


def window_first(year: Value, span: int, first: Value, last: Value) -> Column:
    """First year of a window of ``span`` years centred on ``year``, kept inside first..last."""
    return F.least(F.greatest(col(year) - span // 2, col(first)), col(last) - span + 1)


def sliding_first(year: Value, span: int = config.SLIDING_YEARS, first: int = config.FIRST_YEAR,
                  last: int = config.LAST_YEAR) -> Column:
    return window_first(year, span, F.lit(first), F.lit(last))


def mid_year(first_day: Value, last_day: Value) -> Column:
    a = col(first_day)
    return F.year(F.date_add(a, F.floor(F.datediff(col(last_day), a) / 2).cast("int")))


def display_season(day: Value, latitude: Value) -> Column:
    """Season by the 21st of the month, swapped south of the equator."""
    d = col(day)
    stamp = F.month(d) * 100 + F.dayofmonth(d)
    north = F.lit("winter")
    for start, name in SEASON_STARTS:
        north = F.when(stamp >= start, name).otherwise(north)
    south = F.lit(None).cast("string")
    for name, other in OPPOSITE.items():
        south = F.when(north == name, other).otherwise(south)
    return F.when(col(latitude) < 0, south).otherwise(north)


def season_range(name: Value, year: Value, latitude: Value) -> Column:
    """First and last day of a display season opening in ``year``."""
    wanted = col(name)
    swapped = F.lit(None).cast("string")
    for here, other in OPPOSITE.items():
        swapped = F.when(wanted == here, other).otherwise(swapped)
    wanted = F.when(col(latitude) < 0, swapped).otherwise(wanted)
    y = col(year).cast("int")
    first = last = F.lit(None).cast("date")
    for k, (start, season_name) in enumerate(SEASON_STARTS):
        following = SEASON_STARTS[(k + 1) % 4][0]
        ends = y + (1 if following < start else 0)
        first = F.when(wanted == season_name, F.make_date(y, F.lit(start // 100), F.lit(start % 100))).otherwise(first)
        last = F.when(
            wanted == season_name,
            F.make_date(ends, F.lit(following // 100), F.lit(following % 100 - 1))).otherwise(last)
    return F.struct(first.alias("first_day"), last.alias("last_day"))


def season_requests(places: DataFrame, periods: DataFrame, latitude: Value = "lat", first_year: int = config.FIRST_YEAR,
                    last_year: int = config.LAST_YEAR) -> DataFrame:
    """Every (season, opening year) a served period holds whole, for each row of ``places``.

    ``periods`` is a handful of disjoint rows: the interval test is a broadcast join."""
    names = F.explode(F.array(*[F.lit(n) for _, n in SEASON_STARTS])).alias("season")
    asked = places.select("*", names).withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    asked = asked.withColumn("range", season_range("season", "year", latitude)).select(
        *places.columns, "season", "year", "range.first_day", "range.last_day")
    held = periods.select("source", F.col("first_day").alias("_from"), F.col("last_day").alias("_to"))
    return asked.join(F.broadcast(held), (F.col("first_day") >= F.col("_from")) & (F.col("last_day") <= F.col("_to"))).select(
        *places.columns, "season", "year", "source", "first_day", "last_day")


def dominant_season(ranges: DataFrame, key: str, latitude: Value = "lat") -> DataFrame:
    """The season most days of each range fall in; the later one on a tie."""
    days = ranges.filter("first_day <= last_day").select(
        key, col(latitude).alias("_lat"), F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return (
        days.groupBy(key, display_season("day", "_lat").alias("season"))
        .agg(F.count("*").alias("n"), F.max("day").alias("_last"))
        .groupBy(key)
        .agg(F.max_by("season", F.struct("n", "_last")).alias("season"), F.max("n").alias("days_in_season"))
    )


def season_title(first_day: Value, last_day: Value) -> Column:
    """"summer 2075" or "winter 2080-2081" where the range is one season of the northern calendar exactly, else its two dates."""
    a, b = col(first_day), col(last_day)
    names = dict(zip((3, 6, 9, 12), ("spring", "summer", "autumn", "winter")))
    name = F.lit(None).cast("string")
    for month, season_name in names.items():
        name = F.when(F.month(a) == month, season_name).otherwise(name)
    year = F.year(a)
    years = F.when(F.month(a) == 12, F.concat_ws("-", year, year + 1)).otherwise(year.cast("string"))
    exact = (F.dayofmonth(a) == 21) & (F.month(a) % 3 == 0) & (b == F.date_sub(F.add_months(a, 3), 1))
    return F.when(exact, F.concat_ws(" ", name, years)).otherwise(
        F.concat_ws(" / ", F.date_format(a, "yyyy-MM-dd"), F.date_format(b, "yyyy-MM-dd")))


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every day of a span with all calendar keys: a small dimension to broadcast."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return with_calendar(days)


def with_calendar(days: DataFrame, day: str = "day") -> DataFrame:
    return days.select(
        "*",
        F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("dom"),
        F.dayofyear(day).alias("doy"), slot366(day).alias("slot366"), slot365(day).alias("slot365"),
        snow_year(day).alias("snow_year"), in_snow_season(day).alias("winter"), season(day).alias("season"),
        season_year(day).alias("season_year"),
    )
