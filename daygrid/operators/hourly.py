"""Hourly rows to UTC days, in one shuffle combined on the map side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.functions import humidity

# Fixed value: standard gravity, m s-2.
GRAVITY = 9.80665

STATISTICS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
Spec = Mapping[str, tuple[str, str, bool]]  # output: (field, statistic, stamped at the end of its hour)


def utc_day(ts: str, end_stamped: bool) -> Column:
    """Day of an hourly value; accumulations and extremes are stamped at the end of their hour."""
    return F.to_date(F.col(ts) - F.expr("INTERVAL 1 HOUR")) if end_stamped else F.to_date(ts)


def hourly_to_daily(df: DataFrame, spec: Spec, keys: tuple[str, ...] = ("cell_id",), ts: str = "ts") -> DataFrame:
    """One row per key and UTC day.

    When both stampings are asked for, a row falls in at most two days: it is
    exploded once (only in the last hour of attribution do the days differ), so
    one scan and one shuffle serve every statistic.
    """
    stamps = {end for _, _, end in spec.values()}
    if len(stamps) == 1:
        days = df.withColumn("day", utc_day(ts, stamps.pop())).withColumn("_use", F.lit("both"))
    else:
        own, before = utc_day(ts, False), utc_day(ts, True)
        targets = F.when(own == before, F.array(F.struct(own.alias("day"), F.lit("both").alias("use")))).otherwise(
            F.array(F.struct(own.alias("day"), F.lit("start").alias("use")),
                    F.struct(before.alias("day"), F.lit("end").alias("use"))))
        days = df.withColumn("_t", F.explode(targets)).withColumns(
            {"day": F.col("_t.day"), "_use": F.col("_t.use")}).drop("_t")
    out = []
    for name, (field, statistic, end) in spec.items():
        counted = F.when(F.col("_use").isin("both", "end" if end else "start"), F.col(field))
        out.append(STATISTICS[statistic](counted).alias(name))
    return days.groupBy(*keys, "day").agg(*out)


def hourly_fields(df: DataFrame) -> DataFrame:
    """Non-linear fields, computed on the hour before any reduction (K, Pa, m/s)."""
    vapour = humidity.saturation_pa("d2m")
    return df.withColumns({
        "wind_speed": F.hypot("u10", "v10"),
        "relative_humidity": humidity.relative_humidity("d2m", "t2m"),
        "specific_humidity": humidity.specific_from_vapour(vapour, "sp"),
        "height": F.col("geopotential") / GRAVITY,
    })


def box(df: DataFrame, west: float, east: float, lon: str = "lon") -> DataFrame:
    """Longitudes brought to -180..180 before the box is cut, so it may cross Greenwich."""
    wrapped = F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon))
    return df.withColumn(lon, wrapped).filter(F.col(lon).between(west, east))
