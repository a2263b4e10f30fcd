"""Daily records: served names, origin, dataset label; checks of a search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.units import convert


def records(df: DataFrame, simulated: str = config.SIMULATED, keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Stored names to served names, the wind in km/h, the origin of each day."""
    fields = [
        (convert("ms_to_kmh", n) if n == "sfcWind" else F.col(n)).alias(field)
        for n, field in config.RECORD_FIELDS.items()]
    origin = F.when(F.col("source") == simulated, "simulated").otherwise("observed").alias("origin")
    return df.select(*keep, "source", F.col("day").alias("date"), origin, *fields)


def dataset_label(temperatures: Column, fallback: Column, mask: Column, rest: Column,
                  word: str = "temperatures") -> Column:
    """"A (temperatures), B", with the fallback's name where the mask is off; one name when equal."""
    name = F.when(fallback.isNotNull() & ~mask, fallback).otherwise(temperatures)
    return F.when(name == rest, rest).otherwise(F.concat(name, F.lit(f" ({word}), "), rest))


def transformed(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A hook between reading and classifying: it must keep the columns of a record."""
    out = df.transform(fn)
    lost = [c for c in df.columns if c not in out.columns]
    if lost:
        raise ValueError(f"the transformation lost {', '.join(lost)}")
    return out


def validate(searches: DataFrame, periods: DataFrame, max_days: int = config.MAX_DAYS, references: Sequence[int] = config.REFERENCES) -> DataFrame:
    """Each search with the period that holds it whole and its status; a ``reference`` asked for is looked at first.

    ``periods`` is a handful of rows that never overlap, so the interval test is
    a broadcast join that matches at most one of them.
    """
    p = periods.select("source", F.col("first_day").alias("_from"), F.col("last_day").alias("_to"))
    held = searches.join(
        F.broadcast(p), (F.col("_from") <= F.col("first_day")) & (F.col("last_day") <= F.col("_to")), "left")
    days = F.datediff("last_day", "first_day") + 1
    unknown = ~F.coalesce(F.col("reference").isin(*references), F.lit(False)) if "reference" in searches.columns else F.lit(False)
    status = F.when(unknown, "UnknownReference").when(F.col("first_day") > F.col("last_day"), "EmptyRange").when(days > max_days, "RangeTooLong")
    if "lat" in searches.columns:
        status = status.when(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "OutsideDomain")
    if "elevation" in searches.columns:
        tall = F.col("elevation").between(config.MIN_ELEVATION_M, config.MAX_ELEVATION_M)
        status = status.when(~tall, "BadElevation")
    status = status.when(F.col("source").isNull(), "Unavailable").otherwise("ok")
    return held.withColumns({"days": days, "status": status}).drop("_from", "_to")


def with_domain_status(checked: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """Turn "ok" into "OutsideDomain" where the place has no cell."""
    cell = located.select(key, "cell_id")
    out = checked.join(cell, key, "left")
    return out.withColumn(
        "status", F.when((F.col("status") == "ok") & F.col("cell_id").isNull(), "OutsideDomain").otherwise(F.col("status")))


def always_valid(df: DataFrame, name: str, keys: Sequence[str] = config.KEY) -> DataFrame:
    """Keys whose value is known on every row they have."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(name).alias("_v")).filter("_n = _v").select(*keys)


def enough(df: DataFrame, name: str, share: float, keys: Sequence[str]) -> DataFrame:
    """Groups with at least ``share`` of their rows known, and the factor that scales a count to all rows."""
    n, v = F.count("*"), F.count(name)
    return df.groupBy(*keys).agg(n.alias("rows"), v.alias("valid")).filter(
        (F.col("valid") > 0) & (F.col("valid") >= share * F.col("rows"))
    ).withColumn("scale", F.col("rows") / F.col("valid"))
