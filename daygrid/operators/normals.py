"""Daily normals: pooled over neighbouring days, or smoothed day by day for maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.calendar import slot365, slot366
from daygrid.functions.expr import half_even


def _wrapped(df: DataFrame, slots: int, half: int) -> DataFrame:
    """Each slot, and a copy of the first and last ones on the other side of the new year."""
    s = F.col("slot")
    copies = F.array_compact(F.array(s, F.when(s < half, s + slots), F.when(s >= slots - half, s - slots)))
    return df.withColumn("at", F.explode(copies))


def pooled(daily: DataFrame, names: Sequence[str], keys: Sequence[str], half: int = config.POOL_HALF_WINDOW,
           extremes: Sequence[str] = ()) -> DataFrame:
    """Mean of every value within ``half`` days of each of the 366 dates, any year, each value
    weighing the same; with the lowest and highest value for ``extremes``.

    Days are reduced to 366 rows of sums and counts per key before any window.
    """
    names = list(names)
    every = [*names, *[n for n in extremes if n not in names]]
    sums = daily.groupBy(*keys, slot366("day").alias("slot")).agg(
        *[F.sum(n).alias(f"_s_{n}") for n in every], *[F.count(n).alias(f"_n_{n}") for n in every],
        *[F.min(n).alias(f"_l_{n}") for n in extremes], *[F.max(n).alias(f"_h_{n}") for n in extremes])
    w = W.partitionBy(*keys).orderBy("at").rangeBetween(-half, half)
    wide = _wrapped(sums, 366, half)
    out = {n: F.sum(f"_s_{n}").over(w) / F.nullif(F.sum(f"_n_{n}").over(w), F.lit(0)) for n in every}
    out |= {f"{n}_min": F.min(f"_l_{n}").over(w) for n in extremes}
    out |= {f"{n}_max": F.max(f"_h_{n}").over(w) for n in extremes}
    return wide.withColumns(out).filter(F.col("at") == F.col("slot")).select(*keys, "slot", *out)


def pooled_by_reference(daily: DataFrame, names: Sequence[str], keys: Sequence[str], references: Sequence[int] = config.REFERENCES,
                        years: int = config.REFERENCE_YEARS) -> DataFrame:
    """``pooled`` for several reference periods (by first year, column ``reference``) out of one pass over the days."""
    year = F.year("day")
    held = F.array_compact(F.array(*[F.when(year.between(r, r + years - 1), F.lit(r)) for r in references]))
    return pooled(daily.withColumn("reference", F.explode(held)), names, [*keys, "reference"])


def of_ranges(normals: DataFrame, ranges: DataFrame, request: str, keys: Sequence[str], names: Sequence[str],
              digits: int = 2) -> DataFrame:
    """The normal of each day of each range (at most 92 rows to a range), rounded."""
    days = ranges.select(request, *keys, F.explode(F.sequence("first_day", "last_day")).alias("day")).withColumn(
        "slot", slot366("day"))
    met = days.join(normals, [*keys, "slot"], "left")
    # The last bits of a mean must not decide its last digit.
    return met.select(request, "day", *[half_even(half_even(n, 9), digits).alias(n) for n in names])


def smoothed(daily: DataFrame, name: str, keys: Sequence[str], first_year: int, last_year: int,
             width: int = config.MAP_NORMAL_DAYS) -> DataFrame:
    """Mean of each of the 365 days, then a plain moving mean of ``width`` days; NULL where a day is missing."""
    kept = daily.filter(F.year("day").between(first_year, last_year))
    per_slot = kept.groupBy(*keys, slot365("day").alias("slot")).agg(F.avg(name).alias("_m"))
    half = width // 2
    w = W.partitionBy(*keys).orderBy("at").rangeBetween(-half, half)
    wide = _wrapped(per_slot, 365, half).withColumn(
        "normal", F.when(F.count("_m").over(w) == width, F.avg("_m").over(w)))
    return wide.filter(F.col("at") == F.col("slot")).select(*keys, "slot", "normal")


def departure(daily: DataFrame, normal: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Each day minus the normal of its slot, as a whole number; a gap stays a gap."""
    met = daily.withColumn("slot", slot365("day")).join(normal, [*keys, "slot"], "left")
    return met.withColumn("anomaly", half_even(half_even(F.col(name) - F.col("normal"), 9)).cast("int")).drop("slot")
