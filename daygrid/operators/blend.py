"""One observed reference out of a primary dataset and a fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid import config


def completeness(primary: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of the days each cell has a value, by variable (dense rows: one per day)."""
    return primary.groupBy("cell_id").agg(*[(F.count(n) / F.count("*")).alias(n) for n in names])


def monthly_gap(primary: DataFrame, fallback: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean primary - fallback of each cell and month over the days both have; NULL where none."""
    f = fallback.select("cell_id", "day", *[F.col(n).alias(f"_{n}") for n in names])
    met = primary.select("cell_id", "day", *names).join(f, ["cell_id", "day"])
    return met.groupBy("cell_id", F.month("day").alias("month")).agg(
        *[F.avg(F.col(n) - F.col(f"_{n}")).alias(n) for n in names])


def source_mask(share: DataFrame, gap: DataFrame, fallback: DataFrame, cells: DataFrame, in_fallback_area: DataFrame,
                names: Sequence[str], min_share: float = config.COMPLETE_SHARE, min_land: float = config.MIN_LAND_SHARE
                ) -> DataFrame:
    """Cells read from the primary dataset: complete, a gap in all 12 months, fallback known, on land,
    outside the area left to the fallback. ``cells`` has land_share."""
    full = None
    for n in names:
        full = (F.col(n) >= min_share) if full is None else full & (F.col(n) >= min_share)
    whole = share.select("cell_id", full.alias("_full"))
    twelve = gap.groupBy("cell_id").agg(F.least(*[F.count(n) for n in names]).alias("_months"))
    known = fallback.groupBy("cell_id").agg(F.least(*[F.count(n) for n in names]).alias("_known"))
    left_out = in_fallback_area.select("cell_id").distinct().withColumn("_area", F.lit(True))
    met = (cells.select("cell_id", "land_share").join(whole, "cell_id", "left").join(twelve, "cell_id", "left")
           .join(known, "cell_id", "left").join(left_out, "cell_id", "left"))
    mask = (F.coalesce("_full", F.lit(False)) & (F.coalesce("_months", F.lit(0)) == 12) & F.col("_area").isNull()
            & (F.coalesce("_known", F.lit(0)) > 0) & (F.col("land_share") >= min_land))
    return met.select("cell_id", mask.alias("from_primary"))


def blend(primary: DataFrame, fallback: DataFrame, gap: DataFrame, mask: DataFrame, names: Sequence[str]) -> DataFrame:
    """Primary where the mask says so, its missing days filled by fallback + the month's gap; fallback elsewhere.

    Daily rows meet once on (cell, day); the gaps and the mask are per cell and
    month, far smaller, and left to Spark's own broadcast threshold.
    """
    p = primary.select("cell_id", "day", *[F.col(n).alias(f"_p_{n}") for n in names])
    g = gap.select("cell_id", "month", *[F.col(n).alias(f"_g_{n}") for n in names])
    met = (fallback.select("cell_id", "day", *names).withColumn("month", F.month("day"))
           .join(p, ["cell_id", "day"], "left").join(mask, "cell_id").join(g, ["cell_id", "month"], "left"))
    out = [F.when(F.col("from_primary"), F.coalesce(f"_p_{n}", F.col(n) + F.col(f"_g_{n}"))).otherwise(F.col(n)).alias(n)
           for n in names]
    return met.select("cell_id", "day", "from_primary", *out)
