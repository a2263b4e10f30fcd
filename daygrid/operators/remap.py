"""Weights from one grid to another, and values carried through them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.geo import laea_to_geographic, rotated_to_geographic
from daygrid.operators.blocks import weighted_sums
from daygrid.operators.grid import Grid
from daygrid.functions.expr import half_even


def overlap_weights(source: DataFrame, target: DataFrame, grid: Grid, step: float, pole: tuple[float, float],
                    subcells: int = config.SUBCELLS, min_cover: float = config.MIN_COVERAGE) -> DataFrame:
    """Area weights of rotated source cells in regular target cells.

    ``source``: cell_from, rlat, rlon (rotated degrees); ``target``: cell_to,
    row, col, lat. Each source cell is cut into ``subcells`` squared parts,
    exploded from two short sequences; every part falls in one target cell by
    index arithmetic. Targets covered under ``min_cover`` are dropped, the rest
    have weights that sum to 1. Parts of one pair are added before the shuffle.
    """
    part = (F.col("k") + 0.5) / subcells - 0.5
    cut = source.select("*", F.explode(F.sequence(F.lit(0), F.lit(subcells - 1))).alias("k")).withColumn(
        "_slat", F.col("rlat") + part * step).drop("k")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(subcells - 1))).alias("k")).withColumn(
        "_slon", F.col("rlon") + part * step).drop("k")
    lat, lon = rotated_to_geographic("_slat", "_slon", *pole)
    area = F.cos(F.radians("_slat")) * math.radians(step / subcells) ** 2
    sub = cut.select("cell_from", half_even((grid.north - lat) / grid.step).cast("long").alias("row"),
                     half_even((lon - grid.west) / grid.step).cast("long").alias("col"), area.alias("area"))
    pairs = sub.groupBy("row", "col", "cell_from").agg(F.sum("area").alias("area"))
    met = pairs.join(target.select("cell_to", F.col("row").cast("long"), F.col("col").cast("long"), "lat"), ["row", "col"])
    half = grid.step / 2
    whole = (F.sin(F.radians(F.least(F.col("lat") + half, F.lit(90.0)))) - F.sin(F.radians(F.col("lat") - half))
             ) * math.radians(grid.step)
    total = met.groupBy("cell_to").agg(F.sum("area").alias("_total"), F.first("lat").alias("lat"))
    kept = total.filter(F.col("_total") / whole >= min_cover).drop("lat")
    return met.join(kept, "cell_to").select("cell_to", "cell_from", (F.col("area") / F.col("_total")).alias("w"))


def remap(daily: DataFrame, weights: DataFrame, names: Sequence[str], min_weight: float = config.MIN_COVERAGE,
          strict: bool = False) -> DataFrame:
    """Weighted means of the valid source cells; NULL where they hold too little weight. All variables in one pass."""
    sums = weighted_sums(daily, weights, names)
    out = []
    for n in names:
        valid = F.col(f"weight_{n}")
        enough = (valid > min_weight) if strict else (valid > 0) & (valid >= min_weight - 1e-9)
        out.append(F.when(enough, F.col(f"sum_{n}") / valid).alias(n))
    return sums.select("source", F.col("cell_to").alias("cell_id"), "day", *out)


def bilinear_weights(target: DataFrame, source: DataFrame, grid: Grid) -> DataFrame:
    """Four weights per target point from the source lines around it (target: cell_to, lat, lon)."""
    y = (grid.north - F.col("lat")) / grid.step
    x = (F.col("lon") - grid.west) / grid.step
    t = target.withColumns({"_i": F.floor(y), "_j": F.floor(x), "_y": y - F.floor(y), "_x": x - F.floor(x)})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    wy = F.when(F.col("o.a") == 0, 1 - F.col("_y")).otherwise(F.col("_y"))
    wx = F.when(F.col("o.b") == 0, 1 - F.col("_x")).otherwise(F.col("_x"))
    four = t.select("cell_to", "_i", "_j", "_y", "_x", corners).select(
        "cell_to", (F.col("_i") + F.col("o.a")).alias("row"), (F.col("_j") + F.col("o.b")).alias("col"),
        (wy * wx).alias("w"))
    s = source.select("row", "col", F.col("cell_id").alias("cell_from"))
    return four.join(s, ["row", "col"]).filter("w > 0").select("cell_to", "cell_from", "w")


def bilinear(daily: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """Bilinear on the valid neighbours, renormalised; one valid neighbour is enough."""
    return remap(daily, weights, names, min_weight=0.0, strict=True)


def four_neighbours(target: DataFrame, source: DataFrame, grid: Grid) -> DataFrame:
    """The four source cells around each target point (target: cell_to, lat, lon)."""
    i = F.floor((grid.north - F.col("lat")) / grid.step)
    j = F.floor((F.col("lon") - grid.west) / grid.step)
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    four = target.select("cell_to", i.alias("_i"), j.alias("_j"), corners).select(
        "cell_to", (F.col("_i") + F.col("o.a")).alias("row"), (F.col("_j") + F.col("o.b")).alias("col"))
    return four.join(source.select("row", "col", F.col("cell_id").alias("cell_from")), ["row", "col"]).select(
        "cell_to", "cell_from")


def means_of_four(daily: DataFrame, four: DataFrame, name: str, rules: Sequence[int] = (4, 3, 1)) -> DataFrame:
    """Mean of the surrounding cells, one column ``<name>_<k>`` per rule "at least k of them are known", in one pass."""
    sums = weighted_sums(daily, four.withColumn("w", F.lit(1.0)), [name])
    known, total = F.col(f"weight_{name}"), F.col(f"sum_{name}")
    return sums.select("source", "cell_to", "day", *[F.when(known >= max(k, 1), total / known).alias(f"{name}_{k}") for k in rules])


def zonal(raster: DataFrame, cells: DataFrame, grid: Grid, layers: Sequence[str], x: Column, y: Column, mask: str) -> DataFrame:
    """Means of the layers of a projected raster over each cell's pixels where ``mask`` is positive; their count and share."""
    lat, lon = laea_to_geographic(x, y)
    at = raster.select(
        half_even((grid.north - lat) / grid.step).cast("long").alias("row"),
        half_even((lon - grid.west) / grid.step).cast("long").alias("col"), *layers, (F.col(mask) > 0).alias("_on"))
    on = F.count(F.when(F.col("_on"), 1))
    out = [F.count("*").alias("pixels"), on.alias("mask_pixels"), (on / F.count("*")).alias("mask_share"),
           *[F.avg(F.when(F.col("_on"), F.col(n))).alias(n) for n in layers]]
    per_cell = at.groupBy("row", "col").agg(*out)
    c = cells.select("cell_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return c.join(per_cell, ["row", "col"]).drop("row", "col")
