"""Maps: one day of many cells. Every step is local to a (source, day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.functions.expr import half_even, steps

DAY = ["source", "day"]


def tenths(daily: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """Days x land cells of one variable in whole tenths of its unit, with their row and column."""
    land = cells.filter("land").select("cell_id", "row", "col")
    return daily.select(*DAY, "cell_id", name).join(land, "cell_id").select(
        *DAY, "cell_id", "row", "col", half_even(F.col(name) * 10).cast("int").alias("tenths"))


def in_order(field: DataFrame) -> DataFrame:
    return field.orderBy(*DAY, "row", "col")


def _beside(name: str, w: W, at: str, step: int) -> Column:
    """The value one line further, only if that line is the very next one."""
    there = F.lead(at, step).over(w) if step > 0 else F.lag(at, -step).over(w)
    value = F.lead(name, step).over(w) if step > 0 else F.lag(name, -step).over(w)
    return F.when(there == F.col(at) + step, value)


def smooth(field: DataFrame, name: str, passes: int = 1, row: str = "row", col: str = "col") -> DataFrame:
    """The 1-2-1 filter along rows then columns, ``passes`` times; missing neighbours are left out and
    the weights of the others renormalised, a missing value stays missing.

    One shuffle by (source, day) serves every pass: both windows are finer than it.
    """
    out = field.repartition(*DAY)
    for _ in range(passes):
        for along, across in ((row, col), (col, row)):
            w = W.partitionBy(*DAY, across).orderBy(along)
            before, after = _beside(name, w, along, -1), _beside(name, w, along, 1)
            out = out.withColumns({"_a": before, "_b": after})
            total = 2 * F.col(name) + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
            weight = 2 + F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
            out = out.withColumn(name, total / weight).drop("_a", "_b")
    return out


def day_summary(field: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Hottest and coldest cells (the first in row order on a tie), median, mean, count in each band."""
    value = F.col("tenths") / 10.0
    early = F.struct((-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
    known = field.filter("tenths IS NOT NULL")
    band = steps(value, tuple(edges))
    return known.groupBy(*DAY).agg(
        F.max(value).alias("hottest"), F.max_by("cell_id", F.struct("tenths", early.alias("e"))).alias("hottest_cell"),
        F.min(value).alias("coldest"), F.min_by("cell_id", F.struct("tenths", "row", "col")).alias("coldest_cell"),
        F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.count("*").alias("cells"),
        *[F.count_if(band == k).alias(f"band_{k}") for k in range(len(edges) + 1)])


def levels(field: DataFrame, step: int = 5) -> DataFrame:
    """Isobar levels of each day: multiples of ``step`` between the lowest and highest value (in tenths)."""
    g = field.groupBy(*DAY).agg(F.min("tenths").alias("lo"), F.max("tenths").alias("hi")).filter("lo IS NOT NULL")
    first, last = F.ceil(F.col("lo") / 10.0 / step), F.floor(F.col("hi") / 10.0 / step)
    return g.filter(first <= last).select(*DAY, F.explode(F.sequence(first, last)).alias("k")).select(
        *DAY, (F.col("k") * step).alias("level"))


def contours(field: DataFrame, step: int = 5, row: str = "row", col: str = "col") -> DataFrame:
    """Segments where a field in tenths crosses its levels: marching squares on the day's grid.

    Each square reads its four corners from neighbouring rows of the same day
    and is exploded only to the levels that cross it; squares with a gap are skipped.
    """
    by_row = W.partitionBy(*DAY, row).orderBy(col)
    by_col = W.partitionBy(*DAY, col).orderBy(row)
    f = field.select(*DAY, row, col, F.col("tenths").cast("double").alias("nw")).repartition(*DAY)
    f = f.withColumn("ne", _beside("nw", by_row, col, 1))
    f = f.withColumns({"sw": _beside("nw", by_col, row, 1), "se": _beside("ne", by_col, row, 1)})
    f = f.filter("nw IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL")
    low, high = F.least("nw", "ne", "sw", "se"), F.greatest("nw", "ne", "sw", "se")
    size = 10.0 * step
    first, last = F.floor(low / size) + 1, F.floor(high / size)
    q = f.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("level", F.col("_k") * step)
    at = F.col("level") * 10.0
    bit = lambda c, n: F.when(F.col(c) >= at, n).otherwise(0)
    q = q.withColumns({
        "case": bit("nw", 8) + bit("ne", 4) + bit("se", 2) + bit("sw", 1),
        "above": (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) / 4 >= at})
    cross = lambda a, b: (at - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))
    r, c = F.col(row).cast("double"), F.col(col).cast("double")
    side = {"top": (r, c + cross("nw", "ne")), "right": (r + cross("ne", "se"), c + 1),
            "bottom": (r + 1, c + cross("sw", "se")), "left": (r + cross("nw", "sw"), c)}

    def line(a, b):
        return F.struct(side[a][0].alias("row1"), side[a][1].alias("col1"), side[b][0].alias("row2"), side[b][1].alias("col2"))

    ends = {"left-bottom": ("left", "bottom"), "bottom-right": ("bottom", "right"), "left-right": ("left", "right"),
            "top-right": ("top", "right"), "top-bottom": ("top", "bottom"), "top-left": ("top", "left")}
    a = lambda *names: F.array(*[line(*ends[n]) for n in names])
    k = F.col("case")
    ring, rest = a("top-left", "bottom-right"), a("top-right", "left-bottom")
    found = (F.when(k.isin(1, 14), a("left-bottom")).when(k.isin(2, 13), a("bottom-right")).when(k.isin(3, 12), a("left-right"))
             .when(k.isin(4, 11), a("top-right")).when(k.isin(6, 9), a("top-bottom")).when(k.isin(7, 8), a("top-left"))
             .when(k == 5, F.when(F.col("above"), ring).otherwise(rest))
             .when(k == 10, F.when(F.col("above"), rest).otherwise(ring)))
    return q.withColumn("s", F.explode(found)).select(*DAY, "level", "s.*")


def period_mean(daily: DataFrame, name: str, first_year: int, last_year: int, months: Sequence[int]) -> DataFrame:
    kept = daily.filter(F.year("day").between(first_year, last_year) & F.month("day").isin(*months))
    return kept.groupBy("cell_id").agg(F.avg(name).alias(name))


def change(later: DataFrame, earlier: DataFrame, name: str) -> DataFrame:
    return later.join(earlier.withColumnRenamed(name, "_before"), "cell_id").select(
        "cell_id", (F.col(name) - F.col("_before")).alias(name))


def map_figures(field: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """Mean weighted by the cosine of the latitude, lowest and highest value of a map."""
    w = F.when(F.col(name).isNotNull(), F.cos(F.radians("lat")))
    return field.join(cells.select("cell_id", "lat"), "cell_id").agg(
        (F.sum(w * F.col(name)) / F.sum(w)).alias("mean"), F.min(name).alias("lowest"), F.max(name).alias("highest"))
