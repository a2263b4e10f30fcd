"""Scores that judge a correction, each an aggregate per cell and then over cells.

Samples are (cell_id, day, value) tables; ``role`` names a sample (ref, raw,
corrected...) when several are stacked, so one pass scores them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.operators.blocks import lagged, neighbour_sums
from daygrid.functions.calendar import season
from daygrid.functions.expr import ratio
from daygrid.functions.quantiles import quantile_array
from daygrid.operators.indices import month_anomalies

CELL_MONTH = ["cell_id", "month"]


def stack(**samples: DataFrame) -> DataFrame:
    """Samples on top of each other under their role."""
    out = None
    for role, df in samples.items():
        one = df.select(F.lit(role).alias("role"), "cell_id", "day", "value")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("month", F.month("day"))


def moments(stacked: DataFrame, keys: Sequence[str] = ("role", "cell_id", "month"), wet: float | None = None) -> DataFrame:
    """Mean, P5 and P95 of each group, and with ``wet`` the share of wet days in percent."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    aggs = [F.avg("value").alias("mean"), q.alias("_q"), F.count("value").alias("n")]
    if wet is not None:
        aggs.append((100.0 * F.count_if(F.col("value") >= wet) / F.nullif(F.count("value"), F.lit(0))).alias("wet"))
    out = stacked.groupBy(*keys).agg(*aggs)
    rest = ["wet"] if wet is not None else []
    return out.select(*keys, "mean", F.get("_q", F.lit(0)).alias("p5"), F.get("_q", F.lit(1)).alias("p95"), *rest, "n")


def against(figures: DataFrame, reference: str, names: Sequence[str], keys: Sequence[str] = CELL_MONTH,
            percent: Sequence[str] = ()) -> DataFrame:
    """Each role minus the reference role, by name; in percent of it for the names given."""
    ref = figures.filter(F.col("role") == reference).select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    met = figures.filter(F.col("role") != reference).join(ref, list(keys))
    gap = {n: 100.0 * (ratio(n, F.when(F.col(f"_{n}") > 0, F.col(f"_{n}"))) - 1) if n in percent else F.col(n) - F.col(f"_{n}")
           for n in names}
    return met.select("role", *keys, *[g.alias(n) for n, g in gap.items()])


def over_cells(gaps: DataFrame, names: Sequence[str], by: Sequence[str] = ("role", "month")) -> DataFrame:
    """Mean and root mean square of the gaps over cells."""
    out = []
    for n in names:
        out += [F.avg(n).alias(f"{n}_bias"), F.sqrt(F.avg(F.col(n) * F.col(n))).alias(f"{n}_rms")]
    return gaps.groupBy(*by).agg(*out, F.count("*").alias("cells"))


def quantile_rows(stacked: DataFrame, n: int = config.LEVELS, wet: float | None = None,
                  keys: Sequence[str] = ("role", "cell_id", "month")) -> DataFrame:
    value = F.col("value") if wet is None else F.when(F.col("value") >= wet, F.col("value"))
    return stacked.withColumn("_v", value).groupBy(*keys).agg(quantile_array("_v", n).alias("q"), F.count("_v").alias("n"))


def wasserstein(rows: DataFrame, reference: str, n: int = config.LEVELS, min_days: int = 0,
                keys: Sequence[str] = CELL_MONTH) -> DataFrame:
    """Mean gap of the quantiles of each role to the reference; NULL when a sample holds too few days."""
    ref = rows.filter(F.col("role") == reference).select(*keys, F.col("q").alias("_q"), F.col("n").alias("_n"))
    met = rows.filter(F.col("role") != reference).join(ref, list(keys))
    total = F.aggregate(F.zip_with("q", "_q", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return met.select("role", *keys, F.when(F.least("n", "_n") >= min_days, total / n).alias("w1"))


def at_floor(w1: DataFrame, floor: str, by: Sequence[str] = ("month",)) -> DataFrame:
    """Median W1 of each role, and the share of cells at or under the floor role's W1."""
    low = w1.filter(F.col("role") == floor).select("cell_id", *by, F.col("w1").alias("_floor"))
    met = w1.filter((F.col("role") != floor) & F.col("w1").isNotNull()).join(low, ["cell_id", *by])
    return met.groupBy("role", *by).agg(
        F.percentile("w1", F.lit(0.5)).alias("median"), F.percentile("_floor", F.lit(0.5)).alias("floor"),
        F.avg((F.col("w1") <= F.col("_floor")).cast("double")).alias("at_floor"))


def occurrence(stacked: DataFrame, wet: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Share of wet days, of dry days and of days at a bound, in percent, by role, cell and month."""
    n = F.nullif(F.count("value"), F.lit(0))
    out = [(100.0 * F.count_if(F.col("value") >= wet) / n).alias("wet"), (100.0 * F.count_if(F.col("value") < wet) / n).alias("dry")]
    if low is not None:
        out.append((100.0 * F.count_if(F.col("value") <= low) / n).alias("at_low"))
    if high is not None:
        out.append((100.0 * F.count_if(F.col("value") >= high) / n).alias("at_high"))
    return stacked.groupBy("role", *CELL_MONTH).agg(*out)


def coherence(daily: DataFrame, cells: DataFrame, name: str, lags: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Uncentred correlation of each cell's month anomalies with the cell k to the east and to the south,
    averaged over the two, by season."""
    a = month_anomalies(daily, name).select("source", "cell_id", "day", "a")
    sums = neighbour_sums(a, lagged(cells, lags), "a", [m % 12 // 3 for m in range(1, 13)])
    r = F.sum("vo") / F.nullif(F.sqrt(F.sum("vv") * F.sum("oo")), F.lit(0.0))
    one_way = sums.groupBy("source", "cell_id", "part", "lag", "way").agg(r.alias("r"))
    named = F.element_at(F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")]), (F.col("part") + 1).cast("int"))
    return one_way.groupBy("source", "cell_id", named.alias("season"), "lag").agg(F.avg("r").alias("correlation"))


def change_signal(stacked: DataFrame, past: tuple[int, int], later: tuple[int, int], percent: bool, floor: float = 0.0
                  ) -> DataFrame:
    """Change of the mean and of the P95 between two periods, by role, cell and month."""
    year = F.year("day")
    both = stacked.withColumn("period", F.when(year.between(*past), "past").when(year.between(*later), "later")).filter(
        "period IS NOT NULL")
    m = moments(both, ("role", "cell_id", "month", "period"))
    keys = ["role", *CELL_MONTH]
    p = m.filter("period = 'past'").select(*keys, F.col("mean").alias("_m"), F.col("p95").alias("_p"))
    met = m.filter("period = 'later'").join(p, keys)
    def gap(a, b):
        if not percent:
            return F.col(a) - F.col(b)
        return 100.0 * (F.col(a) / F.when(F.col(b) > floor, F.col(b)) - 1)
    return met.select(*keys, gap("mean", "_m").alias("mean"), gap("p95", "_p").alias("p95"))


def in_boxes(cells: DataFrame, boxes: Sequence[tuple[str, float, float, float, float, bool | None]]) -> DataFrame:
    """(region, cell) by box (south, north, west, east) and land; a cell can be in several regions."""
    tests = []
    for name, south, north, west, east, land in boxes:
        t = F.col("lat").between(south, north) & F.col("lon").between(west, east)
        tests.append(F.when(t if land is None else t & (F.col("land") == land), F.lit(name)))
    return cells.select("cell_id", F.explode(F.array_compact(F.array(*tests))).alias("region"))


def medians(values: DataFrame, regions: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    return values.join(regions, "cell_id").groupBy("region", *by).agg(
        F.percentile(name, F.lit(0.5)).alias("median"), F.count(name).alias("cells"))


def wet_figures(stacked: DataFrame, wet: float, drizzle: float, keys: Sequence[str] = ("role", "cell_id", "month")) -> DataFrame:
    """Mean, wet frequency, drizzle frequency and its share of the rain."""
    v, n = F.col("value"), F.nullif(F.count("value"), F.lit(0))
    light = (v >= drizzle) & (v < wet)
    return stacked.groupBy(*keys).agg(
        F.avg(v).alias("mean"), (100.0 * F.count_if(v >= wet) / n).alias("freq"), (100.0 * F.count_if(light) / n).alias("drizzle"),
        (100.0 * F.sum(F.when(light, v).otherwise(0.0)) / F.nullif(F.sum(v), F.lit(0.0))).alias("drizzle_share"),
        F.count_if(v >= wet).alias("n_wet"))


def summary_from_levels(rows: DataFrame) -> DataFrame:
    """P5 and P95 as means of the levels around them (100 levels: the 5th and 6th, the 95th and 96th)."""
    low, high = F.floor(F.size("q") * 0.05).cast("int") - 1, F.floor(F.size("q") * 0.95).cast("int") - 1
    pair = lambda i: (F.get("q", i) + F.get("q", i + 1)) / 2.0
    return rows.withColumns({"p5": pair(low), "p95": pair(high)})


def half_of_years(df: DataFrame, day: str = "day", seed: int = 0) -> DataFrame:
    """``df`` with ``half``: true on exactly half of the years held (rounded down), the first in the order of a seeded hash.

    Years are few by nature; their table has one row each."""
    years = df.select(F.year(day).alias("_year")).distinct()
    order = W.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "_year").cast("binary")))
    drawn = years.withColumn("half", F.row_number().over(order) <= F.floor(F.count("*").over(W.partitionBy()) / 2))
    return df.join(drawn, F.year(day) == F.col("_year")).drop("_year")


def reliable_half(spread: DataFrame, name: str = "spread") -> DataFrame:
    """Cells whose spread is at most the median spread: one row of median is met by every cell."""
    median = spread.agg(F.percentile(name, F.lit(0.5)).alias("_median"))
    return spread.crossJoin(F.broadcast(median)).filter(F.col(name) <= F.col("_median")).drop("_median")


def altitude_class(elevation: Column, edges: Sequence[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(elevation >= e, 1).otherwise(0)
    return F.when(elevation.isNotNull(), out)


def by_class(gaps: DataFrame, classes: DataFrame, names: Sequence[str], by: Sequence[str] = ("role", "class")) -> DataFrame:
    """Cells, mean gap and root mean square of the gap in each class (``classes``: cell_id, class)."""
    return over_cells(gaps.join(classes, "cell_id"), names, by)


def cold_tail(gaps: DataFrame, depth: float = -10.0, skew: float = 7.0) -> DataFrame:
    """Cells where some month has P5 too cold by more than ``depth`` and more than ``skew`` beyond the P95."""
    hit = (F.col("p5") < depth) & (F.col("p95") - F.col("p5") > skew)
    return gaps.groupBy("role", "cell_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("cold_tail"))


def scenario_step(yearly: DataFrame, keys: Sequence[str], start: int, value: str = "value") -> DataFrame:
    """Least squares on (1, year, year >= start): the step, its two standard errors, the residual spread.

    The normal equations are sums, so one aggregate per series solves them: with
    both predictors and the value centred, a 2 x 2 system remains.
    """
    x, z, y = F.col("year") - start, (F.col("year") >= start).cast("double"), F.col(value)
    s = {"n": F.count(y), "x": F.sum(x), "z": F.sum(z), "y": F.sum(y), "xx": F.sum(x * x), "zz": F.sum(z * z),
         "xz": F.sum(x * z), "xy": F.sum(x * y), "zy": F.sum(z * y), "yy": F.sum(y * y)}
    g = yearly.filter(y.isNotNull()).groupBy(*keys).agg(*[v.alias(f"_{k}") for k, v in s.items()])
    c = lambda a, b, ab: F.col(f"_{ab}") - F.col(f"_{a}") * F.col(f"_{b}") / F.col("_n")
    g = g.withColumns({"_XX": c("x", "x", "xx"), "_ZZ": c("z", "z", "zz"), "_XZ": c("x", "z", "xz"),
                       "_XY": c("x", "y", "xy"), "_ZY": c("z", "y", "zy"), "_YY": c("y", "y", "yy")})
    g = g.withColumn("_det", F.col("_XX") * F.col("_ZZ") - F.col("_XZ") * F.col("_XZ"))
    step = (F.col("_XX") * F.col("_ZY") - F.col("_XZ") * F.col("_XY")) / F.nullif("_det", F.lit(0.0))
    slope = (F.col("_ZZ") * F.col("_XY") - F.col("_XZ") * F.col("_ZY")) / F.nullif("_det", F.lit(0.0))
    g = g.withColumns({"slope": slope, "step": step})
    rest = F.greatest(F.col("_YY") - F.col("slope") * F.col("_XY") - F.col("step") * F.col("_ZY"), F.lit(0.0))
    g = g.withColumn("residual", F.sqrt(rest / F.when(F.col("_n") > 3, F.col("_n") - 3)))
    return g.withColumn("two_se", 2 * F.col("residual") * F.sqrt(F.col("_XX") / F.col("_det"))).select(
        *keys, "step", "two_se", "residual", "slope")


def yearly_gaps(obs: DataFrame, grid: DataFrame, names: Sequence[tuple[str, str]], share: float = 0.8) -> DataFrame:
    """By cell and year: days observed, seasonal mean gaps, gap of the yearly extreme (("tasmax", "max"), ...).

    A season or a year with under ``share`` of its days in common has no gap.
    """
    g = grid.select("cell_id", "day", *[F.col(n).alias(f"_{n}") for n, _ in names])
    met = obs.select("cell_id", "day", *[n for n, _ in names]).join(g, ["cell_id", "day"])
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("variable"), F.lit(kind).alias("kind"), F.col(n).alias("o"), F.col(f"_{n}").alias("r")) for n, kind in names])).alias("p")
    p = met.select("cell_id", "day", rows).select("cell_id", "day", "p.*")
    both = F.col("o").isNotNull() & F.col("r").isNotNull()
    s = season("day")
    agg = [F.count("o").alias("days"), F.first("kind").alias("_kind"), F.count(F.when(both, 1)).alias("_n"), F.count("*").alias("_all"),
           F.avg(F.when(both, F.col("o") - F.col("r"))).alias("_mean")]
    for k in ("DJF", "MAM", "JJA", "SON"):
        here = s == k
        n = F.count(F.when(here & both, 1))
        agg.append(F.when(n >= share * F.count_if(here), F.avg(F.when(here & both, F.col("o") - F.col("r")))).alias(k))
    for side in ("o", "r"):
        v = F.when(both, F.col(side))
        agg += [F.max(v).alias(f"_max_{side}"), F.min(v).alias(f"_min_{side}")]
    out = p.groupBy("cell_id", F.year("day").alias("year"), "variable").agg(*agg)
    whole = F.col("_n") >= share * F.col("_all")
    extreme = F.when(F.col("_kind") == "max", F.col("_max_o") - F.col("_max_r")).otherwise(F.col("_min_o") - F.col("_min_r"))
    return out.select("cell_id", "year", "variable", "days", F.when(whole, F.col("_mean")).alias("annual"), "DJF", "MAM", "JJA", "SON",
                      F.when(whole, extreme).alias("extreme"))


def period_mean(yearly: DataFrame, name: str, first: int, last: int, share: float = 0.8, keys: Sequence[str] = ("cell_id", "variable")
                ) -> DataFrame:
    """Mean over the years of a period known on at least ``share`` of them."""
    kept = yearly.filter(F.col("year").between(first, last)).groupBy(*keys).agg(F.avg(name).alias(name), F.count(name).alias("_n"))
    return kept.withColumn(name, F.when(F.col("_n") >= share * (last - first + 1), F.col(name))).drop("_n")


def drift(yearly: DataFrame, name: str, halves: tuple[tuple[int, int], tuple[int, int]], share: float = 0.8,
          keys: Sequence[str] = ("cell_id", "variable")) -> DataFrame:
    """Mean of each half, their difference, and the trend per decade over all years."""
    a = period_mean(yearly, name, *halves[0], share, keys).withColumnRenamed(name, "first_half")
    b = period_mean(yearly, name, *halves[1], share, keys).withColumnRenamed(name, "second_half")
    t = yearly.groupBy(*keys).agg((10 * F.regr_slope(F.col(name), F.col("year").cast("double"))).alias("per_decade"))
    return a.join(b, list(keys)).join(t, list(keys)).withColumn("drift", F.col("second_half") - F.col("first_half"))


def covered_since(yearly: DataFrame, days: Column, complete: float, keys: Sequence[str] = ("cell_id", "variable")) -> DataFrame:
    """First year from which every year to the end is covered; NULL when the last one is not."""
    bad = F.coalesce(F.col("days") < complete * days, F.lit(True))
    g = yearly.groupBy(*keys).agg(F.max(F.when(bad, F.col("year"))).alias("_bad"), F.min("year").alias("_first"), F.max("year").alias("_last"))
    since = F.coalesce(F.col("_bad") + 1, F.col("_first"))
    return g.select(*keys, F.when(since <= F.col("_last"), since).alias("since"))


def spread_by(values: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Mean and standard deviation over cells in each class."""
    return values.filter(F.col(name).isNotNull()).groupBy(*by).agg(
        F.avg(name).alias("mean"), F.stddev_pop(name).alias("sd"), F.count("*").alias("cells"))


def by_period(yearly: DataFrame, name: str, periods: Sequence[tuple[int, int]], complete: float, keys: Sequence[str]) -> DataFrame:
    """Mean of the years of each period (numbered from 0); NULL where fewer than ``complete`` of them are known."""
    number, length = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (first, last) in enumerate(periods):
        inside = F.col("year").between(first, last)
        number, length = F.when(inside, k).otherwise(number), F.when(inside, last - first + 1).otherwise(length)
    rows = yearly.withColumns({"period": number, "_length": length}).filter("period IS NOT NULL")
    known = F.count(name) >= complete * F.max("_length")
    return rows.groupBy(*keys, "period").agg(F.when(known, F.avg(name)).alias(name))


def drift_by_approach(gaps: DataFrame, distances: DataFrame, name: str, near_km: float = 25.0) -> DataFrame:
    """Drift of a gap from period 0 to 1, by whether the nearest station was near in either (``distances``: cell_id, period, nearest_km)."""
    def both(df, keys, column):
        return df.groupBy(*keys).agg(*[F.max(F.when(F.col("period") == k, F.col(column))).alias(f"_{column}{k}") for k in (0, 1)])

    rows = both(gaps, ("cell_id", "variable"), name).join(both(distances, ("cell_id",), "nearest_km"), "cell_id", "left")
    first, second = F.col("_nearest_km0") < near_km, F.col("_nearest_km1") < near_km
    approach = F.when(first & second, "near").when(~first & second, "approached").when(~first & ~second, "far").when(first & ~second, "receded")
    drift = rows.select("variable", approach.alias("approach"), (F.col(f"_{name}1") - F.col(f"_{name}0")).alias(name))
    return spread_by(drift, ["variable", "approach"], name)


#: Upper bounds of the classes of station density (stations near a cell).
DENSITIES = (0, 1, 3, 7)
#: Altitudes that part the classes of cells, metres, and of mean station altitude minus cell altitude.
ALTITUDES = (300.0, 700.0, 1200.0, 1800.0)


def _told(name: str) -> list[Column]:
    return [F.avg(name).alias("mean"), F.sqrt(F.avg(F.col(name) * F.col(name))).alias("rms"), F.count("*").alias("cells")]


def by_density_and_altitude(gaps: DataFrame, name: str) -> DataFrame:
    """Mean and root mean square by class of density, of altitude, and of both (NULL: all classes)."""
    density = F.lit(0)
    for bound in DENSITIES:
        density = density + F.when(F.col("stations") > bound, 1).otherwise(0)
    rows = gaps.withColumns({"altitude": altitude_class(F.col("elevation"), ALTITUDES), "density": density}).filter("altitude IS NOT NULL")
    return rows.groupingSets([["variable", "density"], ["variable", "altitude"], ["variable", "altitude", "density"]], "variable", "altitude", "density").agg(*_told(name))


def by_station_height(gaps: DataFrame, name: str, above: float = 700.0) -> DataFrame:
    """Cells above an altitude by how high their stations stand against them, and the correlation over all cells with stations."""
    held, gap = gaps.filter("stations > 0"), F.col("height_gap")
    height = F.when(gap < -300, 0).when(gap < -100, 1).when(gap <= 100, 2).when(gap.isNotNull(), 3)
    classes = held.filter((F.col("elevation") >= above) & gap.isNotNull()).groupBy("variable", height.alias("height")).agg(*_told(name))
    return classes.join(held.groupBy("variable").agg(F.corr(name, "height_gap").alias("correlation")), "variable")


def station_scores(pairs: DataFrame, keys: Sequence[str], months: Sequence[int], min_season: int = 200, min_year: int = 300,
                   min_years: int = 10, lapse: float = config.PLAIN_LAPSE / 1000) -> DataFrame:
    """Seasonal bias and bias of the yearly extreme at stations, as read and brought to the station's altitude.

    ``pairs``: keys, day, o (station), s (grid), dz (grid minus station altitude).
    """
    both = pairs.filter("o IS NOT NULL AND s IS NOT NULL")
    inside = F.month("day").isin(*months)
    bias = both.groupBy(*keys).agg(
        F.avg(F.when(inside, F.col("s") - F.col("o"))).alias("_b"), F.count_if(inside).alias("_n"), F.first("dz").alias("dz"))
    ext = both.groupBy(*keys, F.year("day").alias("year")).agg(
        (F.max("s") - F.max("o")).alias("_e"), F.count("*").alias("_n")).filter(F.col("_n") >= min_year)
    ext = ext.groupBy(*keys).agg(F.avg("_e").alias("_e"), F.count("*").alias("_years"))
    out = bias.join(ext, list(keys), "left")
    season_bias = F.when(F.col("_n") > min_season, F.col("_b"))
    extreme = F.when(F.col("_years") >= min_years, F.col("_e"))
    return out.select(*keys, season_bias.alias("bias"), extreme.alias("extreme_bias"),
                      (season_bias + lapse * F.col("dz")).alias("bias_at_station"), (extreme + lapse * F.col("dz")).alias("extreme_at_station"))


def seam_excess(means: DataFrame, cells: DataFrame, mask: DataFrame, name: str = "value") -> DataFrame:
    """Mean jump between adjacent cells, across a change of source and not (``means``: cell_id, value)."""
    c = cells.select("cell_id", "row", "col").join(means, "cell_id").join(mask, "cell_id")
    moves = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")))).alias("m")
    near = c.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(name).alias("_v"), F.col("from_primary").alias("_p"))
    at = c.select("row", "col", name, "from_primary", moves).withColumns({"_r": F.col("row") + F.col("m.a"), "_c": F.col("col") + F.col("m.b")})
    met = at.join(near, ["_r", "_c"]).filter(F.col(name).isNotNull() & F.col("_v").isNotNull())
    return met.groupBy((F.col("from_primary") != F.col("_p")).alias("crossing")).agg(
        F.avg(F.abs(F.col(name) - F.col("_v"))).alias("jump"), F.count("*").alias("pairs"))


def calibrating(key: str, seed: int = 0) -> Column:
    """Whether a station is of the half that rates are fitted on; the other half judges them. Drawn by a seeded hash."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.col(key).cast("string")).cast("binary")), 1, 1) < "8"


def lapse_fit(gaps: DataFrame, max_dz: float = 1000.0) -> DataFrame:
    """K per km of each month: minus the slope of the gap (grid - station) on the altitude difference."""
    kept = gaps.filter(F.abs("dz") < max_dz)
    return kept.groupBy("month").agg((-1000 * F.regr_slope(F.col("gap"), F.col("dz"))).alias("k_per_km"), F.count("gap").alias("stations"))


def lapse_variants(gaps: DataFrame, fit: DataFrame, plain: Sequence[tuple[str, float]] = (("raw", 0.0), ("five", 5.0), ("standard", 6.5))
                   ) -> DataFrame:
    """Mean and mean absolute gap of each month under each rate, the fitted one included."""
    met = gaps.join(fit.select("month", "k_per_km"), "month")
    rates = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(float(v)).alias("rate")) for n, v in plain],
                              F.struct(F.lit("monthly").alias("variant"), F.col("k_per_km").alias("rate")))).alias("r")
    moved = met.select("month", "gap", "dz", rates).withColumn("g", F.col("gap") + F.col("r.rate") * F.col("dz") / 1000.0)
    return moved.groupBy("month", F.col("r.variant").alias("variant")).agg(
        F.avg("g").alias("mean"), F.avg(F.abs("g")).alias("absolute"), F.count("g").alias("stations"))


def daily_agreement(pairs: DataFrame, keys: Sequence[str], far: float = 3.0) -> DataFrame:
    """Correlation, root mean square gap and share of gaps above ``far``, day by day (o, s)."""
    d = F.col("s") - F.col("o")
    return pairs.filter("o IS NOT NULL AND s IS NOT NULL").groupBy(*keys).agg(
        F.corr("s", "o").alias("correlation"), F.sqrt(F.avg(d * d)).alias("rms"),
        F.avg((F.abs(d) > far).cast("double")).alias("far_share"), F.avg(d).alias("bias"))


def hottest_share(stacked: DataFrame, keys: Sequence[str], share: float = 0.05) -> DataFrame:
    """Mean of the hottest ``share`` of days of each key (at or above its quantile), and quantiles."""
    q = F.array(*[F.lit(v) for v in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)])
    cut = stacked.groupBy(*keys).agg(F.percentile("value", F.lit(1 - share)).alias("_cut"), F.percentile("value", q).alias("q"))
    met = stacked.join(cut, list(keys)).filter(F.col("value") >= F.col("_cut"))
    return met.groupBy(*keys).agg(F.avg("value").alias("hottest"), F.first("q").alias("q"))
