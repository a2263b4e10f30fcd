"""Places to cells, cells to neighbours: index arithmetic and equi joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.expr import clip, half_even, month_table
from daygrid.functions.geo import squared_degrees
from daygrid.operators.blocks import lagged, neighbour_days
from daygrid.operators.spine import spread
from daygrid.session import written


@dataclass(frozen=True)
class Grid:
    """A regular grid: centre of its north-west cell, and its step, in degrees."""

    north: float
    west: float
    step: float


def _nearest_index(distance: Column, step: float) -> Column:
    """Index of the nearest line; the first of two equally near ones."""
    return F.ceil(distance / step - 0.5)


def _tie_safe(d: Column) -> Column:
    """Squared degrees as an integer: equal distances compare equal whatever their last bits."""
    return F.floor(d * 1e9 + 0.5)


def locate(places: DataFrame, cells: DataFrame, grid: Grid, keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Each place with its coarse cell; places outside the grid or the domain are left out."""
    at = places.withColumns({
        "_row": _nearest_index(grid.north - F.col("lat"), grid.step),
        "_col": _nearest_index(F.col("lon") - grid.west, grid.step)})
    c = cells.filter("domain").select(
        F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"),
        *[F.col(k) if k not in places.columns else F.col(k).alias(f"cell_{k}") for k in keep])
    half = grid.step / 2
    near = (F.abs(F.col("_clat") - F.col("lat")) <= half) & (F.abs(F.col("_clon") - F.col("lon")) <= half)
    return at.join(c, ["_row", "_col"]).filter(near).drop("_row", "_col", "_clat", "_clon")


def covered(points: DataFrame, cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Whether each point is in the domain."""
    inside = locate(points, cells, grid).select(key).withColumn("_in", F.lit(True))
    return points.join(inside, key, "left").withColumn("covered", F.coalesce("_in", F.lit(False))).drop("_in")


def map_cells(cells: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return cells.filter(F.col("land") & F.col("lat").between(south, north) & F.col("lon").between(west, east))


def locate_fine(places: DataFrame, fine: DataFrame, grid: Grid, key: str,
                radius: float = config.FINE_RADIUS) -> DataFrame:
    """Nearest valid fine cell of each place among the 3 x 3 around it, none farther than ``radius``.

    Candidates are exploded on the place side and met by an equi join on the
    index; the best one is a map-side combined ``min_by``.
    """
    span = (-1, 0, 1)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in span for b in span])
    at = places.select(
        key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        _nearest_index(grid.north - F.col("lat"), grid.step).alias("_i"),
        _nearest_index(F.col("lon") - grid.west, grid.step).alias("_j"), F.explode(offsets).alias("_o"),
    ).withColumns({"i": F.col("_i") + F.col("_o.a"), "j": F.col("_j") + F.col("_o.b")})
    f = fine.filter("domain").select("i", "j", "fine_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"))
    met = at.join(f, ["i", "j"])
    dlat, dlon = F.abs(F.col("_flat") - F.col("_lat")), F.abs(F.col("_flon") - F.col("_lon"))
    met = met.filter(F.greatest(dlat, dlon) <= radius + 1e-6)
    d = _tie_safe(squared_degrees("_lat", "_lon", "_flat", "_flon"))
    return met.groupBy(key).agg(F.min_by("fine_id", F.struct(d.alias("d"), "i", "j")).alias("fine_id"))


def nearest_fine(places: DataFrame, fine: DataFrame, grid: Grid, key: str, first: int = 4, growth: int = 8) -> DataFrame:
    """Nearest valid fine cell of each place, however far it lies.

    Places and cells meet in tiles; a place visits 3 x 3 of them, which hold every cell within one tile's
    width. An answer nearer than that width is final; places without one go on to tiles ``growth`` times
    as wide, up to the whole globe. Few places get far, so wide tiles are met by few rows.
    """
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = places.select(
        key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        _nearest_index(grid.north - F.col("lat"), grid.step).alias("_i"), _nearest_index(F.col("lon") - grid.west, grid.step).alias("_j"))
    f = written(fine.filter("domain").select("i", "j", "fine_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon")))
    found, tile, whole = None, first, math.ceil(360.0 / grid.step)
    while True:
        at = left.withColumn("_o", F.explode(moves)).withColumns({
            "_ti": F.floor(F.col("_i") / tile) + F.col("_o.a"), "_tj": F.floor(F.col("_j") / tile) + F.col("_o.b")})
        met = at.join(f.withColumns({"_ti": F.floor(F.col("i") / tile), "_tj": F.floor(F.col("j") / tile)}), ["_ti", "_tj"])
        d = _tie_safe(squared_degrees("_lat", "_lon", "_flat", "_flon"))
        best = met.groupBy(key, "_lat").agg(F.min_by("fine_id", F.struct(d.alias("d"), "i", "j")).alias("fine_id"), F.min(d).alias("_d"))
        sure = F.lit((tile - 0.5) * grid.step) * F.cos(F.radians("_lat"))
        if tile < whole:
            best = best.filter(F.col("_d") < F.floor(sure * sure * 1e9))
        here = written(best.select(key, "fine_id"))  # each round is built once, whatever the later ones read
        found = here if found is None else found.unionByName(here)
        if tile >= whole:
            return found
        left = written(left.join(here.select(key), key, "left_anti"))
        tile *= growth


def place_cells(places: DataFrame, cells: DataFrame, fine: DataFrame, coarse_grid: Grid, fine_grid: Grid,
                key: str = "place_id") -> DataFrame:
    """Where each place is read: coarse cell, fine cell if any, altitude lift if it applies."""
    at = locate(places, cells, coarse_grid)
    best = locate_fine(at, fine, fine_grid, key)
    about = fine.select("fine_id", F.col("eobs").alias("_eobs"), F.col("elevation").alias("_fine_elevation"),
                        F.col("lat").alias("_fine_lat"))
    own = cells.select("cell_id", F.col("elevation").alias("_elevation"), F.col("lat").alias("_lat"))
    out = at.join(best, key, "left").join(about, "fine_id", "left").join(own, "cell_id")
    on_fine = F.col("fine_id").isNotNull()
    lift = clip(F.col("_fine_elevation") - F.col("elevation"), -config.MAX_LIFT_M, config.MAX_LIFT_M)
    return out.withColumns({
        "lift": F.when(F.col("_eobs"), lift),
        "read_elevation": F.when(on_fine, F.col("_fine_elevation")).otherwise(F.col("_elevation")),
        "read_lat": F.when(on_fine, F.col("_fine_lat")).otherwise(F.col("_lat")),
    }).drop("_eobs", "_fine_elevation", "_fine_lat", "_elevation", "_lat")


def with_spots(at: DataFrame, key: str = "place_id", spot: str = "spot_id") -> DataFrame:
    """Number the distinct reading spots (cells and lift): places that share one share its series.

    The spot is named by its lowest place, so the number needs no global order.
    """
    keys = {"_f": F.coalesce("fine_id", F.lit(-1)), "_l": F.coalesce("lift", F.lit(1e9))}
    wide = at.withColumns(keys)
    named = wide.groupBy("cell_id", "_f", "_l").agg(F.min(key).alias(spot))
    return wide.join(named, ["cell_id", "_f", "_l"]).drop("_f", "_l")


def spots(at: DataFrame, spot: str = "spot_id") -> DataFrame:
    """One row per reading spot."""
    return at.groupBy(spot).agg(*[
        F.first(c).alias(c) for c in ("cell_id", "fine_id", "lift", "read_elevation", "read_lat")])


def lapse_rate(name: str, month: Column) -> Column:
    """K per km of a temperature in a month; the mean takes the mean of the two rates."""
    if name == "tas":
        rates = tuple(round((a + b) / 2, 2) for a, b in zip(config.LAPSE_TASMIN, config.LAPSE_TASMAX))
        return month_table(rates, month)
    return month_table(config.LAPSE_TASMIN if name == "tasmin" else config.LAPSE_TASMAX, month)


def lifted(name: str, value: Column, lift: Column, day: Column) -> Column:
    """A temperature brought from its cell to the altitude of the place, two decimals."""
    moved = half_even(value + lapse_rate(name, F.month(day)) * lift / 1000.0, 2)
    return F.when(lift.isNull() | (lift == 0), value).otherwise(moved)


#: What a row of a place is dealt by: all rows of one place are in one part.
DEALT = ("cell_id", "_share")
#: Places of one cell that stay together: so many series, and the days of their cells, are a task's least load.
SHARE = 32


#: Rows of sites that are sent to every task: some 50 bytes each. More of them meet the days by a shuffle.
SENT = 1_000_000


def shares(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with _share: the rows of a cell in shares of about ``size``.

    Rows that read one fine cell lie side by side, told apart by a hash of ``key``, so that its days go to few shares."""
    wide = rows.withColumn("_f", F.coalesce("fine_id", F.lit(-1)))
    held = wide.groupBy("cell_id", "_f").agg(F.count("*").alias("_n"))  # a row per fine cell
    before = F.sum("_n").over(W.partitionBy("cell_id").orderBy("_f").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    place = F.col("_before") + F.pmod(F.xxhash64(key), F.col("_n"))
    return wide.join(held.withColumn("_before", before), ["cell_id", "_f"]).withColumn(
        "_share", F.floor(place / size)).drop("_f", "_n", "_before")


def dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, *DEALT)


def parts_for(rows: DataFrame, size: int) -> int:
    """Parts for ``rows`` in shares of ``size``, and no fewer than keep every core at work."""
    spark = rows.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(-(-rows.count() // size), least)


def _meet_cells(who: DataFrame, coarse: DataFrame, fine: DataFrame, parts: int) -> DataFrame:
    """Rows of ``who`` (cell_id, _share, fine_id, lift, ...) with the daily values of their cells, temperatures brought to the place.

    Only the cells' own days travel, once to each share that reads them; ``who`` is fanned out where it lies, so the days
    of places are never shuffled. Where ``who`` has first_day and last_day (and a source), only those days are given.
    """
    who = who.withColumn("_f", F.coalesce("fine_id", F.lit(-1)))
    sites = written(who.select(*DEALT, "_f").distinct())
    # Days meet the shares that read them where they lie, as long as the sites are few enough to be sent.
    sent = F.broadcast if sites.count() <= SENT else lambda df: df
    temps = fine.select("source", F.col("fine_id").alias("_f"), "day", *[F.col(n).alias(f"_f_{n}") for n in config.TEMPERATURES])
    # A day without any value stays behind: it gives what a day that is not there gives.
    some = temps.filter(F.coalesce(*[f"_f_{n}" for n in config.TEMPERATURES]).isNotNull())
    far = dealt(some.join(sent(sites.filter("_f >= 0")), "_f"), parts)
    near = dealt(coarse.join(sent(sites.select(*DEALT).distinct()), "cell_id"), parts)
    here, on_fine = dealt(who, parts), [*DEALT, "_f", "source", "day"]
    if "first_day" in who.columns:
        asked = here.withColumn("day", F.explode(F.sequence("first_day", "last_day"))).drop("first_day", "last_day")
        met = asked.join(near, [*DEALT, "source", "day"]).join(far, on_fine, "left")
    else:
        # What a share holds of cells and sites is few beside the days of its places: both are hashed, nothing is sorted.
        # Places stream by, so the days of one come one after another and nearly in order: sorting them later costs little.
        site = dealt(sites, parts).hint("shuffle_hash").join(near, [*DEALT]).join(far.hint("shuffle_hash"), on_fine, "left")
        met = here.join(site.hint("shuffle_hash"), [*DEALT, "_f", *(c for c in ("source",) if c in who.columns)])
    return met.withColumns({
        n: lifted(n, F.when(F.col("_f") >= 0, F.col(f"_f_{n}")).otherwise(F.col(n)), F.col("lift"), F.col("day"))
        for n in config.TEMPERATURES}).drop("_f", *[f"_f_{n}" for n in config.TEMPERATURES])


def place_daily(at: DataFrame, coarse: DataFrame, fine: DataFrame, key: str = "place_id", keep: Sequence[str] = (),
                size: int = SHARE, parts: int | None = None) -> DataFrame:
    """Daily values at places: temperatures of the fine cell where there is one, lifted.

    ``at`` is read several times, and counted where ``parts`` are not given; it may bring its ``shares`` (of ``size`` places
    else), and a source, of which alone days are given. Rows that meet others dealt into parts need as many ``parts``.
    Rows stay hashed by ``DEALT``: windows and groups on keys that hold those columns add no shuffle. ``keep``: columns of
    ``at`` that go along.
    """
    rest = [c for c in coarse.columns if c not in ("cell_id", "source", "day")]
    who = at if "_share" in at.columns else shares(at, key, size)
    who = who.select(key, *DEALT, "fine_id", "lift", *(c for c in ("source",) if c in at.columns), *keep)
    met = _meet_cells(who, coarse, fine, parts_for(at, size) if parts is None else parts)
    return met.select(key, *DEALT, "fine_id", "lift", "source", "day", *rest, *keep)


def range_daily(ranges: DataFrame, coarse: DataFrame, fine: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """As ``place_daily``, for the days of ranges (``key``, source, first_day, last_day, cell_id, fine_id, lift, ...).

    Ranges are exploded to days where they lie, in shares of ``size`` ranges of a cell; they are counted and read several times."""
    return _meet_cells(shares(ranges, key, size), coarse, fine, parts_for(ranges, size)).drop("_share")


def capacity(cells: DataFrame, default: float = config.SOIL_CAPACITY_MM) -> DataFrame:
    return cells.withColumn("capacity", F.coalesce("capacity", F.lit(default)))


def mask_like(a: DataFrame, b: DataFrame, name: str, keys: Sequence[str] = ("cell_id", "day")) -> DataFrame:
    """Drop the values of ``a`` where ``b`` has the day without a value; other days are kept."""
    other = b.select(*keys, F.lit(1).alias("_here"), F.col(name).alias("_other"))
    hidden = F.col("_here").isNotNull() & F.col("_other").isNull()
    return a.join(other, list(keys), "left").withColumn(name, F.when(~hidden, F.col(name))).drop("_here", "_other")


def align_by_date(a: DataFrame, b: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Two sequences side by side by date: a missing date is a gap, never a shift."""
    return a.select(*keys, F.col(name).alias("a")).join(b.select(*keys, F.col(name).alias("b")), list(keys), "left")


def coarsen(daily: DataFrame, cells: DataFrame, name: str, factor: int = 2, rows: int | None = None) -> DataFrame:
    """Means of whole blocks; a block with a missing or absent cell has no value.

    ``rows`` of ``daily``, where they are known, spare a count: days go to blocks in parts whose number follows them.
    """
    index = cells.select("cell_id", F.floor(F.col("row") / factor).alias("block_row"),
                         F.floor(F.col("col") / factor).alias("block_col"))
    blocks = index.groupBy("block_row", "block_col").agg(F.count("*").alias("_n")).filter(
        F.col("_n") == factor * factor)
    whole = index.join(blocks.drop("_n"), ["block_row", "block_col"], "left_semi")
    full = F.count(name) == factor * factor
    by = ("source", "day", "block_row", "block_col")
    days = daily.join(whole, "cell_id").select(*by, name)
    return spread(days, daily.count() if rows is None else rows, *by).groupBy(*by).agg(F.when(full, F.avg(name)).alias(name))


def neighbours(daily: DataFrame, cells: DataFrame, name: str, lags: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Each value with the value k cells to the east and to the south of the same day.

    Days travel packed to square blocks of cells; only cells near an edge go to the next block as well.
    """
    return neighbour_days(daily, lagged(cells, lags), name)


def cos_latitude(lat: str = "lat") -> Column:
    return F.cos(F.radians(F.col(lat)))


def bounding_index(cells: DataFrame, grid: Grid) -> DataFrame:
    """Each cell's place in the smallest image holding them all, and the image's edges."""
    box = cells.agg(F.min("row").alias("top"), F.max("row").alias("_bottom"), F.min("col").alias("left_col"),
                    F.max("col").alias("_right"))
    out = cells.crossJoin(F.broadcast(box)).withColumns({
        "rows": F.col("_bottom") - F.col("top") + 1, "cols": F.col("_right") - F.col("left_col") + 1})
    pixel = (F.col("row") - F.col("top")) * F.col("cols") + F.col("col") - F.col("left_col")
    return out.withColumns({
        "pixel": pixel, "north_edge": grid.north - F.col("top") * grid.step + grid.step / 2,
        "west_edge": grid.west + F.col("left_col") * grid.step - grid.step / 2}).drop("_bottom", "_right")


def degrees_for_km(km: float) -> float:
    return km / (config.EARTH_KM * math.pi / 180)
