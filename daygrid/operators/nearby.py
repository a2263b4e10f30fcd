"""Nearest towns and stations: bucketed equi joins, pruned before rows meet."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import config
from daygrid.functions.geo import haversine_km
from daygrid.operators.grid import degrees_for_km
from daygrid.functions.expr import half_even
from daygrid.session import written


def _km(a: str, b: str, c: str, d: str) -> Column:
    return haversine_km(a, b, c, d)


def _order(km: Column) -> Column:
    """Kilometres as an integer of 0.1 mm, so that equal distances tie in both engines."""
    return F.floor(km * 1e7 + 0.5)


def one_per_spot(places: DataFrame, order: str, *, extra: Sequence[str] = ()) -> DataFrame:
    """The first place of the list at each exact position: copies of a place cannot swell a bucket."""
    return places.groupBy("lat", "lon", *extra).agg(F.min(order).alias(order))


def within(points: DataFrame, others: DataFrame, km: float, point_cols: Sequence[str], other_cols: Sequence[str]
           ) -> DataFrame:
    """Pairs closer than ``km``: the point is sent to the buckets its circle touches.

    Buckets are one radius wide, so a point visits few of them, and only
    buckets hold pairs at all; the longitude reach follows the latitude, and
    columns are counted round the globe, so that the 180th meridian is no edge.
    """
    size = degrees_for_km(km)
    around = max(1, int(360.0 / size))
    wide = 360.0 / around
    ring = F.cos(F.radians(F.least(F.abs(F.col("lat")) + size, F.lit(89.9))))
    reach = F.least(F.lit(size) / ring, F.lit(180.0))
    rows = F.sequence(F.floor((F.col("lat") - size) / size), F.floor((F.col("lat") + size) / size))
    west, east = F.floor((F.col("lon") - reach) / wide), F.floor((F.col("lon") + reach) / wide)
    cols = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + around - 1)), lambda c: F.pmod(c, F.lit(around))))
    p = points.select(*point_cols, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"),
                      F.explode(rows).alias("_b"), cols.alias("_cols"))
    p = p.select("*", F.explode("_cols").alias("_c")).drop("_cols")
    o = others.select(*[F.col(c).alias(f"other_{c}") if c in point_cols else F.col(c) for c in other_cols],
                      F.col("lat").alias("_olat"), F.col("lon").alias("_olon"),
                      F.floor(F.col("lat") / size).alias("_b"), F.pmod(F.floor(F.col("lon") / wide), F.lit(around)).alias("_c"))
    met = p.join(o, ["_b", "_c"]).withColumn("km", _km("_plat", "_plon", "_olat", "_olon"))
    return met.filter(F.col("km") <= km).drop("_b", "_c")


def nearest_place(points: DataFrame, places: DataFrame, key: str, order: str = "place_id",
                  max_km: float = config.NEAREST_MAX_KM) -> DataFrame:
    """The nearest town of each point, the first of the list on a tie; NULL beyond ``max_km``.

    Points at one position are searched once, so a popular position is no hot bucket.
    """
    spots = one_per_spot(places.select(order, "lat", "lon"), order)
    asked = one_per_spot(points.select(key, "lat", "lon"), key)
    pairs = within(asked, spots, max_km, [key], [order])
    best = pairs.groupBy(key).agg(F.min_by(F.struct(order, "km"), F.struct(_order(F.col("km")).alias("d"), order)).alias("b"))
    named = asked.join(best, key, "left").select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(f"b.{order}").alias(order), half_even(F.col("b.km"), 1).alias("distance_km"))
    same = F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon"))
    return points.select(key, "lat", "lon").join(named, same, "left").select(key, order, "distance_km")


def contrast_city(points: DataFrame, cities: DataFrame, key: str, order: str = "place_id", tile: float = 1.0
                  ) -> DataFrame:
    """The large city of another climate: nearest the point shifted 7.2 degrees south (north in
    the south), at least 300 km from the place.

    Points at one position are searched once. Positions and cities are bucketed in tiles. On tiles alone (at most 64 800 of
    one degree, whatever the number of cities) each tile of points keeps the tiles that can hold its answer: none surely
    too near the place, lower bound of the distance no greater than the best upper bound of a tile surely far enough.
    Kept tiles are cut in sixteen and pruned again, twice. Rows then meet by an equi join on the narrowest tiles only.
    """
    shift = F.when(F.col("lat") < config.CONTRAST_SOUTH_LAT, config.CONTRAST_SHIFT_DEG).otherwise(
        -config.CONTRAST_SHIFT_DEG)
    asked = one_per_spot(points.select(key, "lat", "lon"), key).filter("lat IS NOT NULL AND lon IS NOT NULL")
    p = asked.select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), (F.col("lat") + shift).alias("_tlat"), shift.alias("_shift"))
    c = one_per_spot(cities.filter(
        (F.col("population") >= config.CONTRAST_POPULATION) & F.col("country").isin(*config.EUROPE) & F.col("served")
    ).select(order, "lat", "lon"), order)
    sizes = [tile / 4 ** k for k in range(3)]
    fine = sizes[-1]
    p = written(p.withColumns({"_pb": F.floor(F.col("_tlat") / fine), "_pc": F.floor(F.col("_plon") / fine)}))
    c = written(c.withColumns({"_cb": F.floor(F.col("lat") / fine), "_cc": F.floor(F.col("lon") / fine)}))
    near, far_off, kept = ["_pb", "_pc", "_shift"], ["_cb", "_cc"], None
    for size in sizes:
        up = round(size / fine)
        raised = lambda names, by=up: [F.floor(F.col(n) / by).alias(n) for n in names]
        own, theirs = p.select(*raised(near[:2]), "_shift").distinct(), c.select(*raised(far_off)).distinct()
        if kept is None:
            t = own.crossJoin(F.broadcast(theirs))
        else:
            wide = lambda names: {f"_u{n}": F.floor(F.col(n) / 4) for n in names}
            before = kept.withColumnsRenamed({n: f"_u{n}" for n in (*near[:2], *far_off)})
            t = own.withColumns(wide(near[:2])).join(before, ["_u_pb", "_u_pc", "_shift"])
            t = t.join(theirs.withColumns(wide(far_off)), ["_u_cb", "_u_cc"]).select(*near, *far_off)
        middle = {n: (F.col(n) + 0.5) * size for n in (*near[:2], *far_off)}
        # Half diagonals of the two tiles, both at most size/sqrt(2) degrees.
        slack = 2 * size * 0.7072 * config.EARTH_KM * 0.017453293
        t = t.withColumns({"_d": haversine_km(middle["_pb"], middle["_pc"], middle["_cb"], middle["_cc"]),
                           "_away": haversine_km(middle["_pb"] - F.col("_shift"), middle["_pc"], middle["_cb"], middle["_cc"])})
        t = written(t.filter(F.col("_away") + slack >= config.CONTRAST_AWAY_KM))
        sure = F.when(F.col("_away") - slack >= config.CONTRAST_AWAY_KM, F.col("_d") + slack)
        limit = t.groupBy(*near).agg(F.min(sure).alias("_limit"))
        kept = t.join(limit, near).filter(
            F.col("_limit").isNull() | (F.col("_d") - slack <= F.col("_limit"))).select(*near, *far_off)
    # Few rows a side, many pairs: dealt out by tile, whatever their bytes.
    pairs = p.join(kept, near).repartition(*near).join(c, far_off)
    pairs = pairs.filter(_km("_plat", "_plon", "lat", "lon") >= config.CONTRAST_AWAY_KM)
    far = _order(_km("_tlat", "_plon", "lat", "lon"))
    best = pairs.groupBy("_plat", "_plon").agg(F.min(F.struct(far.alias("d"), order)).alias("_b"))
    named = points.select(key, F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).join(best, ["_plat", "_plon"])
    named = named.groupBy(key).agg(F.min("_b").alias("_b")).select(key, F.col(f"_b.{order}").alias("contrast_id"))
    return points.select(key).join(named, key, "left")


def _cubes(df: DataFrame, edge: float) -> DataFrame:
    """``df`` with ``_x, _y, _z``: its cube of ``edge`` kilometres in a lattice round the whole globe."""
    lat, lon = F.radians("lat"), F.radians("lon")
    place = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    return df.withColumns({c: F.floor((1.0 + v) * config.EARTH_KM / edge).cast("int") for c, v in place.items()})


def _levels(edge: float) -> int:
    """Levels of cubes, each twice as wide as the one before, up to one that holds the globe."""
    return max(1, math.ceil(math.log2(2 * config.EARTH_KM / edge + 1)))


def _raised(df: DataFrame, levels: int) -> DataFrame:
    """Every row once per level, with its cube there."""
    up = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return up.withColumns({c: F.expr(f"shiftright({c}, level)") for c in _CUBE})


_CUBE = ("_x", "_y", "_z")


def stations_around(cells: DataFrame, stations: DataFrame, years: Sequence[int], km: float = 25.0) -> DataFrame:
    """Per cell and year: distance to the nearest active station, how many are within ``km``,
    and their mean altitude above the cell's. Every cell has every year; NULL only where no station is active at all.

    A pyramid of cubes, each level twice as wide, tells which cubes hold an active station in which year. The
    smallest cube round a cell that holds one bounds the distance, so the nearest lies in that cube or the two next to it
    on each side: one look-up, one meeting of rows. Cubes of cells and cubes of stations meet first, with the
    years both have; only then stations come in, and cells last. A year without stations meets nothing.
    """
    levels = _levels(km)
    asked = F.array(*[F.lit(int(y)) for y in years])
    sites = written(_cubes(stations.select("station_id", "lat", "lon", "elevation", "first_year", "last_year"), km).withColumn(
        "_years", F.filter(asked, lambda y: y.between(F.col("first_year"), F.col("last_year")))).filter(F.size("_years") > 0))
    spots = written(_cubes(cells.select("cell_id", "lat", "lon", "elevation"), km))
    at = ["level", *_CUBE]
    # which cubes are live in which years; narrow cubes are merged before they are raised
    narrow = sites.select(*_CUBE, F.explode("_years").alias("year")).distinct()
    live = _raised(narrow, levels).select(*at, "year").distinct()
    # the level each narrow cube of cells asks at: 0 in all years for the near ones, else that of the smallest live cube
    own = spots.select(*_CUBE).distinct().withColumns({f"_o{c}": F.col(c) for c in _CUBE})
    first = _raised(own, levels).join(live, at).groupBy(*[f"_o{c}" for c in _CUBE], "year").agg(F.min("level").alias("level"))
    far = first.filter("level > 0").groupBy(*[f"_o{c}" for c in _CUBE], "level").agg(F.collect_set("year").alias("_asked"))
    near = own.select(*[f"_o{c}" for c in _CUBE], F.lit(0).alias("level"), asked.alias("_asked"))
    wants = far.unionByName(near)
    # cubes of cells meet live cubes, then stations, then cells
    moves = F.explode(F.expr("flatten(flatten(transform(sequence(-2, 2), a -> transform(sequence(-2, 2), b -> transform(sequence(-2, 2), c -> struct(a, b, c))))))"))
    here = wants.select("level", *[F.expr(f"shiftright(_o{c}, level)").alias(f"_h{c}") for c in _CUBE], F.explode("_asked").alias("year")).distinct()
    here = here.groupBy("level", *[f"_h{c}" for c in _CUBE]).agg(F.collect_set("year").alias("_asked")).withColumn("_m", moves)
    here = here.select("level", *[f"_h{c}" for c in _CUBE], "_asked", *[(F.col(f"_h{c}") + F.col(f"_m.{d}")).alias(c) for c, d in zip(_CUBE, "abc")])
    holding = live.groupBy(*at).agg(F.collect_set("year").alias("_live"))
    tiles = here.join(holding, at).withColumn("_both", F.array_intersect("_asked", "_live")).filter(F.size("_both") > 0)
    placed = _raised(sites, levels).select(*at, F.col("lat").alias("_olat"), F.col("lon").alias("_olon"), F.col("elevation").alias("_oz"), "_years")
    met = tiles.join(placed, at).withColumn("_both", F.array_intersect("_both", "_years")).filter(F.size("_both") > 0)
    met = met.select("level", *[F.col(f"_h{c}").alias(c) for c in _CUBE], "_olat", "_olon", "_oz", "_both")
    cell = spots.withColumnsRenamed({c: f"_o{c}" for c in _CUBE}).join(wants, [f"_o{c}" for c in _CUBE])
    cell = cell.select("cell_id", "lat", "lon", "elevation", "level", "_asked", *[F.expr(f"shiftright(_o{c}, level)").alias(c) for c in _CUBE])
    pairs = cell.join(met, at).select("cell_id", "level", (F.col("_oz") - F.col("elevation")).alias("_gap"), _km("lat", "lon", "_olat", "_olon").alias("_km"),
                                      F.explode(F.array_intersect("_both", "_asked")).alias("year"))
    close = (F.col("level") == 0) & (F.col("_km") <= km)
    found = pairs.groupBy("cell_id", "year").agg(F.min("_km").alias("nearest_km"), F.count_if(close).alias("stations"), F.avg(F.when(close, F.col("_gap"))).alias("height_gap"))
    whole = cells.select("cell_id", F.explode(asked).alias("year"))
    return whole.join(found, ["cell_id", "year"], "left").fillna(0, ["stations"])


def best_altitude(cells: DataFrame, stations: DataFrame, key: str = "station_id") -> DataFrame:
    """Of the 3 x 3 cells around each station's own cell, the one nearest in altitude (scan order on a tie)."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    own = cells.select("cell_id", F.col("row").alias("_r"), F.col("col").alias("_c"))
    c = cells.select(F.col("cell_id").alias("near_id"), "row", "col", F.col("elevation").alias("cell_elevation"))
    asked = stations.join(own, "cell_id").select(key, "elevation", "_r", "_c", moves.alias("m"))
    met = asked.select(key, "elevation", (F.col("_r") + F.col("m.a")).alias("row"),
                       (F.col("_c") + F.col("m.b")).alias("col")).join(c, ["row", "col"])
    gap = F.abs(F.col("cell_elevation") - F.col("elevation"))
    return met.filter(gap.isNotNull()).groupBy(key).agg(
        F.min_by("near_id", F.struct(gap.alias("g"), "row", "col")).alias("near_id"), F.min(gap).alias("gap"))
