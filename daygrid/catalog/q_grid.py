"""Queries: places and cells, remapping, neighbours, regions."""

import math

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.operators import grid as G
from daygrid.operators import nearby as N
from daygrid.operators import polygon as P
from daygrid.operators import remap as M
from daygrid.session import written

COARSE, FINE = G.Grid(46.0, 5.0, 0.25), G.Grid(46.0, 5.0, 0.1)

LOCATED = """SELECT * FROM (SELECT p.*, c.cell_id, c.domain, ABS(c.lat - p.lat) AS dy, ABS(c.lon - p.lon) AS dx,
  ROW_NUMBER() OVER (PARTITION BY place_id ORDER BY ABS(c.lat - p.lat), "row", ABS(c.lon - p.lon), col) AS k
  FROM places AS p CROSS JOIN cells AS c) AS x WHERE k = 1 AND dy <= 0.125 AND dx <= 0.125 AND domain"""
BEST_FINE = """SELECT place_id, fine_id FROM (SELECT p.place_id, f.fine_id, ROW_NUMBER() OVER (PARTITION BY p.place_id ORDER BY
   FLOOR((POW(f.lat-p.lat, 2) + POW((f.lon-p.lon)*COS(RADIANS(p.lat)), 2))*1000000000 + 0.5), f.i, f.j) AS k
  FROM located AS p JOIN cells010 AS f ON ABS(f.lat-p.lat) <= 0.100001 AND ABS(f.lon-p.lon) <= 0.100001 WHERE f.domain) AS x WHERE k = 1"""
AT = """SELECT l.place_id, l.cell_id, b.fine_id, f.elevation AS fine_elevation, CASE WHEN f.eobs AND f.elevation IS NOT NULL AND l.elevation IS NOT NULL
   THEN LEAST(2500.0, GREATEST(-2500.0, f.elevation - l.elevation)) END AS lift, l.lat, l.lon, l.elevation, f.lat AS flat
  FROM located AS l LEFT JOIN best_fine AS b ON l.place_id = b.place_id LEFT JOIN cells010 AS f ON f.fine_id = b.fine_id"""
PLACE_PARTS = dict(located=LOCATED, best_fine=BEST_FINE, spots=AT)


def places_at(t):
    return G.place_cells(t.places, t.cells, t.cells010, COARSE, FINE)


@query("join1_locate_places", "place_id:i cell_id:i", "SELECT place_id, cell_id FROM located", located=LOCATED)
def _(t):
    return G.locate(t.places, t.cells, COARSE)


@query("filt2_covered_points", "place_id:i covered:b",
       "SELECT place_id, place_id IN (SELECT place_id FROM located) AS covered FROM places", located=LOCATED)
def _(t):
    return G.covered(t.places, t.cells, COARSE, "place_id")


@query("filt3_map_cells", "cell_id:i", "SELECT cell_id FROM cells WHERE land AND lat BETWEEN 45.2 AND 46.0 AND lon BETWEEN 5.2 AND 90.0")
def _(t):
    return G.map_cells(t.cells, 45.2, 46.0, 5.2, 90.0)


@query("join2_nearest_fine_cell", "place_id:i cell_id:i fine_id:f lift:3", "SELECT place_id, cell_id, fine_id, lift FROM spots", **PLACE_PARTS)
def _(t):
    return places_at(t)


RATES = {
    "tasmin": (2.4, 3.3, 4.1, 4.2, 4.2, 4.2, 4.0, 3.6, 3.6, 3.1, 3.0, 2.4),
    "tasmax": (3.9, 5.7, 7.5, 8.4, 8.4, 8.0, 7.8, 7.6, 7.2, 6.1, 4.7, 3.5),
}
RATES["tas"] = tuple(round((a + b) / 2, 2) for a, b in zip(RATES["tasmin"], RATES["tasmax"]))


def _lifted(n):
    rate = "CASE MONTH(c.day) " + " ".join(f"WHEN {m} THEN {r:.2f}" for m, r in enumerate(RATES[n], 1)) + " END"
    value = f"CASE WHEN fine_id IS NOT NULL THEN f_{n} ELSE c.{n} END"
    return f"CASE WHEN lift IS NULL OR lift = 0 THEN {value} ELSE ROUND_EVEN({value} + {rate}*lift/1000.0, 2) END AS {n}"


# Daily rows of the observed source at each place, on their two grids.
AT_PLACE = f"""SELECT place_id, c.cell_id, fine_id, lift, source, c.day, {_lifted('tasmax')}, {_lifted('tasmin')}, {_lifted('tas')},
  c.pr, c.clt, c.hurs, c.sfcWind, c.psl, c.rsds FROM (
  SELECT a.place_id, a.fine_id, a.lift, d.*, f.tasmax AS f_tasmax, f.tasmin AS f_tasmin, f.tas AS f_tas
  FROM spots AS a JOIN daily AS d ON d.cell_id = a.cell_id LEFT JOIN daily010 AS f ON f.fine_id = a.fine_id AND f.source = d.source AND f.day = d.day) AS c"""


@query("join3_4_values_at_places", "place_id:i source:s month:i tasmax:3 tasmin:3 tas:3 pr:3 days:i", """
 SELECT place_id, source, MONTH(day) AS month, AVG(tasmax) AS tasmax, AVG(tasmin) AS tasmin, AVG(tas) AS tas, AVG(pr) AS pr, COUNT(tas) AS days
 FROM at_place GROUP BY ALL""", **PLACE_PARTS, at_place=AT_PLACE)
def _(t):
    v = G.place_daily(written(places_at(t)), t.daily, t.daily010, size=256)  # summed as they come: no task holds them
    return v.groupBy("place_id", "source", F.month("day").alias("month")).agg(
        *[F.avg(n).alias(n) for n in ("tasmax", "tasmin", "tas", "pr")], F.count("tas").alias("days"))


@query("join14_capacity_default", "cell_id:i capacity:1", "SELECT cell_id, COALESCE(capacity, 100.0) AS capacity FROM cells")
def _(t):
    return G.capacity(t.cells)


# Both sides of a cell and day in one pass.
PAIRED = """SELECT cell_id, day, MAX(CASE WHEN source = 'obs' THEN 1 ELSE 0 END) AS has_obs, MAX(CASE WHEN source = 'sim' THEN 1 ELSE 0 END) AS has_sim,
 MAX(CASE WHEN source = 'obs' THEN tas END) AS o, MAX(CASE WHEN source = 'sim' THEN tas END) AS s FROM daily GROUP BY cell_id, day"""


@query("filt6_mask_like", "cell_id:i day:d tas:2", "SELECT cell_id, day, CASE WHEN has_sim = 0 OR s IS NOT NULL THEN o END AS tas FROM paired WHERE has_obs = 1", paired=PAIRED)
def _(t):
    return G.mask_like(t.obs, t.sim, "tas")


@query("join17_align_by_date", "cell_id:i day:d a:2 b:2", "SELECT cell_id, day, o AS a, s AS b FROM paired WHERE has_obs = 1", paired=PAIRED)
def _(t):
    return G.align_by_date(t.obs, t.sim, "tas", ["cell_id", "day"])


@query("join18_coarsen_blocks", "source:s day:d block_row:i block_col:i psl:3", """
 SELECT source, day, "row"//2 AS block_row, col//2 AS block_col, CASE WHEN COUNT(psl) = 4 THEN AVG(psl) END AS psl
 FROM daily JOIN cells USING (cell_id) GROUP BY ALL HAVING COUNT(*) = 4""")
def _(t):
    return G.coarsen(t.daily, t.cells, "psl", rows=t.daily_rows)


@query("join19_neighbours", "source:s lag:i way:s pairs:i mean_product:3", """
 SELECT source, lag, way, COUNT(*) AS pairs, AVG(a.tas*b.tas) AS mean_product FROM (
  SELECT c.cell_id, k AS lag, 'east' AS way, e.cell_id AS other FROM cells AS c CROSS JOIN (VALUES (1), (2), (4), (8)) AS l(k)
   JOIN cells AS e ON e."row" = c."row" AND e.col = c.col + k UNION ALL
  SELECT c.cell_id, k, 'south', e.cell_id FROM cells AS c CROSS JOIN (VALUES (1), (2), (4), (8)) AS l(k)
   JOIN cells AS e ON e."row" = c."row" + k AND e.col = c.col) AS p
 JOIN daily AS a ON a.cell_id = p.cell_id JOIN daily AS b USING (source, day) WHERE b.cell_id = p.other GROUP BY source, lag, way""")
def _(t):
    n = G.neighbours(t.daily, t.cells, "tas")
    return n.groupBy("source", "lag", "way").agg(
        F.count("*").alias("pairs"), F.avg(F.col("value") * F.col("other")).alias("mean_product"))


@query("map9_bounding_index", "cell_id:i pixel:i rows:i cols:i north_edge:3 west_edge:3", """
 SELECT cell_id, ("row" - a)*(d - c + 1) + col - c AS pixel, b - a + 1 AS rows, d - c + 1 AS cols,
  46.0 - a*0.25 + 0.125 AS north_edge, 5.0 + c*0.25 - 0.125 AS west_edge
 FROM (SELECT * FROM cells WHERE land) AS k CROSS JOIN (SELECT MIN("row") AS a, MAX("row") AS b, MIN(col) AS c, MAX(col) AS d FROM cells WHERE land) AS x""")
def _(t):
    return G.bounding_index(t.cells.filter("land"), COARSE)


# Towns spread over Europe, one country code out of three outside the list.
CITIES = """SELECT c_custkey AS place_id, c_name AS name, 36.0 + ((c_custkey*7919)%2800)/100.0 AS lat, -9.0 + ((c_custkey*104729)%4000)/100.0 AS lon,
  CASE c_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'TR' ELSE 'DE' END AS country, CAST(ROUND((c_acctbal+1000)*100) AS BIGINT) AS population,
  c_custkey % 11 <> 0 AS served FROM customer"""
KM = "2*6371.0*ASIN(SQRT(LEAST(1.0, POW(SIN((RADIANS({c})-RADIANS({a}))/2), 2) + COS(RADIANS({a}))*COS(RADIANS({c}))*POW(SIN((RADIANS({d})-RADIANS({b}))/2), 2))))"


def cities(t):
    return t.raw("customer").selectExpr(
        "c_custkey AS place_id", "c_name AS name", "36D + ((c_custkey*7919)%2800)/100D AS lat",
        "-9D + ((c_custkey*104729)%4000)/100D AS lon",
        "CASE c_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'TR' ELSE 'DE' END AS country",
        "CAST(ROUND((c_acctbal+1000)*100) AS BIGINT) AS population", "c_custkey % 11 <> 0 AS served")


POINTS = """SELECT o_orderkey AS point_id, 36.0 + ((o_orderkey*6151)%2800)/100.0 AS lat, -9.0 + ((o_orderkey*12289)%4000)/100.0 AS lon FROM orders"""


def points(t):
    return t.raw("orders").selectExpr(
        "o_orderkey AS point_id", "36D + ((o_orderkey*6151)%2800)/100D AS lat", "-9D + ((o_orderkey*12289)%4000)/100D AS lon")


@query("join9_nearest_town", "point_id:i place_id:f distance_km:1", """
 SELECT p.point_id, n.place_id, n.distance_km FROM points AS p LEFT JOIN (
  SELECT point_id, place_id, ROUND_EVEN(km, 1) AS distance_km FROM (SELECT point_id, place_id, km,
    ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY FLOOR(km*10000000 + 0.5), place_id) AS k FROM (
    SELECT p.point_id, c.place_id, """ + KM.format(a="p.lat", b="p.lon", c="c.lat", d="c.lon") + """ AS km FROM points AS p JOIN cities AS c
    ON ABS(c.lat - p.lat) <= 0.5) AS x WHERE km <= 50) AS y WHERE k = 1) AS n ON n.point_id = p.point_id""", points=POINTS, cities=CITIES)
def _(t):
    return N.nearest_place(points(t), cities(t), "point_id")


@query("join10_contrast_city", "point_id:i contrast_id:f", """
 SELECT p.point_id, contrast_id FROM asked AS p LEFT JOIN (SELECT point_id, place_id AS contrast_id FROM (SELECT point_id, place_id,
   ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY FLOOR(far*10000000 + 0.5), place_id) AS k FROM (
   SELECT p.point_id, c.place_id, """ + KM.format(a="p.tlat", b="p.lon", c="c.lat", d="c.lon") + """ AS far, """
       + KM.format(a="p.lat", b="p.lon", c="c.lat", d="c.lon") + """ AS km
   FROM (SELECT *, lat + CASE WHEN lat < 44 THEN 7.2 ELSE -7.2 END AS tlat FROM asked) AS p
   CROSS JOIN (SELECT * FROM cities WHERE population >= 500000 AND country <> 'TR' AND served) AS c) AS x WHERE km >= 300) AS y WHERE k = 1) AS n
  ON n.point_id = p.point_id""", cities=CITIES, asked="SELECT place_id AS point_id, lat, lon FROM cities")
def _(t):
    asked = cities(t).select(F.col("place_id").alias("point_id"), "lat", "lon")
    return N.contrast_city(asked, cities(t), "point_id")


@query("join12_cells_in_region", "cell_id:i region:i", """
 SELECT cell_id, region FROM cells JOIN ring_edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat-y1)/(y2-y1)*(x2-x1)
 GROUP BY cell_id, region HAVING COUNT(*) % 2 = 1""")
def _(t):
    return P.in_region(t.cells, t.ring_edges)


# Stations of some years lie far away: three degrees off the grid, and across the 180th meridian.
FAR_STATIONS = """SELECT station_id, first_year, last_year, elevation, CASE WHEN station_id % 4 = 1 THEN lat - 3.0 ELSE lat END AS lat,
  CASE WHEN station_id % 4 = 3 THEN -lon ELSE lon END AS lon FROM stations"""


def far_stations(t):
    return t.stations.withColumns({"lat": F.expr("if(station_id % 4 = 1, lat - 3.0D, lat)"), "lon": F.expr("if(station_id % 4 = 3, -lon, lon)")})


@query("join15_stations_around", "cell_id:i year:i nearest_km:3 stations:i height_gap:3", """
 SELECT w.cell_id, w.year, nearest_km, COALESCE(stations, 0) AS stations, height_gap FROM (
  SELECT cell_id, y AS year FROM cells CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1994, 2002)) AS y) AS years) AS w LEFT JOIN (
 SELECT cell_id, y AS year, MIN(km) AS nearest_km, COUNT(CASE WHEN km <= 25 THEN 1 END) AS stations, AVG(CASE WHEN km <= 25 THEN se - ce END) AS height_gap
 FROM (SELECT c.cell_id, c.elevation AS ce, s.elevation AS se, first_year, last_year, """
       + KM.format(a="c.lat", b="c.lon", c="s.lat", d="s.lon") + """ AS km FROM cells AS c CROSS JOIN far AS s) AS p
 CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1994, 2002)) AS y) AS years WHERE y BETWEEN first_year AND last_year GROUP BY 1, 2) AS n
 ON n.cell_id = w.cell_id AND n.year = w.year""", far=FAR_STATIONS)
def _(t):
    return N.stations_around(t.cells, far_stations(t), range(1994, 2003))


# Every seventh station is far from any valid cell.
@query("join16_station_cell", "station_id:i fine_id:f", """
 SELECT station_id, fine_id FROM (SELECT s.station_id, f.fine_id, ROW_NUMBER() OVER (
   PARTITION BY s.station_id ORDER BY FLOOR((POW(f.lat-s.lat, 2) + POW((f.lon-s.lon)*COS(RADIANS(s.lat)), 2))*1000000000 + 0.5), f.i, f.j) AS k
  FROM away AS s CROSS JOIN cells010 AS f WHERE f.domain) AS x WHERE k = 1""",
       away="SELECT station_id, CASE WHEN station_id % 7 = 0 THEN lat + 1.5 ELSE lat END AS lat, CASE WHEN station_id % 7 = 1 THEN lon - 4.0 ELSE lon END AS lon FROM stations")
def _(t):
    away = t.stations.withColumns({"lat": F.expr("if(station_id % 7 = 0, lat + 1.5D, lat)"), "lon": F.expr("if(station_id % 7 = 1, lon - 4.0D, lon)")})
    return G.nearest_fine(away, t.cells010, FINE, "station_id")


@query("val23_best_altitude", "station_id:i near_id:i gap:1", """
 SELECT station_id, near_id, gap FROM (SELECT s.station_id, c.cell_id AS near_id, ABS(c.elevation - s.elevation) AS gap,
  ROW_NUMBER() OVER (PARTITION BY s.station_id ORDER BY ABS(c.elevation - s.elevation), c."row", c.col) AS k
  FROM stations AS s JOIN cells AS o ON o.cell_id = s.cell_id JOIN cells AS c ON ABS(c."row" - o."row") <= 1 AND ABS(c.col - o.col) <= 1
  WHERE c.elevation IS NOT NULL) AS x WHERE k = 1""")
def _(t):
    return N.best_altitude(t.cells, t.stations)


# --- remapping -------------------------------------------------------------------

# Source cells at the rotated position of the sample cells, one step of 0.3 degrees apart.
ROTATED = """SELECT cell_id AS cell_from, -4.9 - 0.3*"row" AS rlat, -9.0 + 0.3*col AS rlon FROM cells"""
POLE = (39.25, -162.0)


def rotated(t):
    return t.cells.select(F.col("cell_id").alias("cell_from"), (-4.9 - 0.3 * F.col("row")).alias("rlat"),
                          (-9.0 + 0.3 * F.col("col")).alias("rlon"))


W_SUB = """SELECT cell_from, COS(RADIANS(slat))*POW(RADIANS(0.3/20), 2) AS area,
  CAST(ROUND_EVEN((46.0 - DEGREES(ASIN(SIN(a)*vx + COS(a)*vz)))/0.25, 0) AS BIGINT) AS "row",
  CAST(ROUND_EVEN((DEGREES(ATAN2(-(COS(a)*vx - SIN(a)*vz)*SIN(b) - vy*COS(b), -(COS(a)*vx - SIN(a)*vz)*COS(b) + vy*SIN(b))) - 5.0)/0.25, 0) AS BIGINT) AS col
 FROM (SELECT *, COS(RADIANS(slat))*COS(RADIANS(slon)) AS vx, COS(RADIANS(slat))*SIN(RADIANS(slon)) AS vy, SIN(RADIANS(slat)) AS vz,
   RADIANS(90-39.25) AS a, RADIANS(-162.0) AS b FROM (
  SELECT cell_from, rlat + ((i + 0.5)/20 - 0.5)*0.3 AS slat, rlon + ((j + 0.5)/20 - 0.5)*0.3 AS slon FROM rotated
   CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS i) AS x CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS j) AS y) AS s) AS v"""
W_PAIR = """SELECT c.cell_id AS cell_to, s.cell_from, SUM(area) AS area, MAX(c.lat) AS lat FROM sub AS s JOIN cells AS c USING ("row", col) GROUP BY 1, 2"""
W_ALL = """SELECT cell_to, cell_from, area/total AS w FROM (SELECT *, SUM(area) OVER (PARTITION BY cell_to) AS total FROM pair) AS p
 WHERE total/((SIN(RADIANS(lat+0.125))-SIN(RADIANS(lat-0.125)))*RADIANS(0.25)) >= 0.9"""


@query("join5_overlap_weights", "cell_to:i cell_from:i w:6", "SELECT * FROM weights", rotated=ROTATED, sub=W_SUB, pair=W_PAIR, weights=W_ALL)
def _(t):
    target = t.cells.select(F.col("cell_id").alias("cell_to"), "row", "col", "lat")
    return M.overlap_weights(rotated(t), target, COARSE, 0.3, POLE)


@query("join6_remap", "source:s cell_id:i day:d tas:3 pr:3", """
 SELECT source, cell_to AS cell_id, day, CASE WHEN SUM(CASE WHEN tas IS NOT NULL THEN w END) >= 0.9 - 0.000000001 THEN SUM(w*tas)/SUM(CASE WHEN tas IS NOT NULL THEN w END) END AS tas,
  CASE WHEN SUM(CASE WHEN pr IS NOT NULL THEN w END) >= 0.9 - 0.000000001 THEN SUM(w*pr)/SUM(CASE WHEN pr IS NOT NULL THEN w END) END AS pr
 FROM daily JOIN weights ON cell_id = cell_from GROUP BY 1, 2, 3""", headline=True, rotated=ROTATED, sub=W_SUB, pair=W_PAIR, weights=W_ALL)
def _(t):
    target = t.cells.select(F.col("cell_id").alias("cell_to"), "row", "col", "lat")
    return M.remap(t.daily, M.overlap_weights(rotated(t), target, COARSE, 0.3, POLE), ["tas", "pr"])


BILINEAR_W = """SELECT fine_id AS cell_to, c.cell_id AS cell_from, (1-ABS(y - c."row"))*(1-ABS(x - c.col)) AS w
 FROM (SELECT fine_id, (46.0-lat)/0.25 AS y, (lon-5.0)/0.25 AS x FROM cells010) AS f
 JOIN cells AS c ON c."row" IN (CAST(FLOOR(y) AS BIGINT), CAST(FLOOR(y) AS BIGINT)+1) AND c.col IN (CAST(FLOOR(x) AS BIGINT), CAST(FLOOR(x) AS BIGINT)+1)
 WHERE (1-ABS(y - c."row"))*(1-ABS(x - c.col)) > 0"""


@query("join7_bilinear", "source:s cell_id:i month:i tas:3 days:i", """
 SELECT source, cell_to AS cell_id, MONTH(day) AS month, AVG(tas) AS tas, COUNT(tas) AS days FROM (
  SELECT source, cell_to, day, SUM(w*tas)/SUM(CASE WHEN tas IS NOT NULL THEN w END) AS tas FROM obs JOIN weights ON cell_id = cell_from GROUP BY 1, 2, 3) AS d
 GROUP BY 1, 2, 3""", weights=BILINEAR_W)
def _(t):
    target = t.cells010.select(F.col("fine_id").alias("cell_to"), "lat", "lon")
    d = M.bilinear(t.obs, M.bilinear_weights(target, t.cells, COARSE), ["tas"])
    return d.groupBy("source", "cell_id", F.month("day").alias("month")).agg(F.avg("tas").alias("tas"), F.count("tas").alias("days"))


def _mean4(k):
    return f"""SELECT source, cell_to, CASE WHEN COUNT(tas) >= {k} THEN AVG(tas) END AS tas, COUNT(tas) AS n, day FROM obs JOIN four ON cell_id = cell_from GROUP BY source, cell_to, day"""


@query("join8_mean_of_four", "min_valid:i cell_to:i days:i tas:3", """
 SELECT 4 AS min_valid, cell_to, COUNT(tas) AS days, AVG(tas) AS tas FROM m4 GROUP BY cell_to UNION ALL
 SELECT 3, cell_to, COUNT(tas), AVG(tas) FROM m3 GROUP BY cell_to UNION ALL SELECT 1, cell_to, COUNT(tas), AVG(tas) FROM m1 GROUP BY cell_to""",
       four="""SELECT station_id AS cell_to, c.cell_id AS cell_from FROM stations AS s JOIN cells AS c
 ON c."row" IN (CAST(FLOOR((46.0-s.lat)/0.25) AS BIGINT), CAST(FLOOR((46.0-s.lat)/0.25) AS BIGINT)+1)
 AND c.col IN (CAST(FLOOR((s.lon-5.0)/0.25) AS BIGINT), CAST(FLOOR((s.lon-5.0)/0.25) AS BIGINT)+1)""",
       m4=_mean4(4), m3=_mean4(3), m1=_mean4(1))
def _(t):
    four = M.four_neighbours(t.stations.select(F.col("station_id").alias("cell_to"), "lat", "lon"), t.cells, COARSE)
    m = M.means_of_four(t.obs, four, "tas").select("cell_to", F.explode(F.array(*[
        F.struct(F.lit(k).alias("min_valid"), F.col(f"tas_{k}").alias("tas")) for k in (4, 3, 1)])).alias("m"))
    return m.groupBy("m.min_valid", "cell_to").agg(F.count("m.tas").alias("days"), F.avg("m.tas").alias("tas"))


# The European equal-area projection of the GRS80 ellipsoid, inverted in closed and series form; constants worked out here.
E = math.sqrt(2/298.257222101 - 298.257222101**-2)
QP, Q0 = ((1 - E*E)*(p/(1 - E*E*p*p) - math.log((1 - E*p)/(1 + E*p))/(2*E)) for p in (1.0, math.sin(math.radians(52))))
RQ, B0 = 6378137.0*math.sqrt(QP/2), math.asin(Q0/QP)
DD = 6378137.0*math.cos(math.radians(52))/math.sqrt(1 - (E*math.sin(math.radians(52)))**2)/(RQ*math.cos(B0))
RASTER = f"""SELECT CAST(p_retailprice AS DOUBLE) - 97*FLOOR(CAST(p_retailprice AS DOUBLE)/97) - 20 AS water, p_size - 5 AS depth,
  (3930000 + 2000*(p_partkey//40) - 4321000)/{DD!r} AS dx, (2440000 + 3000*(p_partkey % 40) - 3210000)*{DD!r} AS dy FROM part"""
UNPROJECTED = f"""SELECT *, DEGREES(ASIN(sb)) AS beta FROM (SELECT *, COS(c)*{math.sin(B0)!r} + dy*SIN(c)*{math.cos(B0)!r}/rho AS sb FROM (
  SELECT *, 2*ASIN(rho/{2*RQ!r}) AS c FROM (SELECT *, SQRT(dx*dx + dy*dy) AS rho FROM raster) AS a) AS b) AS d"""
PIXELS = f"""SELECT water, depth, CAST(ROUND_EVEN((46.0 - lat)/0.25, 0) AS BIGINT) AS "row", CAST(ROUND_EVEN((lon - 5.0)/0.25, 0) AS BIGINT) AS col FROM (
 SELECT *, beta + DEGREES({E**2/3 + 31*E**4/180 + 517*E**6/5040!r}*SIN(2*RADIANS(beta)) + {23*E**4/360 + 251*E**6/3780!r}*SIN(4*RADIANS(beta))
   + {761*E**6/45360!r}*SIN(6*RADIANS(beta))) AS lat,
  10.0 + DEGREES(ATAN2(dx*SIN(c), rho*{math.cos(B0)!r}*COS(c) - dy*{math.sin(B0)!r}*SIN(c))) AS lon FROM unprojected) AS g"""


# A raster of one pixel to each part, about 1 km apart, in the European projection.
@query("join13_zonal_mean", "cell_id:i pixels:i mask_pixels:i mask_share:4 water:4 depth:4", """
 SELECT cell_id, COUNT(*) AS pixels, COUNT(CASE WHEN water > 0 THEN 1 END) AS mask_pixels, COUNT(CASE WHEN water > 0 THEN 1 END)/COUNT(*) AS mask_share,
  AVG(CASE WHEN water > 0 THEN water END) AS water, AVG(CASE WHEN water > 0 THEN depth END) AS depth FROM pixels JOIN cells USING ("row", col) GROUP BY cell_id""",
       raster=RASTER, unprojected=UNPROJECTED, pixels=PIXELS)
def _(t):
    raster = t.raw("part").selectExpr(
        "p_partkey", "3930000D + 2000D*(p_partkey div 40) AS x", "2440000D + 3000D*(p_partkey % 40) AS y",
        "p_retailprice % 97 - 20D AS water", "p_size - 5D AS depth")
    return M.zonal(raster, t.cells, COARSE, ["water", "depth"], F.col("x"), F.col("y"), "water")
