"""Queries: classified days of every search, and what a page derives from them."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.catalog.q_functions import WET_BULB_SQL
from daygrid.catalog.q_grid import AT_PLACE, COARSE, FINE, PLACE_PARTS
from daygrid.catalog.q_sources import VALIDATED
from daygrid.catalog.q_snow_soil import IN_WINTER, SOIL_PARTS, sites, stock_sql
from daygrid.config import MEASURES, TEMPERATURES
from daygrid.functions.calendar import snow_year
from daygrid.operators import grid as G
from daygrid.operators import records as R
from daygrid.operators import runs
from daygrid.plans import days as D
from daygrid.session import written
from daygrid.sources import export, provenance

BASELINE = (1996, 2001)


def located(t):
    """Places with their cells and spots; written, because a page reads it for its status, days, flags and normals."""
    return written(G.with_spots(G.place_cells(t.places, t.cells, t.cells010, COARSE, FINE)))


def accepted(t, at):
    checked = R.with_domain_status(R.validate(t.searches, t.periods), at, "place_id")
    return checked.filter("status = 'ok'")


def reading(t, at):
    """The distinct reading spots with their shares, and the capacity of their soil; written, because every step reads them."""
    return written(G.shares(G.spots(at).join(sites(t).select("cell_id", "capacity"), "cell_id"), "spot_id", G.SHARE))


def spot_daily(t, spots, keep, parts=None):
    return G.place_daily(spots, t.stored, t.fine_of(t.stored), "spot_id", keep, parts=parts)


def first_days(t):
    """The sources hold their days from the start of the sample."""
    return t.spark.sql("SELECT * FROM VALUES ('obs', DATE '1995-01-01'), ('sim', DATE '1995-01-01') AS f(source, first_day)")


def snow_flags(t, spots, asked=None, parts=None):
    """Flags of every winter, or only of those the searches touch (a stock never outlives its snow year), in the parts they meet in."""
    if asked is None:
        days = spot_daily(t, spots, ["read_elevation"])
    else:
        wanted = written(spots.join(D.searched_winters(asked, BASELINE, "sim", "spot_id"), "spot_id"))
        days = spot_daily(t, wanted, ["read_elevation", "winters"], parts)
        days = days.filter(F.array_contains("winters", snow_year("day"))).drop("winters")
    return D.snow_at_places(days, first_days(t), BASELINE, "sim", "spot_id")


def page_days(t):
    at = located(t)
    spots = reading(t, at)
    asked, parts = written(D.at_spots(accepted(t, at), at, spots)), G.parts_for(spots, G.SHARE)
    return D.days_of_spots(asked, snow_flags(t, spots, asked, parts), parts, "sim")


STATUS = f"""SELECT v.* REPLACE (CASE WHEN v.status = 'ok' AND l.place_id IS NULL THEN 'OutsideDomain' ELSE v.status END AS status)
 FROM ({VALIDATED}) AS v LEFT JOIN located AS l ON l.place_id = v.place_id"""
SPOT_ROWS = """SELECT *, MIN(place_id) OVER (PARTITION BY cell_id, COALESCE(fine_id, -1), COALESCE(lift, 1000000000)) AS spot_id FROM spots"""
ONE_SPOT = """SELECT spot_id, ANY_VALUE(cell_id) AS cell_id, ANY_VALUE(fine_id) AS fine_id, ANY_VALUE(lift) AS lift, ANY_VALUE(read_elevation) AS read_elevation
 FROM (SELECT s.*, CASE WHEN s.fine_id IS NOT NULL THEN s.fine_elevation ELSE c.elevation END AS read_elevation FROM spot_rows AS s JOIN cells AS c ON c.cell_id = s.cell_id) AS x GROUP BY spot_id"""
AT_SPOT = AT_PLACE.replace("a.place_id", "a.spot_id").replace("SELECT place_id", "SELECT spot_id").replace("FROM spots AS a", "FROM one_spot AS a")
SEARCHED = """SELECT search_id, s.place_id, spot_id, s.source, UNNEST(GENERATE_SERIES(s.first_day, s.last_day, INTERVAL 1 DAY)) AS d
 FROM status AS s JOIN spot_rows AS r ON r.place_id = s.place_id WHERE status = 'ok'"""
PAGE = """SELECT w.search_id, w.place_id, w.source, w.day, w.snow_year, x.tasmax, x.tasmin, x.tas, x.pr, x.clt, x.hurs, x.sfcWind, x.wb,
  CASE WHEN NOT counted OR (w.source = 'sim' AND COALESCE(rare, TRUE)) OR x.day < DATE '1995-08-01' THEN NULL ELSE stock >= 2.0 - 0.000000001 END AS snow
 FROM (SELECT search_id, place_id, spot_id, source, CAST(d AS DATE) AS day, 0 AS snow_year FROM searched) AS w
 JOIN (SELECT s.*, wb FROM stocks AS s JOIN wet AS b ON b.spot_id = s.spot_id AND b.source = s.source AND b.day = s.day) AS x ON x.spot_id = w.spot_id AND x.source = w.source AND x.day = w.day
 JOIN (SELECT spot_id, lift IS NOT NULL OR COALESCE(read_elevation <= 800, FALSE) AS counted FROM one_spot) AS g ON g.spot_id = w.spot_id
 LEFT JOIN (SELECT spot_id, AVG(n) < 3 AS rare FROM (SELECT spot_id, snow_year, SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS n FROM stocks
   WHERE source = 'sim' AND """ + IN_WINTER + """ GROUP BY 1, 2) AS n WHERE snow_year BETWEEN 1996 AND 2001 GROUP BY 1) AS r ON r.spot_id = w.spot_id"""
PAGE_PARTS = dict(**PLACE_PARTS, status=STATUS, spot_rows=SPOT_ROWS, one_spot=ONE_SPOT, at_spot=AT_SPOT, **stock_sql("at_spot", "source, spot_id"),
                  wet=WET_BULB_SQL.replace("FROM daily", "FROM at_spot").replace("cell_id,", "spot_id,"), searched=SEARCHED, page=PAGE)


@query("api4_search_status", "search_id:i status:s", "SELECT search_id, status FROM status", **PLACE_PARTS, status=STATUS)
def _(t):
    return R.with_domain_status(R.validate(t.searches, t.periods), located(t), "place_id")


@query("day1_classified_days",
       "search_id:i source:s date:d origin:s temperature_max:f temperature_min:f precipitation:f wind_speed_mean:f wet_bulb_mean:1 "
       "humid_heat:f sky:s band_max:f snow_on_ground:s", """
 SELECT search_id, source, day AS date, CASE WHEN source = 'sim' THEN 'simulated' ELSE 'observed' END AS origin, ROUND_EVEN(tasmax, 1) AS temperature_max,
  ROUND_EVEN(tasmin, 1) AS temperature_min, ROUND_EVEN(pr, 1) AS precipitation, ROUND_EVEN(sfcWind*3.6, 1) AS wind_speed_mean, ROUND_EVEN(wb, 1) AS wet_bulb_mean,
  CASE WHEN wb >= 30 THEN 2 WHEN wb >= 26 THEN 1 WHEN wb IS NOT NULL THEN 0 END AS humid_heat,
  CASE WHEN pr >= 1 THEN CASE WHEN tas < 1.5 THEN 'snow' WHEN tas IS NOT NULL THEN 'rain' END WHEN pr IS NULL OR clt IS NULL THEN NULL WHEN clt >= 70 THEN 'overcast'
   WHEN clt >= 30 THEN 'cloudy' ELSE 'clear' END AS sky, CASE WHEN tasmax IS NOT NULL THEN LEAST(GREATEST(FLOOR(tasmax/5)+1, 0), 9) END AS band_max,
  snow AS snow_on_ground FROM page""", headline=True, **PAGE_PARTS)
def _(t):
    return page_days(t)


@query("day2_range_summary", "search_id:i humid_heat_peak:i has_simulated:b first_day:d last_day:d days:i", """
 SELECT search_id, COALESCE(MAX(CASE WHEN wb >= 30 THEN 2 WHEN wb >= 26 THEN 1 WHEN wb IS NOT NULL THEN 0 END), 0) AS humid_heat_peak,
  BOOL_OR(source = 'sim') AS has_simulated, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS days FROM page GROUP BY search_id""", **PAGE_PARTS)
def _(t):
    at = located(t)
    return D.range_summary(D.classified_days(accepted(t, at), at, t.daily, t.daily010, "sim"))


@query("day3_snow_cover", "search_id:i days:i longest:f first_day:d last_day:d", """
 SELECT k.search_id, COALESCE(n, 0) AS days, len AS longest, a AS first_day, b AS last_day FROM (SELECT DISTINCT search_id FROM page WHERE snow IS NOT NULL) AS k
 LEFT JOIN (SELECT search_id, SUM(len) OVER (PARTITION BY search_id) AS n, len, a, b, ROW_NUMBER() OVER (PARTITION BY search_id ORDER BY len DESC, a) AS r FROM (
   SELECT search_id, COUNT(*) AS len, MIN(day) AS a, MAX(day) AS b FROM (SELECT search_id, day, CAST(day - CAST(ROW_NUMBER() OVER (PARTITION BY search_id ORDER BY day) AS INTEGER) AS DATE) AS g
    FROM page WHERE snow) AS i GROUP BY search_id, g) AS j) AS m ON m.search_id = k.search_id AND m.r = 1""", **PAGE_PARTS)
def _(t):
    return D.snow_cover(page_days(t))


@query("day5_running_rain", "source:s cell_id:i date:d total:1 stretch:f", """
 SELECT source, cell_id, day AS date, CASE WHEN pr IS NOT NULL THEN SUM(pr) OVER w END AS total, CASE WHEN pr IS NOT NULL THEN SUM(o) OVER w END AS stretch FROM (
  SELECT *, CASE WHEN pr IS NOT NULL AND LAG(pr) OVER (PARTITION BY source, cell_id, YEAR(day) ORDER BY day) IS NULL THEN 1 ELSE 0 END AS o FROM daily) AS d
 WINDOW w AS (PARTITION BY source, cell_id, YEAR(day) ORDER BY day)""")
def _(t):
    d = t.daily.select("source", "cell_id", F.year("day").alias("year"), F.col("day").alias("date"), F.col("pr").alias("precipitation"))
    return D.running_rain(d, ("source", "cell_id", "year"))


@query("day6_known_stretches", "source:s cell_id:i first_day:d last_day:d length:i", """
 SELECT source, cell_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS length FROM (
  SELECT source, cell_id, day, DATE_DIFF('day', DATE '1900-01-01', day) - ROW_NUMBER() OVER (PARTITION BY source, cell_id ORDER BY day) AS g FROM daily WHERE tas IS NOT NULL) AS x
 GROUP BY source, cell_id, g""")
def _(t):
    return runs.runs(t.daily, F.col("tas").isNotNull())


@query("day7_seam", "cell_id:i seam:d", """
 SELECT cell_id, MIN(day) AS seam FROM (SELECT cell_id, day, source, COUNT(CASE WHEN source = 'obs' THEN 1 END) OVER (PARTITION BY cell_id ORDER BY day, source
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM served) AS s WHERE source = 'sim' AND b > 0 GROUP BY cell_id""")
def _(t):
    d = t.served.selectExpr("cell_id", "day AS date", "if(source = 'sim', 'simulated', 'observed') AS origin")
    return D.seam(d, ("cell_id",))


@query("day8_axes", "source:s cell_id:i year:i bottom:1 top:1 rain_top:1", """
 SELECT source, cell_id, YEAR(day) AS year, FLOOR(LEAST(MIN(tasmin), MIN(tasmax))/5)*5 - 2.5 AS bottom, CEIL(GREATEST(MAX(tasmin), MAX(tasmax))/5)*5 + 2.5 AS top,
  GREATEST(10.0, MAX(pr)) AS rain_top FROM daily GROUP BY 1, 2, 3""")
def _(t):
    d = t.daily.select("source", "cell_id", F.year("day").alias("year"), F.col("tasmax").alias("temperature_max"),
                       F.col("tasmin").alias("temperature_min"), F.col("pr").alias("precipitation"))
    return D.axes(d, ("source", "cell_id", "year"))


@query("snow2_flags_at_places", "spot_id:i source:s winter:i known:i snow_days:i", f"""
 SELECT s.spot_id, s.source, s.snow_year AS winter, SUM(CASE WHEN shown THEN 1 ELSE 0 END) AS known, SUM(CASE WHEN shown AND stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS snow_days FROM (
  SELECT s.*, counted AND NOT (source = 'sim' AND COALESCE(rare, TRUE)) AND day >= DATE '1995-08-01' AS shown FROM stocks AS s
  JOIN (SELECT spot_id, lift IS NOT NULL OR COALESCE(read_elevation <= 800, FALSE) AS counted FROM one_spot) AS g ON g.spot_id = s.spot_id
  LEFT JOIN (SELECT spot_id, AVG(n) < 3 AS rare FROM (SELECT spot_id, snow_year, SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS n FROM stocks
   WHERE source = 'sim' AND {IN_WINTER} GROUP BY 1, 2) AS n WHERE snow_year BETWEEN 1996 AND 2001 GROUP BY 1) AS r ON r.spot_id = s.spot_id) AS s WHERE {IN_WINTER} GROUP BY 1, 2, 3""",
       **{k: v for k, v in PAGE_PARTS.items() if k not in ("status", "wet", "searched", "page")})
def _(t):
    f = snow_flags(t, reading(t, located(t))).filter(F.month("day").isin(11, 12, 1, 2, 3, 4))
    return f.groupBy("spot_id", "source", F.col("snow_year").alias("winter")).agg(
        F.count("snow_on_ground").alias("known"), F.count_if("snow_on_ground").alias("snow_days"))


SPOT_SITES = """SELECT spot_id, CASE WHEN fine_id IS NOT NULL THEN (SELECT lat FROM cells010 AS f WHERE f.fine_id = o.fine_id) ELSE c.lat END AS lat,
  COALESCE(read_elevation, 0) - COALESCE(lift, 0) AS elevation, c.capacity FROM one_spot AS o JOIN cells AS c ON c.cell_id = o.cell_id"""


def _at_spots(parts):
    """The soil's texts on spots in place of cells."""
    return {k: v.replace("cell_id", "spot_id").replace("cells", "spot_sites").replace("FROM daily", "FROM at_spot") for k, v in parts.items()}


@query("soil3_water_at_places", "spot_id:i source:s year:i days:i lowest:f mean:3", """
 SELECT spot_id, source, YEAR(day) AS year, COUNT(p) AS days, MIN(p) AS lowest, AVG(p) AS mean FROM (
  SELECT *, FLOOR(100*fill + 0.5) AS p FROM balanced) AS b GROUP BY 1, 2, 3""", recursive=True, **PLACE_PARTS, spot_rows=SPOT_ROWS, one_spot=ONE_SPOT,
       at_spot="MATERIALIZED " + AT_SPOT, spot_sites="MATERIALIZED " + SPOT_SITES, **_at_spots(SOIL_PARTS))
def _(t):
    w = D.soil_at_places(spot_daily(t, reading(t, located(t)), SITED), "spot_id")
    return w.groupBy("spot_id", "source", F.year("day").alias("year")).agg(
        F.count("soil_water").alias("days"), F.min("soil_water").alias("lowest"), F.avg("soil_water").alias("mean"))


SOIL_AT_SPOTS = dict(at_spot="MATERIALIZED " + AT_SPOT, spot_sites="MATERIALIZED " + SPOT_SITES, **_at_spots(SOIL_PARTS))


#: What the snow and the soil of a spot need beside its days.
SITED = ["read_elevation", "read_lat", "capacity"]


def whole_days(t, at, searches):
    """The daily answer whole, with the water left in the soil, which each spot's series gives from its first day on.

    One pass over the series of the asked spots and sources: stock, flag and soil; only the days asked for leave it."""
    spots = reading(t, at)
    asked, parts = written(D.at_spots(searches, at, spots)), G.parts_for(spots, G.SHARE)
    read = written(spots.join(asked.select("spot_id", "source").distinct(), "spot_id"))
    flags = D.only_asked(asked, D.snow_at_places(spot_daily(t, read, SITED, parts), first_days(t), BASELINE, "sim", "spot_id"), parts)
    days = D.soil_at_places(flags, "spot_id", [*G.DEALT, *MEASURES, "snow_on_ground", "_asked"])
    return D.days_of_spots(asked, days.filter("_asked").drop("_asked"), parts, "sim")


@query("day1_every_column",
       "search_id:i date:d origin:s source:s temperature_min:f temperature_max:f temperature_mean:f precipitation:f snow_on_ground:s soil_water:f cloud_cover:f "
       "relative_humidity_mean:f wind_speed_mean:f wet_bulb_mean:1 humid_heat:f sky:s band_max:f band_min:f", """
 SELECT search_id, p.source, p.day AS date, CASE WHEN p.source = 'sim' THEN 'simulated' ELSE 'observed' END AS origin, ROUND_EVEN(tasmax, 1) AS temperature_max,
  ROUND_EVEN(tasmin, 1) AS temperature_min, ROUND_EVEN(tas, 1) AS temperature_mean, ROUND_EVEN(pr, 1) AS precipitation, ROUND_EVEN(clt, 1) AS cloud_cover,
  ROUND_EVEN(hurs, 1) AS relative_humidity_mean, ROUND_EVEN(sfcWind*3.6, 1) AS wind_speed_mean, ROUND_EVEN(wb, 1) AS wet_bulb_mean,
  CASE WHEN wb >= 30 THEN 2 WHEN wb >= 26 THEN 1 WHEN wb IS NOT NULL THEN 0 END AS humid_heat,
  CASE WHEN pr >= 1 THEN CASE WHEN tas < 1.5 THEN 'snow' WHEN tas IS NOT NULL THEN 'rain' END WHEN pr IS NULL OR clt IS NULL THEN NULL WHEN clt >= 70 THEN 'overcast'
   WHEN clt >= 30 THEN 'cloudy' ELSE 'clear' END AS sky, CASE WHEN tasmax IS NOT NULL THEN LEAST(GREATEST(FLOOR(tasmax/5)+1, 0), 9) END AS band_max,
  CASE WHEN tasmin IS NOT NULL THEN LEAST(GREATEST(FLOOR(tasmin/5)+1, 0), 9) END AS band_min, snow AS snow_on_ground, FLOOR(100*fill + 0.5) AS soil_water
 FROM page AS p JOIN spot_rows AS r ON r.place_id = p.place_id JOIN balanced AS b ON b.spot_id = r.spot_id AND b.source = p.source AND b.day = p.day""", recursive=True,
       **{k: v for k, v in PAGE_PARTS.items() if k not in ("page", "wet", "at_spot", "moves", "stocks")} | SOIL_AT_SPOTS | {k: PAGE_PARTS[k] for k in ("wet", "page")})
def _(t):
    at = located(t)
    return whole_days(t, at, accepted(t, at))


# The store of the sample: temperatures blended where the mask is on, one run for all simulated arrays.
ARRAYS = [(source, grid, n, temperatures if n in TEMPERATURES else rest, fallback if n in TEMPERATURES else None, run)
          for source, temperatures, rest, run, fallbacks in (("obs", "E-OBS", "ERA5", None, ("ERA5", "ERA5-Land")), ("sim", "RCM", "RCM", "r1", (None, None)))
          for grid, fallback, held in (("coarse", fallbacks[0], MEASURES), ("fine", fallbacks[1], TEMPERATURES)) for n in held]
DATASETS = """SELECT search_id, s.place_id, CASE WHEN s.source = 'sim' THEN 'RCM' WHEN r.fine_id IS NOT NULL THEN CASE WHEN f.eobs THEN 'E-OBS' ELSE 'ERA5-Land' END || ' (temperatures), ERA5'
  WHEN c.eobs THEN 'E-OBS (temperatures), ERA5' ELSE 'ERA5' END AS dataset
 FROM status AS s JOIN spot_rows AS r ON r.place_id = s.place_id JOIN cells AS c ON c.cell_id = r.cell_id LEFT JOIN cells010 AS f ON f.fine_id = r.fine_id WHERE status = 'ok'"""


def dataset_names(t, at, searches):
    arrays = t.spark.createDataFrame(ARRAYS, "source string, grid string, variable string, dataset string, fallback string, run string")
    masks = provenance.masks_at(at, t.cells, t.cells010)
    both = t.spark.createDataFrame([("coarse",), ("fine",)], "grid string")
    return provenance.of_searches(searches, masks, provenance.require(arrays, both, simulated="sim"))


@query("day1_dataset_names", "search_id:i dataset:s", "SELECT search_id, dataset FROM datasets", **PLACE_PARTS, status=STATUS, spot_rows=SPOT_ROWS, datasets=DATASETS)
def _(t):
    at = located(t)
    return dataset_names(t, at, accepted(t, at))


def _field(name):
    return f"COALESCE(CASE WHEN ROUND_EVEN({name}, 0) = {name} THEN CAST(CAST({name} AS BIGINT) AS VARCHAR) ELSE REPLACE(CAST({name} AS VARCHAR), '.', ',') END, '')"


FILE_SQL = f"""SELECT search_id, day, CONCAT_WS(';', CAST(day AS VARCHAR), CASE WHEN source = 'sim' THEN 'simulated' ELSE 'observed' END, dataset, {_field('tn')}, {_field('tx')}, {_field('rain')},
  CASE WHEN snow THEN 'yes' WHEN NOT snow THEN 'no' ELSE '' END, {_field('soil')}, {_field('cloud')}, {_field('humidity')}, {_field('wind')}, {_field('wet_bulb')},
  CASE WHEN wb >= 30 THEN 'extreme' WHEN wb >= 26 THEN 'marked' ELSE '' END,
  CASE WHEN pr >= 1 THEN CASE WHEN tas < 1.5 THEN 'snow' WHEN tas IS NOT NULL THEN 'rain' ELSE '' END WHEN pr IS NULL OR clt IS NULL THEN '' WHEN clt >= 70 THEN 'overcast'
   WHEN clt >= 30 THEN 'cloudy' ELSE 'clear' END) AS line
 FROM (SELECT p.*, dataset, ROUND_EVEN(tasmin, 1) AS tn, ROUND_EVEN(tasmax, 1) AS tx, ROUND_EVEN(pr, 1) AS rain, FLOOR(100*fill + 0.5) AS soil, ROUND_EVEN(clt, 1) AS cloud,
   ROUND_EVEN(hurs, 1) AS humidity, ROUND_EVEN(sfcWind*3.6, 1) AS wind, ROUND_EVEN(wb, 1) AS wet_bulb
  FROM page AS p JOIN datasets AS n ON n.search_id = p.search_id JOIN spot_rows AS r ON r.place_id = p.place_id
  JOIN balanced AS b ON b.spot_id = r.spot_id AND b.source = p.source AND b.day = p.day) AS x"""


@query("src15_day_file", "search_id:i day:d line:s", FILE_SQL, recursive=True, **{k: v for k, v in PAGE_PARTS.items() if k not in ("page", "wet", "at_spot", "moves", "stocks")}
       | SOIL_AT_SPOTS | {k: PAGE_PARTS[k] for k in ("wet", "page")} | {"datasets": DATASETS})
def _(t):
    """The day file of every search: fourteen columns, the dataset's name among them."""
    at = located(t)
    searches = accepted(t, at)
    days = provenance.with_datasets(whole_days(t, at, searches), dataset_names(t, at, searches))
    return export.csv_lines(days.withColumn("day", F.col("date")), keep=("search_id", "day"))
