"""Queries: snow on the ground and soil water, over every cell and day."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.catalog.q_functions import FAO_PARTS
from daygrid.operators import grid as G
from daygrid.operators import snow as S
from daygrid.operators import soil as L
from daygrid.operators import trials as T

SNOW_YEAR = "YEAR(day) + CASE WHEN MONTH(day) >= 8 THEN 1 ELSE 0 END"
IN_WINTER = "MONTH(day) IN (11, 12, 1, 2, 3, 4)"


def stock_sql(table: str, keys: str, fall: str = "0.5", melt: str = "4.0", ground: str = "0.0", tas: str = "tas") -> dict:
    """Two CTE texts, ``moves`` and ``stocks``: running sum of fall - melt, then the stock above its minimum."""
    moves = f"""SELECT *, SUM(fall - loss) OVER (PARTITION BY {keys}, snow_year ORDER BY day) AS c FROM (
   SELECT *, {SNOW_YEAR} AS snow_year, CASE WHEN {tas} < {fall} THEN COALESCE(pr, 0) ELSE 0.0 END AS fall,
    CASE WHEN {tas} IS NULL THEN 0.0 ELSE {melt}*GREATEST({tas}, 0.0) + {ground} END AS loss FROM {table}) AS m"""
    stocks = f"""SELECT *, c - LEAST(0.0, MIN(c) OVER (PARTITION BY {keys}, snow_year ORDER BY day)) AS stock FROM moves"""
    return {"moves": moves, "stocks": stocks}


STOCKS = stock_sql("daily", "source, cell_id")
LIQUID = """SELECT *, CASE WHEN tas < 0.5 THEN 0.0 ELSE COALESCE(pr, 0) END
  + GREATEST(COALESCE(LAG(stock) OVER (PARTITION BY source, cell_id, snow_year ORDER BY day), 0) + fall - stock, 0.0) AS water FROM stocks"""


@query("snow1_stock_soil1_liquid", "source:s cell_id:i day:d snow_stock:3 snow:b water:3", """
 SELECT source, cell_id, day, stock AS snow_stock, stock >= 2.0 - 0.000000001 AS snow, water FROM liquid""",
       headline=True, **STOCKS, liquid=LIQUID)
def _(t):
    return S.liquid(S.stock(t.daily))


WINTERS = f"""SELECT source, cell_id, snow_year AS winter, COUNT(*) AS days, SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS snow_days
 FROM stocks WHERE {IN_WINTER} AND (source, cell_id, snow_year) IN (SELECT (source, cell_id, snow_year) FROM stocks WHERE MONTH(day) = 8 AND DAY(day) = 1) GROUP BY 1, 2, 3"""


@query("snow3_days_per_winter", "source:s cell_id:i winter:i days:i snow_days:i", "SELECT * FROM winters", **STOCKS, winters=WINTERS)
def _(t):
    return S.per_winter(S.stock(t.daily))


@query("snow4_5_winter_means", "source:s cell_id:i snow_days:4 winters:i counted:b", """
 SELECT source, cell_id, AVG(snow_days) AS snow_days, COUNT(*) AS winters, COALESCE(MAX(elevation) <= 800, FALSE) AS counted
 FROM winters JOIN cells USING (cell_id) WHERE winter BETWEEN 1996 AND 2001 GROUP BY 1, 2""", **STOCKS, winters=WINTERS)
def _(t):
    m = S.winter_mean(S.per_winter(S.stock(t.daily)), 1996, 2001)
    return m.join(t.cells.select("cell_id", "elevation"), "cell_id").withColumn("counted", S.counted("elevation"))


@query("snow6_change_ratio", "cell_id:i rare:b snow_days:4 winters:i", """
 SELECT w.cell_id, m.snow_days < 3 AS rare, CASE WHEN m.snow_days >= 3 THEN p.snow_days*w.snow_days/m.snow_days END AS snow_days, w.winters
 FROM (SELECT cell_id, AVG(snow_days) AS snow_days, COUNT(*) AS winters FROM winters WHERE source = 'sim' AND winter BETWEEN 2028 AND 2033 GROUP BY 1) AS w
 JOIN (SELECT cell_id, AVG(snow_days) AS snow_days FROM winters WHERE source = 'sim' AND winter BETWEEN 1996 AND 2001 GROUP BY 1) AS m USING (cell_id)
 JOIN (SELECT cell_id, AVG(snow_days) AS snow_days FROM winters WHERE source = 'obs' AND winter BETWEEN 1996 AND 2001 GROUP BY 1) AS p USING (cell_id)""",
       **STOCKS, winters=WINTERS)
def _(t):
    w = S.per_winter(S.stock(t.daily))
    sim, obs = w.filter("source = 'sim'"), w.filter("source = 'obs'")
    key = ["cell_id"]
    return S.change_ratio(S.winter_mean(obs, 1996, 2001, key), S.winter_mean(sim, 1996, 2001, key),
                          S.winter_mean(sim, 2028, 2033, key), key)


# The trial grids of the calibration and of the ground term.
FALLS, MELTS, LEVELS = (0.5, 1.0, 1.5, 2.0), (1.5, 2.0, 3.0, 4.0, 5.0), (1.0, 2.0, 5.0)
GROUND_DAYS, GROUND_FACTORS, GROUND_MELTS, GROUND_LEVELS = (10, 20, 30), (0.5, 1.0, 2.0), (2.0, 3.0, 4.0), (1.0, 2.0)
# The sample holds three winters on each side; 15 and 10 are asked for on long series.
LEAST_WINTERS = 2
PARTS = "CASE WHEN winter <= 1998 THEN 'calibration' ELSE 'control' END"
KNOWN = f"""SELECT * FROM (SELECT station_id, {SNOW_YEAR} AS winter, COUNT(depth) AS known, SUM(CASE WHEN depth >= 3 THEN 1 ELSE 0 END) AS snowy,
  DATE_DIFF('day', MAKE_DATE({SNOW_YEAR} - 1, 11, 1), MAKE_DATE({SNOW_YEAR}, 4, 30)) + 1 AS days FROM station_series WHERE {IN_WINTER} GROUP BY ALL) AS w
 WHERE known >= 0.95*days"""
HELD_WINTER = "snow_year IN (SELECT YEAR(day) + 1 FROM days_held WHERE source = 'obs' AND MONTH(day) = 8 AND DAY(day) = 1)"
TRIED = """SELECT w.*, snowy*days*1.0/known AS observed_days, m*days*1.0/known AS snow_days FROM known AS k JOIN (
  SELECT station_id, snow_year AS winter, {by}, SUM(CASE WHEN stock >= {level} - 0.000000001 THEN 1 ELSE 0 END) AS m FROM stocks
  WHERE depth IS NOT NULL AND {season} AND {held} GROUP BY ALL) AS w USING (station_id, winter)"""
SCORES = """SELECT {by}, AVG(ABS(m-o)) AS error, AVG(m-o) AS bias, CORR(m, o) AS correlation, AVG(o) AS observed, AVG(m) AS computed, COUNT(*) AS stations FROM (
  SELECT station_id, {by}, AVG(snow_days) AS m, AVG(observed_days) AS o FROM (SELECT *, {parts} AS part FROM tried) AS t GROUP BY ALL HAVING COUNT(*) >= 2) AS s GROUP BY ALL"""


def tried(by: str, level: str = "2.0") -> dict:
    return {"known": KNOWN, "tried": TRIED.format(by=by, level=level, season=IN_WINTER, held=HELD_WINTER)}


def scored(df, settings, by=()):
    """Scores of every setting over calibration and control winters; ``by`` are columns of the station."""
    df = df.withColumn("observed", F.col("depth") >= 3)
    winters = T.trial_winters(df, settings, ["station_id", *by], "observed")
    winters = winters.withColumn("part", F.when(F.col("winter") <= 1998, "calibration").otherwise("control"))
    return T.trial_scores(winters, ["station_id"], ["part", *by, *settings[0].labels], LEAST_WINTERS)


@query("snow7_grid_search", "part:s ts:1 ddf:1 s0:1 error:4 bias:4 correlation:4 stations:i", SCORES.format(by="part, ts, ddf, s0", parts=PARTS),
       trial="""SELECT d.*, ts, ddf, s0 FROM station_series AS d CROSS JOIN (VALUES (0.5), (1.0), (1.5), (2.0)) AS a(ts)
 CROSS JOIN (VALUES (1.5), (2.0), (3.0), (4.0), (5.0)) AS b(ddf) CROSS JOIN (VALUES (1.0), (2.0), (5.0)) AS c(s0)""",
       **stock_sql("trial", "station_id, ts, ddf, s0", "ts", "ddf"), **tried("ts, ddf, s0", "s0"))
def _(t):
    return scored(t.station_series, [T.Setting({"ts": a, "ddf": b, "s0": c}, S.Melt(a, b, c)) for a in FALLS for b in MELTS for c in LEVELS])


@query("snow8_ground_term", "part:s n:i g:1 ddf:1 s0:1 error:4 bias:4 correlation:4 stations:i", SCORES.format(by="part, n, g, ddf, s0", parts=PARTS),
       warmed="MATERIALIZED SELECT *, " + ", ".join(
           f"AVG(tas) OVER (PARTITION BY station_id ORDER BY day RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS warm{n}"
           for n in GROUND_DAYS) + " FROM station_series",
       trial="""SELECT station_id, day, tas, pr, depth, n, g, ddf, s0, g*GREATEST(CASE n WHEN 10 THEN warm10 WHEN 20 THEN warm20 ELSE warm30 END, 0.0) AS ground
 FROM warmed CROSS JOIN (VALUES (10), (20), (30)) AS a(n) CROSS JOIN (VALUES (0.5), (1.0), (2.0)) AS b(g)
 CROSS JOIN (VALUES (2.0), (3.0), (4.0)) AS c(ddf) CROSS JOIN (VALUES (1.0), (2.0)) AS d(s0)""",
       **stock_sql("trial", "station_id, n, g, ddf, s0", "0.5", "ddf", "COALESCE(ground, 0)"), **tried("n, g, ddf, s0", "s0"))
def _(t):
    warm = t.station_series.withColumns({f"warm{n}": T.warm_column("tas", n, ["station_id"]) for n in GROUND_DAYS})
    return scored(warm, [T.Setting({"n": n, "g": g, "ddf": m, "s0": c}, S.Melt(mm_per_degree=m, stock_mm=c), ground=g, warm=f"warm{n}")
                         for n in GROUND_DAYS for g in GROUND_FACTORS for m in GROUND_MELTS for c in GROUND_LEVELS])


PACK_IN = """MATERIALIZED SELECT source, cell_id, day, fall, loss, MONTH(day) = 8 AND DAY(day) = 1 AS opens,
  ROW_NUMBER() OVER (PARTITION BY source, cell_id ORDER BY day) AS k FROM stocks"""
PACK = """SELECT source, cell_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS mass, CAST(100 AS DOUBLE) AS density FROM pack_in WHERE k = 1 UNION ALL
 SELECT i.source, i.cell_id, i.k, GREATEST(m.kept + i.fall - i.loss, 0.0),
  CASE WHEN m.kept + i.fall - i.loss > 0 THEN LEAST(400.0, v.mean + (400.0 - v.mean)/60.0) ELSE 100.0 END
 FROM pack AS r JOIN pack_in AS i ON i.source = r.source AND i.cell_id = r.cell_id AND i.k = r.k + 1,
  LATERAL (SELECT CASE WHEN i.opens THEN 0.0 ELSE r.mass END AS kept) AS m,
  LATERAL (SELECT CASE WHEN m.kept + i.fall > 0 THEN (m.kept + i.fall)/(m.kept/r.density + i.fall/100.0) ELSE 100.0 END AS mean) AS v"""


@query("snow9_settling_depth", "source:s cell_id:i day:d depth_cm:3 stock_mm:3", """
 SELECT i.source, i.cell_id, i.day, 100*p.mass/p.density AS depth_cm, p.mass AS stock_mm FROM pack_in AS i JOIN pack AS p ON p.source = i.source AND p.cell_id = i.cell_id AND p.k = i.k""",
       recursive=True, **STOCKS, pack_in=PACK_IN, pack=PACK)
def _(t):
    return S.depth_settling(S.stock(t.daily), "cell_id")


@query("snow9_fixed_depth", "source:s cell_id:i winter:i deepest:3 reached:i", f"""
 SELECT source, cell_id, snow_year AS winter, MAX(stock/250.0*100) AS deepest, SUM(CASE WHEN stock/250.0*100 >= 5 - 0.000000001 THEN 1 ELSE 0 END) AS reached
 FROM stocks WHERE {IN_WINTER} GROUP BY 1, 2, 3""", **STOCKS)
def _(t):
    from daygrid.functions.calendar import in_snow_season
    d = S.stock(t.daily).filter(in_snow_season("day")).withColumn("cm", S.depth_fixed("snow_stock"))
    return d.groupBy("source", "cell_id", F.col("snow_year").alias("winter")).agg(
        F.max("cm").alias("deepest"), F.count_if(F.col("cm") >= 5 - 1e-9).alias("reached"))


@query("snow10_daily_skill", "station_id:i hit_rate:4 false_alarms:4 days:i", f"""
 SELECT station_id, SUM(CASE WHEN s AND o THEN 1 ELSE 0 END)/NULLIF(SUM(CASE WHEN o THEN 1 ELSE 0 END), 0) AS hit_rate,
  SUM(CASE WHEN s AND NOT o THEN 1 ELSE 0 END)/NULLIF(SUM(CASE WHEN s THEN 1 ELSE 0 END), 0) AS false_alarms, COUNT(*) AS days FROM (
  SELECT station_id, stock >= 2.0 - 0.000000001 AS s, depth >= 3 AS o FROM stocks WHERE {IN_WINTER}) AS f GROUP BY station_id""",
       **stock_sql("station_daily", "station_id"))
def _(t):
    from daygrid.functions.calendar import in_snow_season
    f = S.stock(t.station_daily, ["station_id"]).filter(in_snow_season("day")).withColumn("observed", F.col("depth") >= 3)
    return S.daily_skill(f, ["station_id"])


MONTHLY_RATE = "CASE MONTH(day) " + " ".join(
    f"WHEN {m} THEN {round((a + b) / 2, 2):.2f}" for m, (a, b) in enumerate(zip(
        (2.4, 3.3, 4.1, 4.2, 4.2, 4.2, 4.0, 3.6, 3.6, 3.1, 3.0, 2.4), (3.9, 5.7, 7.5, 8.4, 8.4, 8.0, 7.8, 7.6, 7.2, 6.1, 4.7, 3.5)), 1)) + " END"


@query("snow11_lift_variants", "part:s variant:s altitude_class:i error:4 bias:4 correlation:4 stations:i",
       SCORES.format(by="part, variant, altitude_class", parts=PARTS),
       trial=f"""SELECT * REPLACE (tas + rate*gap/1000.0 AS tas) FROM (SELECT d.*, variant, CAST(LEAST(3, FLOOR(s.elevation/500)) AS BIGINT) AS altitude_class,
   c.elevation - s.elevation AS gap, CASE variant WHEN 'none' THEN 0.0 WHEN 'five' THEN 5.0 WHEN 'standard' THEN 6.5 ELSE {MONTHLY_RATE} END AS rate
  FROM station_series AS d JOIN stations AS s USING (station_id) JOIN cells AS c ON c.cell_id = s.cell_id
  CROSS JOIN (VALUES ('none'), ('five'), ('standard'), ('monthly')) AS v(variant) WHERE c.elevation IS NOT NULL) AS x""",
       **stock_sql("trial", "station_id, variant"), **tried("variant, altitude_class"))
def _(t):
    rates = {"none": F.lit(0.0), "five": F.lit(5.0), "standard": F.lit(6.5), "monthly": G.lapse_rate("tas", F.month("day"))}
    where = t.stations.select("station_id", "cell_id", F.col("elevation").alias("height")).join(
        t.cells.select("cell_id", "elevation"), "cell_id").filter("elevation IS NOT NULL")
    lift = (F.col("elevation") - F.col("height")) / 1000.0
    d = t.station_series.join(where, "station_id").withColumns({f"tas_{n}": F.col("tas") + r * lift for n, r in rates.items()})
    d = d.withColumn("altitude_class", F.least(F.lit(3), F.floor(F.col("height") / 500)))
    return scored(d, [T.Setting({"variant": n}, tas=f"tas_{n}") for n in rates], ["altitude_class"])


@query("snow12_place_study", "source:s cell_id:i winter:i snow_days:i tas_djf:4 rain_djf:4 cold_days:i cold_wet_days:i", f"""
 SELECT source, cell_id, snow_year AS winter, SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS snow_days,
  AVG(CASE WHEN MONTH(day) IN (12, 1, 2) THEN tas END) AS tas_djf, SUM(CASE WHEN MONTH(day) IN (12, 1, 2) THEN pr END) AS rain_djf,
  SUM(CASE WHEN tas < 0.5 THEN 1 ELSE 0 END) AS cold_days, SUM(CASE WHEN tas < 0.5 AND pr >= 1 THEN 1 ELSE 0 END) AS cold_wet_days
 FROM stocks WHERE {IN_WINTER} GROUP BY 1, 2, 3""", **STOCKS)
def _(t):
    from daygrid.functions.calendar import in_snow_season
    d, deep = S.stock(t.daily).filter(in_snow_season("day")), F.month("day").isin(12, 1, 2)
    return d.groupBy("source", "cell_id", F.col("snow_year").alias("winter")).agg(
        F.count_if("snow").alias("snow_days"), F.avg(F.when(deep, F.col("tas"))).alias("tas_djf"),
        F.sum(F.when(deep, F.col("pr"))).alias("rain_djf"), F.count_if(F.col("tas") < 0.5).alias("cold_days"),
        F.count_if((F.col("tas") < 0.5) & (F.col("pr") >= 1)).alias("cold_wet_days"))


@query("snow13_months_and_rain_sources", "altitude_class:i month:i observed:i computed:i bias:i wet:i drizzle:i cold_wet:i common_wet:i", f"""
 SELECT CAST(LEAST(2, FLOOR(s.elevation/300)) AS BIGINT) AS altitude_class, MONTH(x.day) AS month, SUM(CASE WHEN depth >= 3 THEN 1 ELSE 0 END) AS observed,
  SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) AS computed,
  SUM(CASE WHEN stock >= 2.0 - 0.000000001 THEN 1 ELSE 0 END) - SUM(CASE WHEN depth >= 3 THEN 1 ELSE 0 END) AS bias,
  SUM(CASE WHEN x.pr >= 1 THEN 1 ELSE 0 END) AS wet, SUM(CASE WHEN x.pr > 0 AND x.pr < 1 THEN 1 ELSE 0 END) AS drizzle,
  SUM(CASE WHEN x.tas < 0.5 AND x.pr >= 1 THEN 1 ELSE 0 END) AS cold_wet, SUM(CASE WHEN x.pr >= 1 AND o.pr >= 1 THEN 1 ELSE 0 END) AS common_wet
 FROM stocks AS x JOIN stations AS s USING (station_id) JOIN obs AS o ON o.cell_id = s.cell_id AND o.day = x.day GROUP BY 1, 2""",
       **stock_sql("station_daily", "station_id"))
def _(t):
    x = S.stock(t.station_daily, ["station_id"]).join(t.stations.select("station_id", "cell_id", "elevation"), "station_id")
    x = x.join(t.obs.select("cell_id", "day", F.col("pr").alias("grid_pr")), ["cell_id", "day"])
    wet = F.col("pr") >= 1
    return x.groupBy(F.least(F.lit(2), F.floor(F.col("elevation") / 300)).alias("altitude_class"), F.month("day").alias("month")).agg(
        F.count_if(F.col("depth") >= 3).alias("observed"), F.count_if("snow").alias("computed"),
        (F.count_if("snow") - F.count_if(F.col("depth") >= 3)).alias("bias"), F.count_if(wet).alias("wet"),
        F.count_if((F.col("pr") > 0) & ~wet).alias("drizzle"), F.count_if(wet & (F.col("tas") < 0.5)).alias("cold_wet"),
        F.count_if(wet & (F.col("grid_pr") >= 1)).alias("common_wet"))


# --- soil water -----------------------------------------------------------------

DEMAND = """SELECT source, cell_id, day, CASE WHEN rn IS NOT NULL AND u2 IS NOT NULL THEN GREATEST(0.0,
  (0.408*delta*rn + gam*900/((tasmax+tasmin)/2+273.0)*u2*(es-ea))/(delta+gam*(1+0.34*u2))) END AS et0 FROM fao7"""
INPUTS = """MATERIALIZED SELECT l.source, l.cell_id, l.day, l.water, d.et0, COALESCE(c.capacity, 100.0) AS cap,
  ROW_NUMBER() OVER (PARTITION BY l.source, l.cell_id ORDER BY l.day) AS k FROM liquid AS l JOIN demand AS d USING (source, cell_id, day) JOIN cells AS c USING (cell_id)"""
STEPS = """SELECT source, cell_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS after, CAST(NULL AS DOUBLE) AS ks, CAST(NULL AS DOUBLE) AS eta
  FROM inputs WHERE k = 1 UNION ALL
 SELECT i.source, i.cell_id, i.k, CASE WHEN i.et0 IS NULL THEN r.d ELSE LEAST(GREATEST(r.d + s.ks*i.et0 - i.water, 0.0), i.cap) END,
  r.d + s.ks*i.et0 - i.water, CASE WHEN i.et0 IS NOT NULL THEN s.ks END, s.ks*i.et0
 FROM steps AS r JOIN inputs AS i ON i.source = r.source AND i.cell_id = r.cell_id AND i.k = r.k + 1,
  LATERAL (SELECT CASE WHEN r.d <= 0.5*i.cap THEN 1.0 ELSE (i.cap - r.d)/(i.cap - 0.5*i.cap) END AS ks) AS s"""
BALANCED = """SELECT i.source, i.cell_id, i.day, i.et0, i.water, CASE WHEN i.et0 IS NOT NULL THEN 1 - s.d/i.cap END AS fill, s.ks, s.eta,
  CASE WHEN i.et0 IS NOT NULL THEN GREATEST(-s.after, 0.0) END AS drainage FROM inputs AS i JOIN steps AS s ON s.source = i.source AND s.cell_id = i.cell_id AND s.k = i.k"""
SOIL_PARTS = dict(**STOCKS, liquid=LIQUID, **FAO_PARTS, demand=DEMAND, inputs=INPUTS, steps=STEPS, balanced=BALANCED)


def sites(t):
    return t.cells.select("cell_id", "lat", F.col("elevation").alias("altitude"), "capacity")


def soil_water(t):
    return L.water(t.daily, sites(t))


@query("soil2_4_water_balance", "source:s cell_id:i day:d fill:4 ks:4 eta:4 drainage:4", "SELECT * FROM balanced",
       headline=True, recursive=True, **SOIL_PARTS)
def _(t):
    return soil_water(t)


@query("soil3_percent_day4_driest", "source:s cell_id:i year:i day:d soil_water:f", """
 SELECT source, cell_id, year, day, soil_water FROM (SELECT *, YEAR(day) AS year, ROW_NUMBER() OVER (PARTITION BY source, cell_id, YEAR(day) ORDER BY soil_water, day) AS k FROM (
  SELECT source, cell_id, day, FLOOR(100*fill + 0.5) AS soil_water FROM balanced WHERE fill IS NOT NULL) AS p) AS q WHERE k = 1""", recursive=True, **SOIL_PARTS)
def _(t):
    p = L.percent(soil_water(t)).withColumn("year", F.year("day"))
    return L.driest_day(p, ["source", "cell_id", "year"])


@query("soil5_block_size", "source:s cell_id:i day:d side:s", "SELECT source, cell_id, day, 'a' AS side FROM daily WHERE FALSE")
def _(t):
    """Rows that differ between two block sizes: none."""
    from daygrid.sources.checks import same_rows
    a = L.water(t.daily, sites(t), block=1).select("source", "cell_id", "day", "fill")
    b = L.water(t.daily, sites(t), block=1024).select("source", "cell_id", "day", "fill")
    return same_rows(a, b)


@query("soil6_stress_figures", "source:s cell_id:i year:i stress_days:i summer_days:i deficit:3 first_day:f last_day:f", """
 SELECT source, cell_id, YEAR(day) AS year, SUM(CASE WHEN ks < 0.5 THEN 1 ELSE 0 END) AS stress_days,
  SUM(CASE WHEN ks < 0.5 AND MONTH(day) IN (6, 7, 8) THEN 1 ELSE 0 END) AS summer_days, SUM(et0 - eta) AS deficit,
  MIN(CASE WHEN ks < 0.5 THEN DAYOFYEAR(day) END) AS first_day, MAX(CASE WHEN ks < 0.5 THEN DAYOFYEAR(day) END) AS last_day
 FROM balanced GROUP BY 1, 2, 3""", recursive=True, **SOIL_PARTS)
def _(t):
    return L.stress_days(soil_water(t))


@query("soil6_summer_rank", "source:s cell_id:i year:i fill:4 rank:i", """
 SELECT source, cell_id, year, fill, ROW_NUMBER() OVER (PARTITION BY source, cell_id ORDER BY fill, year) AS rank FROM (
  SELECT source, cell_id, YEAR(day) AS year, AVG(fill) AS fill FROM balanced WHERE MONTH(day) IN (6, 7, 8) GROUP BY 1, 2, 3) AS s WHERE fill IS NOT NULL""",
       recursive=True, **SOIL_PARTS)
def _(t):
    return L.summer_rank(soil_water(t))


@query("soil6_spread_by_day", "source:s cell_id:i doy:i p10:4 p50:4 p90:4", """
 SELECT source, cell_id, DAYOFYEAR(day) AS doy, QUANTILE_CONT(fill, 0.1) AS p10, QUANTILE_CONT(fill, 0.5) AS p50, QUANTILE_CONT(fill, 0.9) AS p90
 FROM balanced WHERE YEAR(day) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3""", recursive=True, **SOIL_PARTS)
def _(t):
    return L.spread_by_day(soil_water(t), 1995, 2001)


# The sample's sky and measured demand: downward radiation from cloud and warmth, evaporation from the station's own reports.
ETP_MEASURED = "SELECT station_id, day, depth/2.0 + GREATEST(tas, 0.0)/8.0 AS etp FROM station_daily"
FLUX = """SELECT cell_id, day, CASE WHEN rn IS NOT NULL AND u2 IS NOT NULL THEN GREATEST(0.0, (0.408*delta*rn + gam*900/((tasmax+tasmin)/2+273.0)*u2*(es-ea))/(delta+gam*(1+0.34*u2))) END AS et0_fao,
 CASE WHEN rf IS NOT NULL AND u2 IS NOT NULL THEN GREATEST(0.0, (0.408*delta*rf + gam*900/((tasmax+tasmin)/2+273.0)*u2*(es-ea))/(delta+gam*(1+0.34*u2))) END AS et0_flux FROM (
 SELECT f.*, 0.77*rs - (0.000000004903*(POW(f.tasmax + 273.16, 4) + POW(f.tasmin + 273.16, 4))/2 - (18.0 + o.clt/10.0 + o.tas/5.0)) AS rf
 FROM fao7 AS f JOIN obs AS o ON f.source = 'obs' AND o.cell_id = f.cell_id AND o.day = f.day) AS x"""


@query("soil7_demand_variants", "station_id:i scale:s slot:i et0_fao:4 et0_flux:4 days:i", """
 SELECT station_id, 'month' AS scale, MONTH(day) AS slot, AVG(et0_fao - etp) AS et0_fao, AVG(et0_flux - etp) AS et0_flux, COUNT(etp) AS days FROM met GROUP BY 1, 3
 UNION ALL SELECT station_id, 'year', YEAR(day), AVG(et0_fao - etp), AVG(et0_flux - etp), COUNT(etp) FROM met GROUP BY 1, 3""",
       **FAO_PARTS, measured_etp=ETP_MEASURED, flux=FLUX,
       met="SELECT m.station_id, m.day, etp, et0_fao, et0_flux FROM measured_etp AS m JOIN stations AS s USING (station_id) JOIN flux AS f ON f.cell_id = s.cell_id AND f.day = m.day")
def _(t):
    sky = t.obs.withColumn("strd", 18.0 + F.col("clt") / 10.0 + F.col("tas") / 5.0)
    d = L.demand_variants(sky, sites(t)).select("cell_id", "day", "et0_fao", "et0_flux").join(t.stations.select("station_id", "cell_id"), "cell_id").drop("cell_id")
    etp = t.station_daily.select("station_id", "day", (F.col("depth") / 2.0 + F.greatest("tas", F.lit(0.0)) / 8.0).alias("etp"))
    return L.pet_bias(d, etp, ("station_id",))
