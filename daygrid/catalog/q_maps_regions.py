"""Queries: maps, regions, heat waves, indices."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.operators import grid as G
from daygrid.operators import heatwaves as HW
from daygrid.operators import indices as I
from daygrid.operators import maps as M
from daygrid.operators import polygon as P
from daygrid.operators import regions as R

EDGES = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0)
TENTHS = """SELECT source, day, d.cell_id, c."row" AS r, c.col AS c, ROUND_EVEN({v}*10, 0) AS t FROM daily AS d JOIN cells AS c ON c.cell_id = d.cell_id WHERE land"""


@query("map1_tenths", "source:s day:d cell_id:i tenths:f", "SELECT source, day, cell_id, t AS tenths FROM te", te=TENTHS.format(v="tasmax"))
def _(t):
    return M.in_order(M.tenths(t.daily, t.cells, "tasmax"))


BLOCKS = """SELECT source, day, "row"//2 AS r, col//2 AS c, CASE WHEN COUNT(psl) = 4 THEN AVG(psl) END AS v FROM daily JOIN cells USING (cell_id) GROUP BY ALL HAVING COUNT(*) = 4"""


def smooth_sql(name, src):
    """One pass along rows, then along columns."""
    return {
        f"{name}a": f"""SELECT x.source, x.day, x.r, x.c, (2*x.v + COALESCE(a.v, 0) + COALESCE(b.v, 0))/(2 + CASE WHEN a.v IS NULL THEN 0 ELSE 1 END + CASE WHEN b.v IS NULL THEN 0 ELSE 1 END) AS v
 FROM {src} AS x LEFT JOIN {src} AS a ON a.source = x.source AND a.day = x.day AND a.c = x.c AND a.r = x.r - 1
 LEFT JOIN {src} AS b ON b.source = x.source AND b.day = x.day AND b.c = x.c AND b.r = x.r + 1""",
        name: f"""SELECT x.source, x.day, x.r, x.c, (2*x.v + COALESCE(a.v, 0) + COALESCE(b.v, 0))/(2 + CASE WHEN a.v IS NULL THEN 0 ELSE 1 END + CASE WHEN b.v IS NULL THEN 0 ELSE 1 END) AS v
 FROM {name}a AS x LEFT JOIN {name}a AS a ON a.source = x.source AND a.day = x.day AND a.r = x.r AND a.c = x.c - 1
 LEFT JOIN {name}a AS b ON b.source = x.source AND b.day = x.day AND b.r = x.r AND b.c = x.c + 1"""}


@query("map3_pressure_field", "source:s day:d block_row:i block_col:i tenths:f", """
 SELECT source, day, r AS block_row, c AS block_col, ROUND_EVEN(ROUND(v*10, 9), 0) AS tenths FROM once""", blocks=BLOCKS, **smooth_sql("once", "blocks"))
def _(t):
    f = M.smooth(G.coarsen(t.daily, t.cells, "psl", rows=t.daily_rows), "psl", 1, "block_row", "block_col")
    return f.withColumn("tenths", F.rint(F.round(F.col("psl") * 10, 9)))


@query("map4_smooth_twice", "source:s day:d cell_id:i tas:4", 'SELECT x.source, x.day, k.cell_id, v AS tas FROM twice AS x JOIN cells AS k ON k."row" = x.r AND k.col = x.c',
       field='SELECT source, day, "row" AS r, col AS c, tas AS v FROM daily JOIN cells USING (cell_id)', **smooth_sql("once", "field"), **smooth_sql("twice", "once"))
def _(t):
    f = t.daily.select("source", "day", "cell_id", "tas").join(t.cells.select("cell_id", "row", "col"), "cell_id")
    return M.smooth(f, "tas", 2)


@query("map5_day_summary", "source:s day:d hottest:1 hottest_cell:i coldest:1 coldest_cell:i median:3 mean:3 cells:i band_2:i band_5:i", """
 SELECT source, day, MAX(t/10) AS hottest, ARG_MIN(cell_id, -t*1000000 + r*1000 + c) AS hottest_cell, MIN(t/10) AS coldest, ARG_MIN(cell_id, t*1000000 + r*1000 + c) AS coldest_cell,
  QUANTILE_CONT(t/10, 0.5) AS median, AVG(t/10) AS mean, COUNT(*) AS cells, SUM(CASE WHEN t/10 >= 5 AND t/10 < 10 THEN 1 ELSE 0 END) AS band_2,
  SUM(CASE WHEN t/10 >= 20 AND t/10 < 25 THEN 1 ELSE 0 END) AS band_5 FROM te WHERE t IS NOT NULL GROUP BY 1, 2""", headline=True, te=TENTHS.format(v="tasmax"))
def _(t):
    return M.day_summary(M.tenths(t.daily, t.cells, "tasmax"), EDGES)


@query("map6_isobar_levels", "source:s day:d level:i", """
 SELECT source, day, UNNEST(GENERATE_SERIES(CAST(CEIL(lo/10/5)*5 AS BIGINT), CAST(FLOOR(hi/10/5)*5 AS BIGINT), 5)) AS level FROM (
  SELECT source, day, MIN(t) AS lo, MAX(t) AS hi FROM te WHERE t IS NOT NULL GROUP BY 1, 2) AS x""", te=TENTHS.format(v="psl"))
def _(t):
    return M.levels(M.tenths(t.daily, t.cells, "psl"))


def _segment(a, b, when):
    return f"SELECT source, day, level, {a}, {b} FROM sq WHERE {when}"


TOP, RIGHT = "r AS row{k}, c + (lv - a)/NULLIF(b - a, 0) AS col{k}", "r + (lv - b)/NULLIF(e - b, 0) AS row{k}, c + 1 AS col{k}"
BOTTOM, LEFT = "r + 1 AS row{k}, c + (lv - d)/NULLIF(e - d, 0) AS col{k}", "r + (lv - a)/NULLIF(d - a, 0) AS row{k}, c AS col{k}"


def seg(p, q, when):
    return _segment(p.format(k=1), q.format(k=2), when)


@query("map7_contours", "source:s day:d level:i row1:4 col1:4 row2:4 col2:4", " UNION ALL ".join((
    seg(LEFT, BOTTOM, "k IN (1, 14) OR (k = 5 AND NOT m) OR (k = 10 AND m)"), seg(BOTTOM, RIGHT, "k IN (2, 13) OR (k = 5 AND m) OR (k = 10 AND NOT m)"),
    seg(LEFT, RIGHT, "k IN (3, 12)"), seg(TOP, RIGHT, "k IN (4, 11) OR (k = 5 AND NOT m) OR (k = 10 AND m)"), seg(TOP, BOTTOM, "k IN (6, 9)"),
    seg(TOP, LEFT, "k IN (7, 8) OR (k = 5 AND m) OR (k = 10 AND NOT m)"))), te=TENTHS.format(v="psl"),
    sq="""SELECT *, CASE WHEN a >= lv THEN 8 ELSE 0 END + CASE WHEN b >= lv THEN 4 ELSE 0 END + CASE WHEN e >= lv THEN 2 ELSE 0 END + CASE WHEN d >= lv THEN 1 ELSE 0 END AS k,
  (a+b+d+e)/4 >= lv AS m FROM (SELECT x.source, x.day, x.r, x.c, x.t AS a, y.t AS b, z.t AS d, w.t AS e, level, level*10.0 AS lv FROM te AS x
   JOIN te AS y ON y.source = x.source AND y.day = x.day AND y.r = x.r AND y.c = x.c + 1 JOIN te AS z ON z.source = x.source AND z.day = x.day AND z.r = x.r + 1 AND z.c = x.c
   JOIN te AS w ON w.source = x.source AND w.day = x.day AND w.r = x.r + 1 AND w.c = x.c + 1 CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(950, 1050, 5)) AS level) AS l) AS s
  WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL""")
def _(t):
    return M.contours(M.tenths(t.daily, t.cells, "psl"))


@query("map8_change_map", "cell_id:i tasmax:3", """
 SELECT a.cell_id, a.v - b.v AS tasmax FROM (SELECT cell_id, AVG(tasmax) AS v FROM daily WHERE source = 'sim' AND YEAR(day) BETWEEN 2029 AND 2033 AND MONTH(day) IN (6, 7, 8) GROUP BY 1) AS a
 JOIN (SELECT cell_id, AVG(tasmax) AS v FROM daily WHERE source = 'sim' AND YEAR(day) BETWEEN 1995 AND 2001 AND MONTH(day) IN (6, 7, 8) GROUP BY 1) AS b USING (cell_id)""")
def _(t):
    sim = t.daily.filter("source = 'sim'")
    return M.change(M.period_mean(sim, "tasmax", 2029, 2033, (6, 7, 8)), M.period_mean(sim, "tasmax", 1995, 2001, (6, 7, 8)), "tasmax")


@query("map8_figures", "mean:3 lowest:3 highest:3", """
 SELECT SUM(COS(RADIANS(lat))*v)/SUM(COS(RADIANS(lat))) AS mean, MIN(v) AS lowest, MAX(v) AS highest FROM (
  SELECT cell_id, AVG(tasmax) AS v FROM obs WHERE MONTH(day) IN (6, 7, 8) GROUP BY 1) AS m JOIN cells USING (cell_id)""")
def _(t):
    return M.map_figures(M.period_mean(t.obs, "tasmax", 1995, 2001, (6, 7, 8)), t.cells, "tasmax")


# --- regions -----------------------------------------------------------------------

IN_REGION = """SELECT region, cell_id, ANY_VALUE(COS(RADIANS(lat))) AS w FROM cells JOIN ring_edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat-y1)/(y2-y1)*(x2-x1)
 GROUP BY cell_id, region HAVING COUNT(*) % 2 = 1"""
VALID = "SELECT source, cell_id FROM daily GROUP BY 1, 2 HAVING COUNT({n}) >= 0.5*COUNT(*)"


def region_daily(n, table="daily"):
    return f"""SELECT source, region, day, SUM(CASE WHEN {n} IS NOT NULL THEN w*{n} END)/SUM(CASE WHEN {n} IS NOT NULL THEN w END) AS v, MAX({n}) AS top FROM {table} JOIN member USING (cell_id)
 JOIN ({VALID.format(n=n)}) AS ok USING (source, cell_id) GROUP BY 1, 2, 3"""


def members(t):
    return R.members(t.cells, P.in_region(t.cells, t.ring_edges))


def region_series(t, name):
    return R.daily_mean(t.daily, members(t), name, 0.5)


@query("reg1_4_region_daily", "source:s region:i day:d tas:3 tas_max:f", "SELECT source, region, day, v AS tas, top AS tas_max FROM rd", member=IN_REGION, rd=region_daily("tas"))
def _(t):
    return region_series(t, "tas")


SEASON = "CASE (MONTH(day) % 12) // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END"


def yearly(agg, rd="rd"):
    return f"""SELECT source, region, YEAR(day) AS year, 'year' AS season, {agg}(v) AS value, COUNT(v) AS days FROM {rd} GROUP BY 1, 2, 3
 UNION ALL SELECT source, region, YEAR(day) + MONTH(day)//12, {SEASON}, {agg}(v), COUNT(v) FROM {rd} GROUP BY 1, 2, 3, 4"""


@query("reg2_years_and_seasons", "variable:s source:s region:i year:i season:s value:3 days:i",
       f"SELECT 'tas' AS variable, * FROM ({yearly('AVG')}) AS a UNION ALL SELECT 'pr', * FROM ({yearly('SUM', 'rp')}) AS b", member=IN_REGION, rd=region_daily("tas"), rp=region_daily("pr"))
def _(t):
    a = R.yearly_and_seasonal(region_series(t, "tas"), "tas", False).withColumn("variable", F.lit("tas"))
    return a.unionByName(R.yearly_and_seasonal(region_series(t, "pr"), "pr", True).withColumn("variable", F.lit("pr")))


@query("reg3_indicators", "source:s region:i year:i tx35:3 tn20:3 frost:3 txx:3 rain:3 rx1day:3", """
 SELECT source, region, year, SUM(w*tx35)/SUM(w) AS tx35, SUM(w*tn20)/SUM(w) AS tn20, SUM(w*frost)/SUM(w) AS frost, SUM(w*txx)/SUM(w) AS txx, SUM(w*rain)/SUM(w) AS rain, SUM(w*rx)/SUM(w) AS rx1day FROM (
  SELECT source, cell_id, YEAR(day) AS year, SUM(CASE WHEN tasmax >= 35 THEN 1.0 ELSE 0 END) AS tx35, SUM(CASE WHEN tasmin > 20 THEN 1.0 ELSE 0 END) AS tn20,
   SUM(CASE WHEN tasmin < 0 THEN 1.0 ELSE 0 END) AS frost, MAX(tasmax) AS txx, SUM(pr) AS rain, MAX(pr) AS rx FROM daily JOIN (""" + VALID.format(n="tasmax") + """) AS ok USING (source, cell_id) GROUP BY 1, 2, 3) AS c
 JOIN member USING (cell_id) GROUP BY 1, 2, 3""", member=IN_REGION)
def _(t):
    return R.indicators(t.daily, members(t), share=0.5)


YEAR_TAS = "SELECT source, cell_id, YEAR(day) AS year, AVG(tas) AS value FROM daily GROUP BY 1, 2, 3"
KEYS = ["source", "cell_id"]


def year_tas(t):
    return t.daily.groupBy(*KEYS, F.year("day").alias("year")).agg(F.avg("tas").alias("value"))


SMOOTHED = """SELECT a.source, a.cell_id, a.year, CASE WHEN COUNT(b.value) = 4 THEN AVG(b.value) END AS smooth FROM y AS a JOIN y AS b ON b.source = a.source AND b.cell_id = a.cell_id
 AND b.year BETWEEN a.year - 2 AND a.year + 1 GROUP BY 1, 2, 3"""


@query("reg5_centred_mean", "source:s cell_id:i year:i smooth:3", "SELECT * FROM sm", y=YEAR_TAS, sm=SMOOTHED)
def _(t):
    return R.centred_mean(year_tas(t), KEYS, width=4)


ANOM = "SELECT source, cell_id, year, value, value - AVG(CASE WHEN year BETWEEN 1995 AND 1999 THEN value END) OVER (PARTITION BY source, cell_id) AS anomaly FROM y"


@query("reg6_warming_levels", "source:s cell_id:i level_1:f level_2:f level_3:f highest:3", """
 SELECT source, cell_id, MIN(CASE WHEN smooth >= 0.1 - 0.000000001 THEN year END) AS level_1, MIN(CASE WHEN smooth >= 1.0 - 0.000000001 THEN year END) AS level_2,
  MIN(CASE WHEN smooth >= 2.0 - 0.000000001 THEN year END) AS level_3, MAX(smooth) AS highest FROM sm GROUP BY 1, 2""",
       y=YEAR_TAS, an=ANOM, sm=SMOOTHED.replace("b.value", "b.anomaly").replace("FROM y AS a JOIN y AS b", "FROM an AS a JOIN an AS b"))
def _(t):
    a = R.anomalies(year_tas(t), KEYS, 1995, 1999)
    return R.warming_levels(R.centred_mean(a, KEYS, "anomaly", 4), KEYS, (0.1, 1.0, 2.0))


@query("reg7_anomalies", "source:s cell_id:i year:i anomaly:3", "SELECT source, cell_id, year, anomaly FROM an", y=YEAR_TAS, an=ANOM)
def _(t):
    return R.anomalies(year_tas(t), KEYS, 1995, 1999)


@query("reg8_trend", "source:s cell_id:i per_decade:3 years:i", "SELECT source, cell_id, 10*REGR_SLOPE(value, year) AS per_decade, COUNT(value) AS years FROM y GROUP BY 1, 2", y=YEAR_TAS)
def _(t):
    return R.trend(year_tas(t), KEYS)


@query("reg9_summer_figures", "source:s cell_id:i mean:3 p90:3 p99:3 hot_days:i", """
 SELECT source, cell_id, AVG(tasmax) AS mean, QUANTILE_CONT(tasmax, 0.9) AS p90, QUANTILE_CONT(tasmax, 0.99) AS p99, SUM(CASE WHEN tasmax >= 30 THEN 1 ELSE 0 END) AS hot_days
 FROM daily WHERE MONTH(day) IN (6, 7, 8) GROUP BY 1, 2""")
def _(t):
    return R.summer_figures(t.daily, KEYS, "tasmax")


@query("reg10_years_from_months", "source:s cell_id:i year:i annual:3 jja:3", """
 SELECT source, cell_id, year, SUM(v*d)/SUM(d) AS annual, SUM(CASE WHEN month IN (6, 7, 8) THEN v*d END)/SUM(CASE WHEN month IN (6, 7, 8) THEN d END) AS jja FROM (
  SELECT source, cell_id, YEAR(day) AS year, MONTH(day) AS month, AVG(tas) AS v, DAY(LAST_DAY(MIN(day))) AS d FROM daily GROUP BY 1, 2, 3, 4) AS m WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) = 12""")
def _(t):
    m = t.daily.groupBy(*KEYS, F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("tas").alias("value"))
    return R.from_months(m, KEYS)


@query("reg11_lag_behind", "source:s cell_id:i from_year:i to_year:i lag:3", """
 SELECT s.source, s.cell_id, a AS from_year, b AS to_year, (AVG(CASE WHEN s.year BETWEEN 2000 AND 2001 THEN s.value END) - AVG(CASE WHEN s.year BETWEEN a AND b THEN s.value END))
  - (AVG(CASE WHEN o.year BETWEEN 2000 AND 2001 THEN o.value END) - AVG(CASE WHEN o.year BETWEEN a AND b THEN o.value END)) AS lag
 FROM y AS s JOIN y AS o ON o.source = 'obs' AND o.cell_id = s.cell_id AND o.year = s.year CROSS JOIN (VALUES (1995, 1997), (1996, 1999)) AS c(a, b)
 WHERE s.source = 'sim' GROUP BY 1, 2, 3, 4""", y=YEAR_TAS)
def _(t):
    return R.lag_behind(year_tas(t), ["cell_id"], "obs", (2000, 2001), ((1995, 1997), (1996, 1999)))


@query("reg15_annual_maximum", "source:s cell_id:i year:i value:f", "SELECT source, cell_id, YEAR(day) AS year, MAX(tasmax) AS value FROM daily GROUP BY 1, 2, 3")
def _(t):
    return R.annual_maximum(t.daily, KEYS)


# --- heat waves: on each cell's own series, thresholds loosened to the short sample ------------

HEAT_LIMITS = """SELECT source, cell_id, QUANTILE_CONT(v, 0.9) AS s1, QUANTILE_CONT(v, 0.7) AS s2, QUANTILE_CONT(v, 0.6) AS s3 FROM hv WHERE YEAR(day) BETWEEN 1995 AND 2001 GROUP BY 1, 2"""
EPISODES = """SELECT source, cell_id, first_day, last_day, DATE_DIFF('day', first_day, last_day) + 1 AS days, peak FROM (
  SELECT source, cell_id, MIN(CASE WHEN v >= s2 THEN day END) AS first_day, MAX(CASE WHEN v >= s2 THEN day END) AS last_day, MAX(v) AS peak, ANY_VALUE(s1) AS s1 FROM (
   SELECT *, DATE_DIFF('day', DATE '1990-01-01', day) - ROW_NUMBER() OVER (PARTITION BY source, cell_id ORDER BY day) AS g FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY source, cell_id, island) AS len FROM (
     SELECT *, CASE WHEN v < s2 THEN 'L' || (DATE_DIFF('day', DATE '1990-01-01', day) - ROW_NUMBER() OVER (PARTITION BY source, cell_id, v < s2 ORDER BY day)) ELSE 'H' || day END AS island
     FROM hv JOIN limits USING (source, cell_id) WHERE v IS NOT NULL) AS a) AS b WHERE v >= s3 AND NOT (v < s2 AND len >= 3)) AS c GROUP BY source, cell_id, g) AS e
 WHERE peak > s1 AND DATE_DIFF('day', first_day, last_day) + 1 >= 3"""
HEAT_PARTS = dict(hv="SELECT source, cell_id, day, (tasmax + tasmin)/2 AS v FROM daily", limits=HEAT_LIMITS, ep=EPISODES)


def heat(t):
    s = t.daily.select(*KEYS, "day", ((F.col("tasmax") + F.col("tasmin")) / 2).alias("v"))
    return HW.episodes(s, HW.thresholds(s, "v", KEYS, 1995, 2001, (0.9, 0.7, 0.6)), "v", KEYS)


@query("reg12_heat_waves", "source:s cell_id:i first_day:d last_day:d days:i peak:3", "SELECT * FROM ep", headline=True, **HEAT_PARTS)
def _(t):
    return heat(t)


@query("reg13_heat_wave_days", "source:s cell_id:i year:i days:i", """
 SELECT source, cell_id, YEAR(d) AS year, COUNT(*) AS days FROM (SELECT source, cell_id, UNNEST(GENERATE_SERIES(first_day, last_day, INTERVAL 1 DAY)) AS d FROM ep) AS x GROUP BY 1, 2, 3""", **HEAT_PARTS)
def _(t):
    return HW.days_per_year(heat(t), KEYS)


# --- indices -----------------------------------------------------------------------------

@query("idx1_yearly_indices", "source:s cell_id:i days_over_25:3 days_over_30:3 hottest:3 tropical_nights:3 frost_days:3 coldest:3 rain:3 wet_days:3 rx1day:3", """
 SELECT source, cell_id, AVG(a) AS days_over_25, AVG(b) AS days_over_30, AVG(c) AS hottest, AVG(d) AS tropical_nights, AVG(e) AS frost_days, AVG(f) AS coldest, AVG(g) AS rain, AVG(h) AS wet_days, AVG(i) AS rx1day FROM (
  SELECT source, cell_id, YEAR(day) AS year, SUM(CASE WHEN tasmax > 25 THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN tasmax > 30 THEN 1 ELSE 0 END) AS b, MAX(tasmax) AS c, SUM(CASE WHEN tasmin > 20 THEN 1 ELSE 0 END) AS d,
   SUM(CASE WHEN tasmin < 0 THEN 1 ELSE 0 END) AS e, MIN(tasmin) AS f, SUM(pr) AS g, SUM(CASE WHEN pr >= 1 THEN 1 ELSE 0 END) AS h, MAX(pr) AS i FROM daily GROUP BY 1, 2, 3) AS y GROUP BY 1, 2""")
def _(t):
    return I.over_years(I.yearly(t.daily))


@query("idx2_five_day_rain", "source:s cell_id:i year:i value:1", """
 SELECT source, cell_id, YEAR(day) AS year, MAX(CASE WHEN n = 5 THEN s END) AS value FROM (SELECT *, COUNT(pr) OVER w AS n, SUM(pr) OVER w AS s FROM daily
  WINDOW w AS (PARTITION BY source, cell_id, YEAR(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS x GROUP BY 1, 2, 3""")
def _(t):
    return I.rain_of_days(t.daily)


RUNS = """SELECT source, cell_id, {k}, COUNT(*) AS len FROM (SELECT *, DATE_DIFF('day', DATE '1990-01-01', day) - ROW_NUMBER() OVER (PARTITION BY source, cell_id, {k} ORDER BY day) AS g FROM (
  SELECT *, YEAR(day) AS year, """ + SEASON + """ AS season, YEAR(day) + MONTH(day)//12 AS season_year FROM daily) AS d WHERE pr < 1) AS x GROUP BY source, cell_id, {k}, g"""


@query("idx3_longest_dry_run", "source:s cell_id:i year:i days:i runs:i longest:i mean_length:3", """
 SELECT k.source, k.cell_id, k.year, COALESCE(SUM(len), 0) AS days, COUNT(len) AS runs, COALESCE(MAX(len), 0) AS longest, COALESCE(SUM(len)/NULLIF(COUNT(len), 0), 0) AS mean_length
 FROM (SELECT DISTINCT source, cell_id, YEAR(day) AS year FROM daily) AS k LEFT JOIN runs AS r ON r.source = k.source AND r.cell_id = k.cell_id AND r.year = k.year GROUP BY 1, 2, 3""", runs=RUNS.format(k="year"))
def _(t):
    return I.runs_per_year(t.daily, F.col("pr") < 1)


@query("idx4_dry_spells", "source:s cell_id:i season:s mean_length:3 longest:3", f"""
 SELECT source, cell_id, season, COALESCE(SUM(d)/NULLIF(SUM(n), 0), 0) AS mean_length, AVG(m) AS longest FROM (SELECT k.*, COALESCE(SUM(len), 0) AS d, COUNT(len) AS n, COALESCE(MAX(len), 0) AS m
  FROM (SELECT DISTINCT source, cell_id, {SEASON} AS season, YEAR(day) + MONTH(day)//12 AS season_year FROM daily) AS k LEFT JOIN runs AS r USING (source, cell_id, season, season_year)
  WHERE season_year <= 2033 AND (season <> 'DJF' OR season_year > 1995) GROUP BY ALL) AS s GROUP BY 1, 2, 3""", runs=RUNS.format(k="season, season_year"))
def _(t):
    return I.dry_spells(t.daily, first_year=1995, last_year=2033)


@query("idx5_persistence", "source:s cell_id:i persistence:4 pairs:i", """
 SELECT a.source, a.cell_id, SUM(a.v*b.v)/SQRT(SUM(a.v*a.v)*SUM(b.v*b.v)) AS persistence, COUNT(*) AS pairs FROM an AS a JOIN an AS b ON b.source = a.source AND b.cell_id = a.cell_id
 AND b.day = a.day + 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2""", an="SELECT source, cell_id, day, tas - AVG(tas) OVER (PARTITION BY source, cell_id, MONTH(day)) AS v FROM daily")
def _(t):
    return I.persistence(t.daily, "tas")
