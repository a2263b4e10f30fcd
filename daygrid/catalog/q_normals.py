"""Queries: normals, climate diagrams, every year, summaries, kinds of seasons."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.catalog.q_days import accepted, located
from daygrid.catalog.q_grid import PLACE_PARTS
from daygrid.catalog.q_days import STATUS
from daygrid.functions.calendar import season_requests
from daygrid.operators import climate as C
from daygrid.operators import normals as N
from daygrid.operators import years as Y

SLOT = "DATE_DIFF('day', DATE '2000-01-01', MAKE_DATE(2000, MONTH({d}), DAY({d})))"
SUMS = f"""SELECT cell_id, {SLOT.format(d='day')} AS slot, SUM(tasmax) AS s1, COUNT(tasmax) AS n1, SUM(tasmin) AS s2, COUNT(tasmin) AS n2, SUM(pr) AS s3, COUNT(pr) AS n3,
  MIN(hurs) AS lo, MAX(hurs) AS hi, SUM(hurs) AS s4, COUNT(hurs) AS n4 FROM obs GROUP BY 1, 2"""
POOLED = """SELECT a.cell_id, a.slot, SUM(b.s1)/NULLIF(SUM(b.n1), 0) AS tasmax, SUM(b.s2)/NULLIF(SUM(b.n2), 0) AS tasmin, SUM(b.s3)/NULLIF(SUM(b.n3), 0) AS pr,
  SUM(b.s4)/NULLIF(SUM(b.n4), 0) AS hurs, MIN(b.lo) AS hurs_min, MAX(b.hi) AS hurs_max FROM sums AS a JOIN sums AS b ON a.cell_id = b.cell_id
 AND (a.slot - b.slot + 366 + 7) % 366 <= 14 GROUP BY 1, 2"""


def pooled(t):
    return N.pooled(t.obs, ("tasmax", "tasmin", "pr"), ["cell_id"], extremes=("hurs",))


@query("norm1_2_pooled_normals", "cell_id:i slot:i tasmax:3 tasmin:3 pr:3 hurs:3 hurs_min:f hurs_max:f", "SELECT * FROM pooled",
       headline=True, sums=SUMS, pooled=POOLED)
def _(t):
    return pooled(t)


ASKED = "SELECT s.search_id, l.cell_id, s.source, s.first_day, s.last_day FROM status AS s JOIN located AS l ON l.place_id = s.place_id WHERE status = 'ok'"


def asked(t):
    at = located(t)
    return accepted(t, at).select("search_id", "cell_id", "source", "first_day", "last_day")


@query("norm3_normals_of_searches", "search_id:i day:d tasmax:3 tasmin:3 pr:3", f"""
 SELECT search_id, CAST(d AS DATE) AS day, tasmax, tasmin, pr FROM (
  SELECT search_id, cell_id, UNNEST(GENERATE_SERIES(first_day, last_day, INTERVAL 1 DAY)) AS d FROM asked) AS a LEFT JOIN pooled AS p
  ON p.cell_id = a.cell_id AND p.slot = {SLOT.format(d='d')}""", **PLACE_PARTS, status=STATUS, asked=ASKED, sums=SUMS, pooled=POOLED)
def _(t):
    return N.of_ranges(pooled(t), asked(t), "search_id", ["cell_id"], ["tasmax", "tasmin", "pr"], 9)


SLOT365 = "CASE WHEN MONTH(day) = 2 AND DAY(day) = 29 THEN 58 ELSE DATE_DIFF('day', DATE '2001-01-01', MAKE_DATE(2001, MONTH(day), DAY(day))) END"
SMOOTH = f"""SELECT a.cell_id, a.slot, CASE WHEN COUNT(b.m) = 31 THEN AVG(b.m) END AS normal FROM per_slot AS a JOIN per_slot AS b ON a.cell_id = b.cell_id
 AND (a.slot - b.slot + 365 + 15) % 365 <= 30 GROUP BY 1, 2"""
PER_SLOT = f"SELECT cell_id, {SLOT365} AS slot, AVG(hurs) AS m FROM obs WHERE YEAR(day) BETWEEN 1995 AND 2001 GROUP BY 1, 2"


@query("norm4_smoothed_normals", "cell_id:i slot:i normal:3", "SELECT * FROM smooth", per_slot=PER_SLOT, smooth=SMOOTH)
def _(t):
    return N.smoothed(t.obs, "hurs", ["cell_id"], 1995, 2001)


@query("norm5_departures", "source:s cell_id:i day:d anomaly:f", f"""
 SELECT d.source, d.cell_id, d.day, ROUND_EVEN(ROUND(hurs - normal, 9), 0) AS anomaly FROM (SELECT *, {SLOT365} AS slot FROM daily) AS d
 LEFT JOIN smooth AS s ON s.cell_id = d.cell_id AND s.slot = d.slot""", per_slot=PER_SLOT, smooth=SMOOTH)
def _(t):
    base = N.smoothed(t.obs, "hurs", ["cell_id"], 1995, 2001)
    return N.departure(t.daily, base, "hurs", ["cell_id"])


# --- climate diagram ---------------------------------------------------------------

def _diagram(group, where, years):
    return f"""SELECT {group}, MONTH(day) AS month, AVG(tas) AS tas, AVG(tasmin) AS tasmin, AVG(tasmax) AS tasmax, AVG(pr)*(COUNT(*)/{years}) AS precipitation,
  AVG(pr)*(COUNT(*)/{years}) <= 2*AVG(tas) AS dry FROM daily WHERE {where} GROUP BY ALL"""


OBS_MONTHS = _diagram("cell_id", "source = 'obs'", "7.0")


@query("clim1_monthly_diagram", "cell_id:i month:i tas:3 tasmin:3 tasmax:3 precipitation:3 dry:b", "SELECT * FROM months", months=OBS_MONTHS)
def _(t):
    return C.diagram(C.month_sums(t.obs, ["cell_id"]), ["cell_id"], 7)


@query("clim2_window_beside_reference", "search_id:i which:s month:i tas:3 precipitation:3 dry:b", """
 SELECT search_id, 'window' AS which, month, SUM(s)/NULLIF(SUM(n), 0) AS tas, SUM(p)/NULLIF(SUM(k), 0)*(SUM(c)/5.0) AS precipitation,
  SUM(p)/NULLIF(SUM(k), 0)*(SUM(c)/5.0) <= 2*(SUM(s)/NULLIF(SUM(n), 0)) AS dry FROM wins AS w JOIN ms ON ms.source = w.source AND ms.cell_id = w.cell_id AND ms.year BETWEEN a AND a + 4 GROUP BY 1, 3
 UNION ALL SELECT search_id, 'reference', month, tas, precipitation, dry FROM wins JOIN months USING (cell_id)""",
       **PLACE_PARTS, status=STATUS, asked=ASKED, months=OBS_MONTHS,
       ms="SELECT source, cell_id, YEAR(day) AS year, MONTH(day) AS month, SUM(tas) AS s, COUNT(tas) AS n, SUM(pr) AS p, COUNT(pr) AS k, COUNT(*) AS c FROM daily GROUP BY 1, 2, 3, 4",
       wins="""SELECT search_id, cell_id, p.source, LEAST(GREATEST(mid - 2, YEAR(p.first_day)), YEAR(p.last_day) - 4) AS a FROM (
  SELECT *, YEAR(CAST(first_day + CAST(FLOOR(DATE_DIFF('day', first_day, last_day)/2) AS INTEGER) AS DATE)) AS mid FROM asked) AS x
  JOIN periods AS p ON mid BETWEEN YEAR(p.first_day) AND YEAR(p.last_day)""")
def _(t):
    from daygrid.functions.calendar import mid_year
    sums = C.month_sums(t.daily, ["source", "cell_id"])
    q = asked(t).withColumn("mid", mid_year("first_day", "last_day")).drop("source", "first_day", "last_day")
    w = C.windows(q, t.periods, "mid", 5)
    own = C.window_diagram(sums, w, ["source", "cell_id"], "search_id").withColumn("which", F.lit("window"))
    ref = C.diagram(sums.filter("source = 'obs'"), ["cell_id"], 7)
    ref = w.select("search_id", "cell_id").join(ref, "cell_id").drop("cell_id").withColumn("which", F.lit("reference"))
    return own.unionByName(ref)


@query("clim3_annual_line", "source:s cell_id:i year:i temperature:3 rain:3 dry:s", """
 SELECT source, cell_id, year, CASE WHEN COUNT(tas) = 12 THEN SUM(tas)/12 END AS temperature, CASE WHEN COUNT(precipitation) = 12 THEN SUM(precipitation) END AS rain,
  COALESCE(STRING_AGG(CAST(month AS VARCHAR), ',' ORDER BY month) FILTER (dry), '') AS dry FROM m GROUP BY 1, 2, 3""",
       m=_diagram("source, cell_id, YEAR(day) AS year", "TRUE", "1.0"))
def _(t):
    keys = ["source", "cell_id", "year"]
    m = C.month_sums(t.daily, ["source", "cell_id"])
    return C.annual_line(C.diagram(m, keys, 1), keys).withColumn("dry", F.concat_ws(",", F.transform(
        "dry_months", lambda v: v.cast("string"))))


@query("clim4_axis_window", "cell_id:i bottom:1 top:1 label_top:1", """
 SELECT cell_id, LEAST(0.0, FLOOR(LEAST(MIN(tas), 0)/5)*5) AS bottom, GREATEST(20.0, CEIL(GREATEST(MAX(tas), MAX(precipitation/2), 0)/10)*10) AS top,
  GREATEST(10.0, CEIL(GREATEST(MAX(tas), 0)/10)*10) AS label_top FROM months GROUP BY 1""", months=OBS_MONTHS)
def _(t):
    return C.axis_window(C.diagram(C.month_sums(t.obs, ["cell_id"]), ["cell_id"], 7), ["cell_id"])


# --- every year ---------------------------------------------------------------------

DATED = """SELECT search_id, cell_id, y AS year, y0, CAST(first_day + TO_YEARS(CAST(y - y0 AS INTEGER)) AS DATE) AS a, CAST(last_day + TO_YEARS(CAST(y - y0 AS INTEGER)) AS DATE) AS b
 FROM (SELECT search_id, cell_id, first_day, last_day, YEAR(first_day) AS y0, UNNEST(GENERATE_SERIES(1995, 2033)) AS y FROM asked) AS x"""
FIGS = """SELECT search_id, year, ANY_VALUE(y0) AS y0, source, COUNT(*) AS days, AVG(tasmax) AS tasmax_mean, SUM(CAST(ROUND(tasmax*1000000) AS BIGINT))/COUNT(tasmax)/1000000.0 AS exact_mean, AVG(tas) AS tas_mean, AVG(pr)*COUNT(*) AS precipitation,
  SUM(CASE WHEN tasmax >= 35 THEN 1 ELSE 0 END)*COUNT(*)/NULLIF(COUNT(tasmax), 0) AS hot_35, SUM(CASE WHEN tasmax >= 40 THEN 1 ELSE 0 END)*COUNT(*)/NULLIF(COUNT(tasmax), 0) AS hot_40,
  SUM(CASE WHEN tasmin > 20 THEN 1 ELSE 0 END)*COUNT(*)/NULLIF(COUNT(tasmin), 0) AS tropical_nights, SUM(CASE WHEN tasmax > 25 THEN 1 ELSE 0 END)*COUNT(*)/NULLIF(COUNT(tasmax), 0) AS summer_days,
  SUM(CASE WHEN tasmin < 0 THEN 1 ELSE 0 END)*COUNT(*)/NULLIF(COUNT(tasmin), 0) AS frost_days FROM (
   SELECT search_id, cell_id, year, y0, source, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM dated JOIN periods AS p ON a >= p.first_day AND b <= p.last_day) AS e
  JOIN daily USING (source, cell_id, day) GROUP BY search_id, year, source"""
YEAR_PARTS = dict(**PLACE_PARTS, status=STATUS, asked=ASKED, dated=DATED, figs=FIGS)
FIRST, LAST = 1995, 2033
REF, SPAN = 1995, 7


def figures(t):
    q = asked(t).drop("source").withColumn("shown", F.year("first_day"))
    return Y.year_figures(q, t.daily, t.periods, FIRST, LAST)


@query("year1_2_same_dates", "search_id:i year:i first_day:d last_day:d source:s tas_mean:3 precipitation:3 hot_35:3 frost_days:3", """
 SELECT d.search_id, d.year, a AS first_day, b AS last_day, f.source, tas_mean, precipitation, hot_35, frost_days
 FROM dated AS d LEFT JOIN figs AS f ON f.search_id = d.search_id AND f.year = d.year""", **YEAR_PARTS)
def _(t):
    return figures(t)


@query("year3_against_reference",
       "search_id:i year:i temperature_anomaly:2 temperature_sigmas:2 temperature_class:s precipitation_ratio:2 precipitation_class:s", """
 SELECT search_id, year, anomaly AS temperature_anomaly, s AS temperature_sigmas, CASE WHEN ABS(s) < 0.5 THEN 'near' WHEN s >= 1.5 THEN 'much_warmer' WHEN s <= -1.5 THEN 'much_colder'
   WHEN s > 0 THEN 'warmer' WHEN s < 0 THEN 'colder' END AS temperature_class, r AS precipitation_ratio,
  CASE WHEN r < 0.5 THEN 'much_drier' WHEN r < 0.8 THEN 'drier' WHEN r <= 1.2 THEN 'near' WHEN r <= 1.5 THEN 'wetter' WHEN r IS NOT NULL THEN 'much_wetter' END AS precipitation_class FROM (
  SELECT f.*, tas_mean - tn AS anomaly, CASE WHEN sd > 0.000000001 THEN ROUND((tas_mean - tn)/sd, 9) END AS s, CASE WHEN pn <> 0 THEN ROUND(precipitation/pn, 9) END AS r FROM figs AS f LEFT JOIN (
   SELECT search_id, AVG(tas_mean) AS tn, STDDEV_SAMP(tas_mean) AS sd, AVG(precipitation) AS pn FROM figs WHERE year BETWEEN 1995 AND 2001 GROUP BY 1) AS n USING (search_id)) AS x""",
       headline=True, **YEAR_PARTS)
def _(t):
    return Y.compare(figures(t).filter("source IS NOT NULL"), "search_id", REF, SPAN)


@query("summ1_2_summary", "search_id:i figure:s value:3 normal:3", " UNION ALL ".join(
    f"""SELECT search_id, '{n}' AS figure, MAX(CASE WHEN year = y0 THEN {n} END) AS value, AVG(CASE WHEN source = 'obs' THEN {n} END) AS normal FROM figs GROUP BY search_id"""
    for n in Y.FIGURES), **YEAR_PARTS)
def _(t):
    return Y.summary(figures(t), "search_id", F.col("shown"), REF, SPAN, "obs")


@query("summ3_rank", "search_id:i first:i last:i total:i warmer:i named:s", """
 SELECT f.search_id, MIN(f.year) AS first, MAX(f.year) AS last, COUNT(*) AS total, SUM(CASE WHEN f.tasmax_mean > v THEN 1 ELSE 0 END) AS warmer,
  CASE WHEN SUM(CASE WHEN f.tasmax_mean > v THEN 1 ELSE 0 END) <= 3 THEN COALESCE(STRING_AGG(CAST(f.year AS VARCHAR), ',' ORDER BY f.year) FILTER (f.tasmax_mean > v), '') ELSE '' END AS named
 FROM figs AS f JOIN (SELECT search_id, tasmax_mean + 0.000000001 AS v FROM figs WHERE year = y0 AND tasmax_mean IS NOT NULL) AS o ON o.search_id = f.search_id
 WHERE f.source = 'obs' AND f.year <> f.y0 AND f.tasmax_mean IS NOT NULL GROUP BY f.search_id""", **YEAR_PARTS)
def _(t):
    r = Y.rank(figures(t), "search_id", F.col("shown"), "obs")
    return r.withColumn("named", F.concat_ws(",", F.transform("warmer_years", lambda v: v.cast("string"))))


@query("api3_text_summary", "search_id:i sentence:s", """
 SELECT v.search_id, v.first_day || ' / ' || v.last_day || COALESCE(' : mean maximum ' || PRINTF('%.1f', a.value) || ' °C', '') ||
  CASE WHEN ROUND_EVEN(h.value, 0) > 0 THEN ', ' || CAST(ROUND_EVEN(h.value, 0) AS BIGINT) || ' day(s) at 35 °C or more' WHEN ROUND_EVEN(f.value, 0) > 0 THEN
   ', ' || CAST(ROUND_EVEN(f.value, 0) AS BIGINT) || ' day(s) of frost' ELSE '' END AS sentence
 FROM asked AS v JOIN (SELECT search_id, ROUND_EVEN(ROUND(MAX(CASE WHEN year = y0 THEN tasmax_mean END), 9), 1) AS value FROM figs GROUP BY 1) AS a USING (search_id)
 JOIN (SELECT search_id, MAX(CASE WHEN year = y0 THEN hot_35 END) AS value FROM figs GROUP BY 1) AS h USING (search_id)
 JOIN (SELECT search_id, MAX(CASE WHEN year = y0 THEN frost_days END) AS value FROM figs GROUP BY 1) AS f USING (search_id)""", **YEAR_PARTS)
def _(t):
    from daygrid.plans.batch import sentences
    s = Y.summary(figures(t), "search_id", F.col("shown"), REF, SPAN, "obs")
    return sentences(s, asked(t), "search_id")


PAGE_TEXT_SQL = """SELECT search_id, title, title || CASE WHEN tx IS NOT NULL OR hot > 0 OR frost > 0 THEN ': ' || CONCAT_WS(', ',
   'mean maximum ' || PRINTF('%.1f', ROUND_EVEN(ROUND(tx, 9), 1)) || ' °C' || CASE WHEN normal IS NULL THEN '' ELSE ' (' || CASE WHEN gap >= 0 THEN '+' ELSE '-' END
    || PRINTF('%.1f', ABS(gap)) || ' °C against 1995-2001)' END,
   CASE WHEN hot > 0 THEN hot || CASE WHEN hot > 1 THEN ' days' ELSE ' day' END || ' at 35 °C or more' WHEN frost > 0 THEN frost || CASE WHEN frost > 1 THEN ' days' ELSE ' day' END || ' of frost' END)
  ELSE '' END || '.' || CASE WHEN source = 'sim' THEN ' Simulation: plausible weather, not a forecast.' ELSE '' END AS sentence
 FROM (SELECT a.search_id, a.source, CASE WHEN word IS NOT NULL AND DAY(a.last_day) = 20 AND (MONTH(a.last_day) - MONTH(a.first_day) + 12) % 12 = 3 AND YEAR(a.last_day) - YEAR(a.first_day) <= 1
    THEN word || ' ' || YEAR(a.first_day) || CASE WHEN YEAR(a.last_day) > YEAR(a.first_day) THEN '-' || YEAR(a.last_day) ELSE '' END
    ELSE CAST(a.first_day AS VARCHAR) || ' to ' || CAST(a.last_day AS VARCHAR) END || ' at ' || name AS title,
   tx, normal, ROUND_EVEN(ROUND(tx - normal, 9), 1) AS gap, CAST(ROUND_EVEN(hot, 0) AS BIGINT) AS hot, CAST(ROUND_EVEN(frost, 0) AS BIGINT) AS frost
  FROM page_asked AS a LEFT JOIN (VALUES (321, 'Spring'), (621, 'Summer'), (921, 'Autumn'), (1221, 'Winter')) AS w(start, word) ON start = MONTH(a.first_day)*100 + DAY(a.first_day)
  LEFT JOIN (SELECT search_id, MAX(CASE WHEN year = y0 THEN tasmax_mean END) AS tx, AVG(CASE WHEN source = 'obs' THEN tasmax_mean END) AS normal,
   MAX(CASE WHEN year = y0 THEN hot_35 END) AS hot, MAX(CASE WHEN year = y0 THEN frost_days END) AS frost FROM figs GROUP BY 1) AS f USING (search_id)) AS x"""
# every other search is moved to the season that its first month lies in, so that seasons are asked for as well
PAGE_ASKED = """SELECT search_id, cell_id, source, name, first_day, last_day FROM (SELECT a.search_id, a.cell_id, a.source, p.name,
  CASE WHEN a.search_id % 4 < 2 THEN MAKE_DATE(YEAR(a.first_day), 3*QUARTER(a.first_day), 21) ELSE a.first_day END AS first_day,
  CASE WHEN a.search_id % 4 < 2 THEN CAST(CAST(MAKE_DATE(YEAR(a.first_day), 3*QUARTER(a.first_day), 21) + INTERVAL 3 MONTH AS DATE) - 1 AS DATE) ELSE a.last_day END AS last_day
  FROM plain_asked AS a JOIN status AS s ON s.search_id = a.search_id JOIN places AS p ON p.place_id = s.place_id) AS x"""


@query("api3_page_text", "search_id:i title:s sentence:s", PAGE_TEXT_SQL,
       **PLACE_PARTS, status=STATUS, plain_asked=ASKED, page_asked=PAGE_ASKED, dated=DATED.replace("FROM asked", "FROM page_asked"), figs=FIGS)
def _(t):
    from daygrid.plans.batch import page_texts
    at = located(t)
    season = F.make_date(F.year("first_day"), 3 * F.quarter("first_day"), F.lit(21))
    moved = F.col("search_id") % 4 < 2
    q = accepted(t, at).join(t.places.select("place_id", "name"), "place_id").select(
        "search_id", "cell_id", "source", "name", F.when(moved, season).otherwise(F.col("first_day")).alias("first_day"),
        F.when(moved, F.date_sub(F.add_months(season, 3), 1)).otherwise(F.col("last_day")).alias("last_day"))
    figures = Y.year_figures(q.drop("source", "name").withColumn("shown", F.year("first_day")), t.daily, t.periods, FIRST, LAST)
    return page_texts(Y.summary(figures, "search_id", F.col("shown"), REF, SPAN, "obs"), q, "search_id", "1995-2001", "sim")


# --- kinds of seasons ------------------------------------------------------------------

EPOCHS = (("old", 1995, 1998), ("new", 1999, 2029), ("future", 2030, 2033))
EPOCH_SQL = "CASE WHEN year <= 1998 THEN 'old' WHEN year <= 2029 THEN 'new' ELSE 'future' END"
SEASONED = """SELECT cell_id*10 + k AS request, cell_id, season, y AS year, source, a, b FROM (
  SELECT *, MAKE_DATE(y, m, 21) AS a, CAST(CAST(MAKE_DATE(y, m, 21) + INTERVAL 3 MONTH AS DATE) - 1 AS DATE) AS b FROM (
   SELECT cell_id, source, first_day, last_day, UNNEST(GENERATE_SERIES(YEAR(first_day), YEAR(last_day))) AS y, season, m, k FROM cells CROSS JOIN periods
   CROSS JOIN (VALUES ('spring', 3, 1), ('summer', 6, 2), ('autumn', 9, 3), ('winter', 12, 4)) AS s(season, m, k)) AS x) AS z WHERE a >= first_day AND b <= last_day"""
SEASON_DAYS = "SELECT request, season, year, source, day, tasmax, tasmin FROM (SELECT *, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM seasoned) AS s JOIN daily USING (source, cell_id, day)"
SEASON_FIGS = f"SELECT request, season, year, source, {EPOCH_SQL} AS epoch, SUM(CAST(ROUND(tasmax*1000000) AS BIGINT)) AS total, COUNT(tasmax) AS known, total/known/1000000.0 AS v FROM season_days GROUP BY ALL HAVING COUNT(tasmax) > 0"
KINDS = """SELECT *, CASE WHEN 2*k >= n THEN 'normal' WHEN r <= k THEN 'cool' WHEN r > n - k THEN 'warm' ELSE 'normal' END AS kind,
  CASE WHEN lo = hi THEN CASE WHEN lo = 'sim' THEN 'simulated' ELSE 'observed' END END AS origin FROM (
  SELECT *, COUNT(*) OVER w AS n, ROW_NUMBER() OVER (PARTITION BY request, epoch ORDER BY v, year) AS r, MIN(source) OVER w AS lo, MAX(source) OVER w AS hi,
   GREATEST(1, ROUND_EVEN(0.2*COUNT(*) OVER w, 0)) AS k FROM season_figs WINDOW w AS (PARTITION BY request, epoch)) AS x"""
PEAKS = """SELECT request, epoch, ARG_MAX(year, hk) AS hot_year, ARG_MAX(day, hk) AS hot_day, MAX(tasmax) AS hot_value, ARG_MAX(year, ck) AS cold_year, ARG_MAX(day, ck) AS cold_day, MIN(tasmin) AS cold_value FROM (
  SELECT *, CASE WHEN tasmax IS NOT NULL THEN (ROUND(tasmax*100) + 100000)*1000000000.0 + year*100000.0 + (50000 - DATE_DIFF('day', DATE '1990-01-01', day)) END AS hk,
   CASE WHEN tasmin IS NOT NULL THEN (100000 - ROUND(tasmin*100))*1000000000.0 + year*100000.0 + (50000 - DATE_DIFF('day', DATE '1990-01-01', day)) END AS ck,
   """ + EPOCH_SQL + """ AS epoch FROM season_days) AS d GROUP BY 1, 2"""
#: Means to one decimal from whole numbers: the rest decides, and a half goes to the even tenth.
SERVED_FIGS = """SELECT * REPLACE ((below + CASE WHEN 2*rest > parts OR (2*rest = parts AND below % 2 <> 0) THEN 1 ELSE 0 END)/10.0 AS v) FROM (
 SELECT *, (total - rest)//parts AS below FROM (SELECT *, known*100000 AS parts, ((total % (known*100000)) + known*100000) % (known*100000) AS rest FROM season_figs) AS x) AS y"""
KIND_PARTS = dict(seasoned=SEASONED, season_days=SEASON_DAYS, season_figs=SEASON_FIGS, served_figs=SERVED_FIGS, kinds=KINDS, peaks=PEAKS)


def season_table(t):
    """Each cell's four seasons, as the season of one year: the other years follow by their dates."""
    names = F.expr("CASE season WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 WHEN 'autumn' THEN 3 ELSE 4 END")
    one = season_requests(t.cells.select("cell_id", "lat"), t.periods.filter("source = 'obs'")).filter("year = 1996")
    return one.select((F.col("cell_id") * 10 + names).alias("request"), "cell_id", "season", "first_day", "last_day")


def season_kinds(t):
    f = Y.year_figures(season_table(t), t.daily, t.periods, FIRST, LAST)
    return Y.kinds(f, "request", EPOCHS, simulated="sim")


def season_peaks(t):
    d = Y.cut_days(season_table(t), t.daily, t.periods, FIRST, LAST, "request", ["tasmax", "tasmin"])
    return Y.extreme_days(d, "request", EPOCHS)


@query("kind1_2_season_kinds", "request:i season:s epoch:s year:i kind:s origin:s tasmax_mean:3", """
 SELECT request, season, epoch, year, kind, origin, v AS tasmax_mean FROM kinds""", **KIND_PARTS)
def _(t):
    return season_kinds(t)


@query("kind3_extreme_days", "request:i epoch:s hot_year:i hot_day:d hot_value:1 cold_year:i cold_day:d cold_value:1", """
 SELECT * REPLACE (ROUND_EVEN(hot_value, 1) AS hot_value, ROUND_EVEN(cold_value, 1) AS cold_value) FROM peaks""", **KIND_PARTS)
def _(t):
    return season_peaks(t)


@query("kind4_records", "request:i epoch:s record_year:i record_value:3", """
 SELECT request, epoch, year AS record_year, v AS record_value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request, epoch ORDER BY v DESC, year DESC) AS q FROM served_figs) AS x WHERE q = 1""",
       **KIND_PARTS)
def _(t):
    return Y.records(season_kinds(t), "request")


@query("kind4_another_of_kind", "request:i epoch:s kind:s year:i", """
 SELECT request, epoch, kind, year FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request, epoch, kind ORDER BY MD5('0:' || request || ':' || epoch || ':' || year)) AS pick
  FROM kinds WHERE year <> 1997) AS x WHERE pick = 1""", **KIND_PARTS)
def _(t):
    return Y.another(season_kinds(t), "request", F.lit(1997))


@query("kind5_typical_year", "request:i year:i value:3 mean:3", """
 SELECT request, year, v AS value, m AS mean FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request ORDER BY FLOOR(ABS(v - m)*1000000000 + 0.5), year DESC) AS q FROM (
  SELECT *, AVG(v) OVER (PARTITION BY request) AS m, COUNT(*) OVER (PARTITION BY request) AS n FROM served_figs WHERE year BETWEEN 2027 AND 2033) AS a WHERE n >= 5 AND year <> 2030) AS b WHERE q = 1""",
       **KIND_PARTS)
def _(t):
    return Y.typical(season_kinds(t), "request", 2027, 2033, F.lit(2030), 5)


@query("kind6_record_card", "request:i epoch:s kind:s year:i day:d value:1", """
 SELECT request, epoch, CASE WHEN year = 2033 THEN CASE WHEN winter THEN 'coldestDay' ELSE 'hottestDay' END WHEN winter THEN 'coldRecord' ELSE 'record' END AS kind,
  CASE WHEN year = 2033 THEN CASE WHEN winter THEN cold_year ELSE hot_year END ELSE year END AS year, CASE WHEN year = 2033 THEN CASE WHEN winter THEN cold_day ELSE hot_day END END AS day,
  CASE WHEN year = 2033 THEN CASE WHEN winter THEN ROUND_EVEN(cold_value, 1) ELSE ROUND_EVEN(hot_value, 1) END ELSE v END AS value FROM (
  SELECT f.*, season = 'winter' AS winter, ROW_NUMBER() OVER (PARTITION BY request ORDER BY CASE WHEN season = 'winter' THEN -v ELSE v END DESC, year DESC) AS q FROM served_figs AS f
  WHERE epoch = CASE WHEN season = 'winter' THEN 'old' ELSE 'future' END) AS x JOIN peaks USING (request, epoch) WHERE q = 1""", **KIND_PARTS)
def _(t):
    r = season_table(t).select("request", "season", F.lit(2033).alias("shown_year"), F.lit(None).cast("string").alias("shown_kind"))
    return Y.record_card(season_kinds(t), season_peaks(t), r, "request")


# --- all answers to a table of searches, each with a reference period of its own ---------------

REFS, REF_YEARS = (1995, 1997), 5
REFERENCED = "SELECT *, CASE search_id % 3 WHEN 0 THEN 1995 WHEN 1 THEN 1997 ELSE 1990 END AS reference FROM asked"
KNOWN_REF = "SELECT * FROM referenced WHERE reference <> 1990"
SEARCH_PARTS = dict(**YEAR_PARTS, referenced=REFERENCED, known_ref=KNOWN_REF)


def with_reference(df):
    return df.withColumn("reference", F.expr("CASE search_id % 3 WHEN 0 THEN 1995 WHEN 1 THEN 1997 ELSE 1990 END"))


def answer(t, name):
    from daygrid.plans.batch import answers
    searches = with_reference(asked(t)).filter(F.col("reference").isin(*REFS))
    return answers(searches, t.daily, t.periods, years=REF_YEARS, span=5, first_year=FIRST, last_year=LAST, observed="obs", simulated="sim", references=REFS, epochs=EPOCHS)[name]


@query("api4_unknown_reference", "search_id:i status:s", """
 SELECT search_id, CASE WHEN search_id % 3 = 2 THEN 'UnknownReference' ELSE status END AS status FROM status""", **PLACE_PARTS, status=STATUS)
def _(t):
    from daygrid.operators import records
    checked = records.validate(with_reference(t.searches), t.periods, references=REFS)
    return records.with_domain_status(checked, located(t), "place_id")


@query("api1_normals", "search_id:i day:d tasmax:2 tasmin:2 pr:2", """
 SELECT search_id, CAST(d AS DATE) AS day, ROUND_EVEN(ROUND_EVEN(SUM(b.s1)/NULLIF(SUM(b.n1), 0), 9), 2) AS tasmax, ROUND_EVEN(ROUND_EVEN(SUM(b.s2)/NULLIF(SUM(b.n2), 0), 9), 2) AS tasmin, ROUND_EVEN(ROUND_EVEN(SUM(b.s3)/NULLIF(SUM(b.n3), 0), 9), 2) AS pr
 FROM (SELECT *, UNNEST(GENERATE_SERIES(first_day, last_day, INTERVAL 1 DAY)) AS d FROM known_ref) AS a
 LEFT JOIN slots AS b ON b.cell_id = a.cell_id AND b.reference = a.reference AND (DATE_DIFF('day', DATE '2000-01-01', MAKE_DATE(2000, MONTH(d), DAY(d))) - b.slot + 366 + 7) % 366 <= 14 GROUP BY 1, 2""",
       slots="SELECT r AS reference, cell_id, " + SLOT.format(d="day") + """ AS slot, SUM(tasmax) AS s1, COUNT(tasmax) AS n1, SUM(tasmin) AS s2, COUNT(tasmin) AS n2, SUM(pr) AS s3, COUNT(pr) AS n3
 FROM obs JOIN (VALUES (1995), (1997)) AS v(r) ON YEAR(day) BETWEEN r AND r + 4 GROUP BY ALL""", **SEARCH_PARTS)
def _(t):
    return answer(t, "normals")


@query("api1_years", "search_id:i reference:i year:i temperature_anomaly:4 precipitation_ratio:4", """
 SELECT f.search_id, reference, f.year, tas_mean - tn AS temperature_anomaly, CASE WHEN pn <> 0 THEN precipitation/pn END AS precipitation_ratio
 FROM figs AS f JOIN (SELECT search_id, ANY_VALUE(reference) AS reference, AVG(tas_mean) FILTER (year BETWEEN reference AND reference + 4) AS tn, AVG(precipitation) FILTER (year BETWEEN reference AND reference + 4) AS pn
  FROM figs JOIN known_ref USING (search_id) GROUP BY 1) AS n USING (search_id)""", **SEARCH_PARTS)
def _(t):
    return answer(t, "years").filter("source IS NOT NULL")


@query("api1_summary", "search_id:i figure:s value:3 normal:3", " UNION ALL ".join(
    f"""SELECT search_id, '{n}' AS figure, MAX(CASE WHEN year = y0 THEN {n} END) AS value, AVG(CASE WHEN figs.source = 'obs' AND year BETWEEN reference AND reference + 4 THEN {n} END) AS normal FROM figs JOIN known_ref USING (search_id) GROUP BY search_id"""
    for n in Y.FIGURES), **SEARCH_PARTS)
def _(t):
    return answer(t, "summary")


@query("api1_kinds", "search_id:i epoch:s year:i kind:s", """
 SELECT search_id, epoch, year, CASE WHEN 2*k >= n THEN 'normal' WHEN r <= k THEN 'cool' WHEN r > n - k THEN 'warm' ELSE 'normal' END AS kind FROM (
  SELECT *, COUNT(*) OVER w AS n, ROW_NUMBER() OVER (PARTITION BY search_id, epoch ORDER BY exact_mean, year) AS r, GREATEST(1, ROUND_EVEN(0.2*COUNT(*) OVER w, 0)) AS k FROM (
   SELECT search_id, year, exact_mean, """ + EPOCH_SQL + """ AS epoch FROM figs JOIN known_ref USING (search_id) WHERE exact_mean IS NOT NULL) AS f WINDOW w AS (PARTITION BY search_id, epoch)) AS x""", **SEARCH_PARTS)
def _(t):
    return answer(t, "kinds")
