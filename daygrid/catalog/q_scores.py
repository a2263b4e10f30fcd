"""Queries: validation scores."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.catalog.q_correction import GAP, MASK, N, REGION, level_list, mask, values
from daygrid.functions.humidity import wet_bulb
from daygrid.operators import nearby as NB
from daygrid.operators import regions as R
from daygrid.operators import scores as S
from daygrid.catalog.q_grid import KM

# The model "corrected" by a constant, so three samples exist: ref, raw and corrected.
SAMPLES = """SELECT 'ref' AS role, cell_id, day, MONTH(day) AS month, {n} AS value FROM obs UNION ALL SELECT 'raw', cell_id, day, MONTH(day), {n} FROM sim
 UNION ALL SELECT 'corrected', cell_id, day, MONTH(day), {n} - 1.5 FROM sim"""
TAS, PR = SAMPLES.format(n="tas"), SAMPLES.format(n="pr").replace("pr - 1.5", "pr*0.8")
MOMENTS = """SELECT role, cell_id, month, AVG(value) AS mean, QUANTILE_CONT(value, 0.05) AS p5, QUANTILE_CONT(value, 0.95) AS p95,
  100.0*SUM(CASE WHEN value >= 1 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS wet FROM st GROUP BY 1, 2, 3"""
GAPS = """SELECT m.role, m.cell_id, m.month, m.mean - r.mean AS mean, m.p5 - r.p5 AS p5, m.p95 - r.p95 AS p95, m.wet - r.wet AS wet,
  CASE WHEN r.mean > 0 THEN 100.0*(m.mean/r.mean - 1) END AS mean_percent FROM mo AS m JOIN mo AS r ON r.role = 'ref' AND r.cell_id = m.cell_id AND r.month = m.month WHERE m.role <> 'ref'"""


def samples(t, name):
    v = values(t.sim, name)
    fixed = v.withColumn("value", F.col("value") - 1.5 if name != "pr" else F.col("value") * 0.8)
    return S.stack(ref=values(t.obs, name), raw=v, corrected=fixed)


def _over(names, by="role, month", table="ga"):
    return f"SELECT {by}, " + ", ".join(f"AVG({n}) AS {n}_bias, SQRT(AVG({n}*{n})) AS {n}_rms" for n in names) + f", COUNT(*) AS cells FROM {table} GROUP BY ALL"


@query("val1_moments_over_cells", "role:s month:i mean_bias:3 mean_rms:3 p5_bias:3 p5_rms:3 p95_bias:3 p95_rms:3 cells:i", _over(("mean", "p5", "p95")), st=TAS, mo=MOMENTS, ga=GAPS)
def _(t):
    n = ("mean", "p5", "p95")
    return S.over_cells(S.against(S.moments(samples(t, "tas")), "ref", n), n)


QROWS = f"""SELECT role, cell_id, month, LIST_TRANSFORM(QUANTILE_CONT(v, {level_list(N)}), lambda z: ROUND(z, 9)) AS q, COUNT(v) AS n FROM (SELECT *, {{v}} AS v FROM st) AS s GROUP BY 1, 2, 3"""
W1 = f"""SELECT m.role, m.cell_id, m.month, CASE WHEN LEAST(m.n, r.n) >= {{k}} THEN LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(1, {N}), lambda i: ABS(m.q[i] - r.q[i])))/{N} END AS w1
 FROM qr AS m JOIN qr AS r ON r.role = 'ref' AND r.cell_id = m.cell_id AND r.month = m.month WHERE m.role <> 'ref'"""


@query("val2_wasserstein", "role:s cell_id:i month:i w1:3", "SELECT * FROM w", st=TAS, qr=QROWS.format(v="value"), w=W1.format(k=0))
def _(t):
    return S.wasserstein(S.quantile_rows(samples(t, "tas"), N), "ref", N)


@query("val2_wasserstein_wet_days", "role:s cell_id:i month:i w1:3", "SELECT * FROM w", st=PR, qr=QROWS.format(v="CASE WHEN value >= 1 THEN value END"), w=W1.format(k=30))
def _(t):
    return S.wasserstein(S.quantile_rows(samples(t, "pr"), N, 1.0), "ref", N, 30)


HALVES = """SELECT 'ref' AS role, cell_id, day, MONTH(day) AS month, tas AS value FROM obs WHERE YEAR(day) >= 1998 UNION ALL
 SELECT 'floor', cell_id, day, MONTH(day), tas FROM obs WHERE YEAR(day) < 1998 UNION ALL SELECT 'raw', cell_id, day, MONTH(day), tas FROM sim WHERE YEAR(day) >= 1998"""


@query("val3_floor", "role:s month:i median:3 floor:3 at_floor:3", """
 SELECT w.role, w.month, QUANTILE_CONT(w.w1, 0.5) AS median, QUANTILE_CONT(f.w1, 0.5) AS floor, AVG(CASE WHEN w.w1 <= f.w1 THEN 1.0 ELSE 0 END) AS at_floor
 FROM w JOIN w AS f ON f.role = 'floor' AND f.cell_id = w.cell_id AND f.month = w.month WHERE w.role <> 'floor' AND w.w1 IS NOT NULL GROUP BY 1, 2""",
       st=HALVES, qr=QROWS.format(v="value"), w=W1.format(k=0))
def _(t):
    o, s = values(t.obs, "tas"), values(t.sim, "tas")
    st = S.stack(ref=o.filter("year(day) >= 1998"), floor=o.filter("year(day) < 1998"), raw=s.filter("year(day) >= 1998"))
    return S.at_floor(S.wasserstein(S.quantile_rows(st, N), "ref", N), "floor")


@query("val4_occurrence", "role:s cell_id:i month:i wet:3 dry:3 at_low:3 at_high:3", """
 SELECT role, cell_id, month, 100.0*SUM(CASE WHEN value >= 1 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS wet, 100.0*SUM(CASE WHEN value < 1 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS dry,
  100.0*SUM(CASE WHEN value <= 0 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS at_low, 100.0*SUM(CASE WHEN value >= 9 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS at_high FROM st GROUP BY 1, 2, 3""", st=PR)
def _(t):
    return S.occurrence(samples(t, "pr"), 1.0, 0.0, 9.0)


SEASON = "CASE (MONTH(a.day) % 12) // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END"
PAIRS = """SELECT c.cell_id, k AS lag, 'e' AS way, e.cell_id AS other FROM cells AS c CROSS JOIN (VALUES (1), (2), (4), (8)) AS l(k) JOIN cells AS e ON e."row" = c."row" AND e.col = c.col + k
 UNION ALL SELECT c.cell_id, k, 's', e.cell_id FROM cells AS c CROSS JOIN (VALUES (1), (2), (4), (8)) AS l(k) JOIN cells AS e ON e."row" = c."row" + k AND e.col = c.col"""


def _coherence(value):
    return dict(an=f"SELECT source, cell_id, day, v - AVG(v) OVER (PARTITION BY source, cell_id, MONTH(day)) AS v FROM (SELECT *, {value} AS v FROM daily) AS d", nb=PAIRS,
                one=f"""SELECT a.source, a.cell_id, {SEASON} AS season, lag, way, SUM(a.v*b.v)/NULLIF(SQRT(SUM(a.v*a.v)*SUM(b.v*b.v)), 0) AS r FROM nb JOIN an AS a ON a.cell_id = nb.cell_id
 JOIN an AS b ON b.source = a.source AND b.day = a.day AND b.cell_id = nb.other WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")


COHERENCE_SQL = "SELECT source, cell_id, season, lag, AVG(r) AS correlation FROM one GROUP BY 1, 2, 3, 4"


@query("val5_spatial_coherence", "source:s cell_id:i season:s lag:i correlation:4", COHERENCE_SQL, headline=True, **_coherence("tas"))
def _(t):
    return S.coherence(t.daily, t.cells, "tas")


@query("val5_occurrence_coherence", "source:s cell_id:i season:s lag:i correlation:4", COHERENCE_SQL, **_coherence("CASE WHEN pr >= 1 THEN 1.0 WHEN pr < 1 THEN 0.0 END"))
def _(t):
    d = t.daily.withColumn("wet", F.when(F.col("pr") >= 1, 1.0).when(F.col("pr") < 1, 0.0))
    return S.coherence(d, t.cells, "wet")


SIGNAL = """SELECT l.role, l.cell_id, l.month, {a} AS mean, {b} AS p95 FROM pm AS l JOIN pm AS p ON p.role = l.role AND p.cell_id = l.cell_id AND p.month = l.month WHERE l.later AND NOT p.later"""
PM = """SELECT role, cell_id, month, later, AVG(value) AS mean, QUANTILE_CONT(value, 0.95) AS p95 FROM (
  SELECT 'raw' AS role, cell_id, MONTH(day) AS month, YEAR(day) >= 2027 AS later, {n} AS value FROM daily WHERE source = 'sim') AS s GROUP BY 1, 2, 3, 4"""


@query("val6_change_signal", "variable:s role:s cell_id:i month:i mean:3 p95:3",
       "SELECT 'tas' AS variable, * FROM (" + SIGNAL.format(a="l.mean - p.mean", b="l.p95 - p.p95") + ") AS x UNION ALL SELECT 'pr', * FROM ("
       + SIGNAL.format(a="100.0*(l.mean/CASE WHEN p.mean > 1 THEN p.mean END - 1)", b="100.0*(l.p95/CASE WHEN p.p95 > 1 THEN p.p95 END - 1)").replace("pm", "pp") + ") AS y",
       pm=PM.format(n="tas"), pp=PM.format(n="pr"))
def _(t):
    sim = t.daily.filter("source = 'sim'")
    a = S.change_signal(S.stack(raw=values(sim, "tas")), (1995, 2001), (2027, 2033), False).withColumn("variable", F.lit("tas"))
    b = S.change_signal(S.stack(raw=values(sim, "pr")), (1995, 2001), (2027, 2033), True, 1.0).withColumn("variable", F.lit("pr"))
    return a.unionByName(b)


BOXES = (("land", 40.0, 50.0, -10.0, 400.0, True), ("north", 45.5, 90.0, -180.0, 400.0, None), ("south", -90.0, 45.4, -180.0, 400.0, None))
BOX_SQL = """SELECT cell_id, 'land' AS region FROM cells WHERE lat BETWEEN 40 AND 50 AND lon BETWEEN -10 AND 400 AND land UNION ALL
 SELECT cell_id, 'north' FROM cells WHERE lat >= 45.5 UNION ALL SELECT cell_id, 'south' FROM cells WHERE lat <= 45.4"""


@query("val7_region_medians", "region:s role:s month:i median:3 cells:i", """
 SELECT region, role, month, QUANTILE_CONT(mean, 0.5) AS median, COUNT(mean) AS cells FROM ga JOIN box USING (cell_id) GROUP BY 1, 2, 3""", st=TAS, mo=MOMENTS, ga=GAPS, box=BOX_SQL)
def _(t):
    g = S.against(S.moments(samples(t, "tas")), "ref", ("mean",))
    return S.medians(g, S.in_boxes(t.cells, BOXES), "mean", ("role", "month"))


@query("val8_independent_temperature", "period:s role:s cell_id:i month:i mean:3 p5:3 p95:3", f"""
 SELECT m.period, m.role, m.cell_id, m.month, m.mean - r.mean AS mean, (m.q[1] + m.q[2])/2 - (r.q[1] + r.q[2])/2 AS p5, (m.q[19] + m.q[20])/2 - (r.q[19] + r.q[20])/2 AS p95 FROM lv AS m JOIN lv AS r
 ON r.role = 'ref' AND r.period = m.period AND r.cell_id = m.cell_id AND r.month = m.month WHERE m.role <> 'ref'""",
       st="""SELECT 'ref' AS role, cell_id, day, MONTH(day) AS month, tas AS value FROM obs UNION ALL SELECT 'raw', s.cell_id, s.day, MONTH(s.day), CASE WHEN o.tas IS NOT NULL THEN s.tas END FROM sim AS s
 JOIN obs AS o ON o.cell_id = s.cell_id AND o.day = s.day""",
       lv=f"""SELECT CASE WHEN YEAR(day) <= 1998 THEN 'first' ELSE 'second' END AS period, role, cell_id, month, AVG(value) AS mean, LIST_TRANSFORM(QUANTILE_CONT(value, {level_list(N)}), lambda z: ROUND(z, 9)) AS q FROM st GROUP BY 1, 2, 3, 4""")
def _(t):
    from daygrid.operators.grid import mask_like
    sim = mask_like(values(t.sim, "tas"), values(t.obs, "tas"), "value")
    st = S.stack(ref=values(t.obs, "tas"), raw=sim).withColumn("period", F.expr("if(year(day) <= 1998, 'first', 'second')"))
    keys = ("period", "role", "cell_id", "month")
    rows = S.summary_from_levels(S.quantile_rows(st, N, keys=keys)).join(st.groupBy(*keys).agg(F.avg("value").alias("mean")), list(keys))
    return S.against(rows, "ref", ("mean", "p5", "p95"), ("period", "cell_id", "month"))


@query("val8_independent_rain", "role:s cell_id:i month:i mean:3 freq:3 drizzle:3 drizzle_share:3", """
 SELECT m.role, m.cell_id, m.month, CASE WHEN r.mean > 0 THEN 100.0*(m.mean/r.mean - 1) END AS mean, m.freq - r.freq AS freq, m.drizzle - r.drizzle AS drizzle, m.share - r.share AS drizzle_share
 FROM wf AS m JOIN wf AS r ON r.role = 'ref' AND r.cell_id = m.cell_id AND r.month = m.month WHERE m.role <> 'ref'""", st=PR,
       wf="""SELECT role, cell_id, month, AVG(value) AS mean, 100.0*SUM(CASE WHEN value >= 1 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS freq,
  100.0*SUM(CASE WHEN value >= 0.1 AND value < 1 THEN 1 ELSE 0 END)/NULLIF(COUNT(value), 0) AS drizzle,
  100.0*SUM(CASE WHEN value >= 0.1 AND value < 1 THEN value ELSE 0 END)/NULLIF(SUM(value), 0) AS share FROM st GROUP BY 1, 2, 3""")
def _(t):
    return S.against(S.wet_figures(samples(t, "pr"), 1.0, 0.1), "ref", ("mean", "freq", "drizzle", "drizzle_share"), percent=("mean",))


DRAWN = """SELECT CASE WHEN YEAR(day) IN (SELECT y FROM (SELECT y, ROW_NUMBER() OVER (ORDER BY MD5('0:' || y)) AS r, COUNT(*) OVER () AS c
   FROM (SELECT DISTINCT YEAR(day) AS y FROM obs) AS a) AS b WHERE r <= FLOOR(c/2)) THEN 'half' ELSE 'ref' END AS role, cell_id, day, MONTH(day) AS month, tas AS value FROM obs"""


@query("val9_random_half_floor", "cell_id:i month:i w1:3", "SELECT * FROM w", st=DRAWN, qr=QROWS.format(v="value"), w=W1.format(k=0))
def _(t):
    o = S.half_of_years(values(t.obs, "tas"))
    st = S.stack(ref=o.filter("NOT half").drop("half"), half=o.filter("half").drop("half"))
    return S.wasserstein(S.quantile_rows(st, N), "ref", N)


SPREAD = "SELECT cell_id, STDDEV_SAMP(tas) AS spread FROM obs GROUP BY 1"


@query("val10_reliable_half", "cell_id:i spread:4", "SELECT cell_id, spread FROM sp WHERE spread <= (SELECT QUANTILE_CONT(spread, 0.5) FROM sp)", sp=SPREAD)
def _(t):
    return S.reliable_half(t.obs.groupBy("cell_id").agg(F.stddev_samp("tas").alias("spread")))


@query("val11_by_altitude", 'role:s class:f mean_bias:3 mean_rms:3 cells:i', """
 SELECT role, CASE WHEN elevation IS NOT NULL THEN CAST(elevation >= 300 AS INTEGER) + CAST(elevation >= 800 AS INTEGER) END AS class, AVG(mean) AS mean_bias, SQRT(AVG(mean*mean)) AS mean_rms, COUNT(*) AS cells
 FROM ga JOIN cells USING (cell_id) GROUP BY 1, 2""", st=TAS, mo=MOMENTS, ga=GAPS)
def _(t):
    g = S.against(S.moments(samples(t, "tas")), "ref", ("mean",))
    c = t.cells.select("cell_id", S.altitude_class(F.col("elevation"), (300.0, 800.0)).alias("class"))
    return S.by_class(g, c, ("mean",))


@query("val12_raw_diagnosis", "role:s month:i mean_bias:3 mean_rms:3 p95_bias:3 wet_bias:3 wet_rms:3", """
 SELECT role, month, AVG(mean_percent) AS mean_bias, SQRT(AVG(mean_percent*mean_percent)) AS mean_rms, AVG(pp) AS p95_bias, AVG(wet) AS wet_bias, SQRT(AVG(wet*wet)) AS wet_rms FROM (
  SELECT g.*, CASE WHEN r.p95 > 0 THEN 100.0*(m.p95/r.p95 - 1) END AS pp FROM ga AS g JOIN mo AS m USING (role, cell_id, month) JOIN mo AS r ON r.role = 'ref' AND r.cell_id = g.cell_id AND r.month = g.month) AS x GROUP BY 1, 2""",
       st=PR, mo=MOMENTS, ga=GAPS)
def _(t):
    n = ("mean", "p95", "wet")
    return S.over_cells(S.against(S.moments(samples(t, "pr"), wet=1.0), "ref", n, percent=("mean", "p95")), n)


@query("val13_cold_tail", "role:s cell_id:i cold_tail:b", """
 SELECT role, cell_id, BOOL_OR(COALESCE(p5 < -0.5 AND p95 - p5 > 1, FALSE)) AS cold_tail FROM ga GROUP BY 1, 2""", st=TAS, mo=MOMENTS, ga=GAPS)
def _(t):
    return S.cold_tail(S.against(S.moments(samples(t, "tas")), "ref", ("p5", "p95")), -0.5, 1.0)


@query("val14_scenario_step", "source:s cell_id:i step:3 slope:4 residual:3 two_se:3", """
 SELECT source, cell_id, (xx*zy - xz*xy)/(xx*zz - xz*xz) AS step, (zz*xy - xz*zy)/(xx*zz - xz*xz) AS slope,
  SQRT(GREATEST(yy - (zz*xy - xz*zy)/(xx*zz - xz*xz)*xy - (xx*zy - xz*xy)/(xx*zz - xz*xz)*zy, 0)/(n - 3)) AS residual,
  2*SQRT(GREATEST(yy - (zz*xy - xz*zy)/(xx*zz - xz*xz)*xy - (xx*zy - xz*xy)/(xx*zz - xz*xz)*zy, 0)/(n - 3))*SQRT(xx/(xx*zz - xz*xz)) AS two_se FROM (
  SELECT source, cell_id, COUNT(*) AS n, REGR_SXX(v, x) AS xx, REGR_SXX(v, z) AS zz, REGR_SXY(z, x) AS xz, REGR_SXY(v, x) AS xy, REGR_SXY(v, z) AS zy, REGR_SYY(v, x) AS yy FROM (
   SELECT source, cell_id, YEAR(day) - 2027.0 AS x, CASE WHEN YEAR(day) >= 2027 THEN 1.0 ELSE 0.0 END AS z, AVG(tas) AS v FROM daily WHERE source = 'sim' GROUP BY source, cell_id, YEAR(day)) AS y GROUP BY 1, 2) AS s""")
def _(t):
    y = t.daily.filter("source = 'sim'").groupBy("source", "cell_id", F.year("day").alias("year")).agg(F.avg("tas").alias("value"))
    return S.scenario_step(y, ["source", "cell_id"], 2027)


SEAS = "CASE (MONTH(o.day) % 12) // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END"


def _yg(n, kind):
    return f"""SELECT o.cell_id, YEAR(o.day) AS year, '{n}' AS variable, COUNT(o.{n}) AS days, CASE WHEN COUNT(o.{n} - s.{n}) >= 0.3*COUNT(*) THEN AVG(o.{n} - s.{n}) END AS annual,
 """ + ", ".join(f"CASE WHEN COUNT(CASE WHEN {SEAS} = '{k}' THEN o.{n} - s.{n} END) >= 0.3*SUM(CASE WHEN {SEAS} = '{k}' THEN 1 ELSE 0 END) THEN AVG(CASE WHEN {SEAS} = '{k}' THEN o.{n} - s.{n} END) END AS {k}" for k in ("DJF", "MAM", "JJA", "SON")) + f""",
 CASE WHEN COUNT(o.{n} - s.{n}) >= 0.3*COUNT(*) THEN {kind}(CASE WHEN s.{n} IS NOT NULL THEN o.{n} END) - {kind}(CASE WHEN o.{n} IS NOT NULL THEN s.{n} END) END AS extreme
 FROM obs AS o JOIN sim AS s ON s.cell_id = o.cell_id AND s.day = o.day GROUP BY 1, 2"""


YG = _yg("tasmax", "MAX") + " UNION ALL " + _yg("tasmin", "MIN")


def gaps_by_year(t):
    return S.yearly_gaps(t.obs, t.sim, (("tasmax", "max"), ("tasmin", "min")), 0.3)


@query("val15_yearly_gaps", "cell_id:i year:i variable:s days:i annual:3 DJF:3 MAM:3 JJA:3 SON:3 extreme:3", "SELECT * FROM yg", yg=YG)
def _(t):
    return gaps_by_year(t)


PER = """SELECT cell_id, variable, CASE WHEN COUNT(annual) >= 0.8*({b} - {a} + 1) THEN AVG(annual) END AS v FROM yg WHERE year BETWEEN {a} AND {b} GROUP BY 1, 2"""


@query("val16_drift", "cell_id:i variable:s first_half:3 second_half:3 drift:3 per_decade:3 since:f", """
 SELECT a.cell_id, a.variable, a.v AS first_half, b.v AS second_half, b.v - a.v AS drift, t.s AS per_decade, c.since FROM ha AS a JOIN hb AS b USING (cell_id, variable)
 JOIN (SELECT cell_id, variable, 10*REGR_SLOPE(annual, year) AS s FROM yg GROUP BY 1, 2) AS t USING (cell_id, variable)
 JOIN (SELECT cell_id, variable, CASE WHEN COALESCE(MAX(CASE WHEN days < 0.45*365 THEN year END) + 1, MIN(year)) <= MAX(year) THEN COALESCE(MAX(CASE WHEN days < 0.45*365 THEN year END) + 1, MIN(year)) END AS since
  FROM yg GROUP BY 1, 2) AS c USING (cell_id, variable)""", yg=YG, ha=PER.format(a=1995, b=1997), hb=PER.format(a=1998, b=2001))
def _(t):
    y = gaps_by_year(t)
    return S.drift(y, "annual", ((1995, 1997), (1998, 2001))).join(
        S.covered_since(y, F.lit(365), 0.45), ["cell_id", "variable"])


KM_PAIRS = "SELECT c.cell_id, c.elevation AS ce, s.elevation AS se, s.first_year, s.last_year, " + KM.format(a="c.lat", b="c.lon", c="s.lat", d="s.lon") + \
    " AS km FROM cells AS c CROSS JOIN stations AS s"
HALVES = ((1994, 1997), (1998, 2001))
HALF = "CASE WHEN year BETWEEN 1994 AND 1997 THEN 0 WHEN year BETWEEN 1998 AND 2001 THEN 1 END"
AROUND = """SELECT cell_id, y AS year, MIN(km) AS nearest_km, COUNT(CASE WHEN km <= 25 THEN 1 END) AS stations, AVG(CASE WHEN km <= 25 THEN se - ce END) AS height_gap
 FROM km_pairs CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1994, 2001)) AS y) AS u WHERE y BETWEEN first_year AND last_year GROUP BY 1, 2"""
HALF_GAP = "SELECT cell_id, variable, " + HALF + " AS period, CASE WHEN COUNT(annual) >= 0.8*4 THEN AVG(annual) END AS annual FROM yg GROUP BY 1, 2, 3"
HALF_DIST = "SELECT cell_id, " + HALF + " AS period, AVG(nearest_km) AS km FROM around GROUP BY 1, 2"


def around(t):
    return NB.stations_around(t.cells, t.stations, range(1994, 2002))


@query("val17_by_distance", "variable:s period:i class:i mean:3 sd:3 cells:i", """
 SELECT variable, period, CASE WHEN km IS NOT NULL THEN CAST(km >= 5 AS INTEGER) + CAST(km >= 9 AS INTEGER) END AS class, AVG(annual) AS mean, STDDEV_POP(annual) AS sd, COUNT(*) AS cells
 FROM half_gap JOIN half_dist USING (cell_id, period) WHERE annual IS NOT NULL GROUP BY 1, 2, 3""", yg=YG, km_pairs=KM_PAIRS, around=AROUND, half_gap=HALF_GAP, half_dist=HALF_DIST)
def _(t):
    gaps, dist = S.by_period(gaps_by_year(t), "annual", HALVES, 0.8, ("cell_id", "variable")), S.by_period(around(t), "nearest_km", HALVES, 0.0, ("cell_id",))
    classes = dist.select("cell_id", "period", S.altitude_class(F.col("nearest_km"), (5.0, 9.0)).alias("class"))
    return S.spread_by(gaps.join(classes, ["cell_id", "period"]), ["variable", "period", "class"], "annual")


@query("val17_drift_by_approach", "variable:s approach:s mean:3 sd:3 cells:i", """
 SELECT a.variable, CASE WHEN d.km < 9 AND e.km < 9 THEN 'near' WHEN d.km >= 9 AND e.km < 9 THEN 'approached' WHEN d.km >= 9 AND e.km >= 9 THEN 'far' WHEN d.km < 9 AND e.km >= 9 THEN 'receded' END AS approach,
  AVG(b.annual - a.annual) AS mean, STDDEV_POP(b.annual - a.annual) AS sd, COUNT(*) AS cells FROM half_gap AS a JOIN half_gap AS b ON b.cell_id = a.cell_id AND b.variable = a.variable AND a.period = 0 AND b.period = 1
  LEFT JOIN half_dist AS d ON d.cell_id = a.cell_id AND d.period = 0 LEFT JOIN half_dist AS e ON e.cell_id = a.cell_id AND e.period = 1
  WHERE a.annual IS NOT NULL AND b.annual IS NOT NULL GROUP BY 1, 2""", yg=YG, km_pairs=KM_PAIRS, around=AROUND, half_gap=HALF_GAP, half_dist=HALF_DIST)
def _(t):
    gaps, dist = S.by_period(gaps_by_year(t), "annual", HALVES, 0.8, ("cell_id", "variable")), S.by_period(around(t), "nearest_km", HALVES, 0.0, ("cell_id",))
    return S.drift_by_approach(gaps, dist, "annual", 9.0)


WHOLE_GAP = "SELECT cell_id, variable, AVG(annual) AS annual FROM yg WHERE year BETWEEN 1994 AND 2001 GROUP BY 1, 2 HAVING COUNT(annual) >= 0.8*8"
ACTIVE = "SELECT c.cell_id, c.elevation, COALESCE(stations, 0) AS stations, height_gap FROM cells AS c LEFT JOIN (SELECT * FROM around WHERE year = 1998) AS a USING (cell_id)"
DENSITY = "CASE WHEN stations = 0 THEN 0 WHEN stations = 1 THEN 1 WHEN stations <= 3 THEN 2 WHEN stations <= 7 THEN 3 ELSE 4 END"
HEIGHT = "CASE WHEN elevation IS NOT NULL THEN CAST(elevation >= 300 AS INTEGER) + CAST(elevation >= 700 AS INTEGER) + CAST(elevation >= 1200 AS INTEGER) + CAST(elevation >= 1800 AS INTEGER) END"


def active_gaps(t):
    """Gaps over the whole span beside the stations active in 1998."""
    gaps = S.by_period(gaps_by_year(t), "annual", ((1994, 2001),), 0.8, ("cell_id", "variable")).drop("period").filter("annual IS NOT NULL")
    return gaps.join(NB.stations_around(t.cells, t.stations, [1998]), "cell_id").join(t.cells.select("cell_id", "elevation"), "cell_id")


@query("val17_by_density_and_altitude", "variable:s altitude:i density:i mean:3 rms:3 cells:i", """
 SELECT variable, altitude, density, AVG(annual) AS mean, SQRT(AVG(annual*annual)) AS rms, COUNT(*) AS cells FROM (
  SELECT variable, annual, """ + HEIGHT + " AS altitude, " + DENSITY + """ AS density FROM whole_gap JOIN active USING (cell_id)) AS x WHERE altitude IS NOT NULL
 GROUP BY GROUPING SETS ((variable, density), (variable, altitude), (variable, altitude, density))""",
       yg=YG, km_pairs=KM_PAIRS, around=AROUND, whole_gap=WHOLE_GAP, active=ACTIVE)
def _(t):
    return S.by_density_and_altitude(active_gaps(t), "annual")


@query("val17_station_height", "variable:s height:i mean:3 rms:3 cells:i correlation:3", """
 SELECT variable, height, mean, rms, cells, correlation FROM (SELECT variable, CAST(height_gap >= -300 AS INTEGER) + CAST(height_gap >= -100 AS INTEGER) + CAST(height_gap > 100 AS INTEGER) AS height,
  AVG(annual) AS mean, SQRT(AVG(annual*annual)) AS rms, COUNT(*) AS cells FROM whole_gap JOIN active USING (cell_id) WHERE stations > 0 AND elevation >= 700 AND height_gap IS NOT NULL GROUP BY 1, 2) AS x
 JOIN (SELECT variable, CORR(annual, height_gap) AS correlation FROM whole_gap JOIN active USING (cell_id) WHERE stations > 0 GROUP BY 1) AS c USING (variable)""",
       yg=YG, km_pairs=KM_PAIRS, around=AROUND, whole_gap=WHOLE_GAP, active=ACTIVE)
def _(t):
    return S.by_station_height(active_gaps(t), "annual", 700.0)


STATION_PAIRS = """SELECT d.station_id, d.day, d.tas AS o, g.tas AS s, c.elevation - st.elevation AS dz FROM station_daily AS d JOIN stations AS st USING (station_id) JOIN cells AS c ON c.cell_id = st.cell_id
 JOIN obs AS g ON g.cell_id = st.cell_id AND g.day = d.day"""


def station_pairs(t):
    st = t.stations.select("station_id", "cell_id", F.col("elevation").alias("_z")).join(t.cells.select("cell_id", F.col("elevation").alias("_c")), "cell_id")
    d = t.station_daily.select("station_id", "day", F.col("tas").alias("o")).join(st, "station_id")
    return d.join(t.obs.select("cell_id", "day", F.col("tas").alias("s")), ["cell_id", "day"]).select(
        "station_id", "day", "o", "s", (F.col("_c") - F.col("_z")).alias("dz"))


@query("val18_station_scores", "station_id:i bias:3 extreme_bias:3 bias_at_station:3 extreme_at_station:3", """
 SELECT b.station_id, CASE WHEN n > 20 THEN b END AS bias, CASE WHEN y >= 3 THEN e END AS extreme_bias, CASE WHEN n > 20 THEN b END + 6.5/1000*dz AS bias_at_station,
  CASE WHEN y >= 3 THEN e END + 6.5/1000*dz AS extreme_at_station FROM (SELECT station_id, AVG(CASE WHEN MONTH(day) IN (6, 7, 8) THEN s - o END) AS b, SUM(CASE WHEN MONTH(day) IN (6, 7, 8) THEN 1 ELSE 0 END) AS n, ANY_VALUE(dz) AS dz
   FROM sp WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY 1) AS b LEFT JOIN (SELECT station_id, AVG(e) AS e, COUNT(*) AS y FROM (SELECT station_id, YEAR(day) AS year, MAX(s) - MAX(o) AS e FROM sp
   WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 40) AS x GROUP BY 1) AS e USING (station_id)""", sp=STATION_PAIRS)
def _(t):
    return S.station_scores(station_pairs(t), ["station_id"], (6, 7, 8), 20, 40, 3)


@query("val19_humid_heat", "source:s region:s year:i days:i highest:3", """
 SELECT source, region, YEAR(day) AS year, SUM(CASE WHEN wb >= 20 THEN 1 ELSE 0 END) AS days, MAX(wb) AS highest FROM (
  SELECT source, cell_id, day, CASE WHEN tas IS NOT NULL AND hurs IS NOT NULL THEN LEAST(tas, tas*ATAN(0.151977*SQRT(LEAST(hurs, 100.0)+8.313659)) + ATAN(tas+LEAST(hurs, 100.0)) - ATAN(LEAST(hurs, 100.0)-1.676331)
   + 0.00391838*POW(LEAST(hurs, 100.0), 1.5)*ATAN(0.023101*LEAST(hurs, 100.0)) - 4.686035) END AS wb FROM daily) AS w JOIN box USING (cell_id) GROUP BY 1, 2, 3""", box=BOX_SQL)
def _(t):
    wb = wet_bulb("tas", "hurs")
    d = t.daily.select("source", "cell_id", "day", wb.alias("wb")).join(S.in_boxes(t.cells, BOXES), "cell_id")
    return d.groupBy("source", "region", F.year("day").alias("year")).agg(F.count_if(F.col("wb") >= 20).alias("days"), F.max("wb").alias("highest"))


@query("val20_seams", "crossing:b jump:3 pairs:i", """
 SELECT x.p <> y.p AS crossing, AVG(ABS(x.v - y.v)) AS jump, COUNT(*) AS pairs FROM f AS x JOIN f AS y ON (y.r = x.r AND y.c = x.c + 1) OR (y.r = x.r + 1 AND y.c = x.c) GROUP BY 1""",
       gap=GAP, region=REGION, mask=MASK, f="""SELECT k."row" AS r, k.col AS c, m.from_primary AS p, AVG(tas) AS v FROM obs JOIN cells AS k USING (cell_id) JOIN mask AS m USING (cell_id) GROUP BY 1, 2, 3""")
def _(t):
    means = t.obs.groupBy("cell_id").agg(F.avg("tas").alias("value"))
    return S.seam_excess(means, t.cells, mask(t))


MONTH_GAP = "SELECT station_id, MONTH(day) AS month, AVG(s - o) AS gap, ANY_VALUE(dz) AS dz FROM sp WHERE o IS NOT NULL AND s IS NOT NULL AND dz IS NOT NULL GROUP BY 1, 2"
CALIBRATING = "SUBSTRING(MD5('0:' || station_id), 1, 1) < '8'"
FIT = f"SELECT month, -1000*REGR_SLOPE(gap, dz) AS k FROM mg WHERE ABS(dz) < 1000 AND {CALIBRATING} GROUP BY 1"


@query("val22_lapse_rates", "month:i variant:s mean:3 absolute:3 stations:i", """
 SELECT g.month, variant, AVG(gap + CASE variant WHEN 'raw' THEN 0 WHEN 'five' THEN 5.0 WHEN 'standard' THEN 6.5 ELSE k END*dz/1000) AS mean,
  AVG(ABS(gap + CASE variant WHEN 'raw' THEN 0 WHEN 'five' THEN 5.0 WHEN 'standard' THEN 6.5 ELSE k END*dz/1000)) AS absolute, COUNT(*) AS stations
 FROM mg AS g JOIN fit USING (month) CROSS JOIN (VALUES ('raw'), ('five'), ('standard'), ('monthly')) AS v(variant) WHERE NOT (""" + CALIBRATING + ") GROUP BY 1, 2", sp=STATION_PAIRS, mg=MONTH_GAP, fit=FIT)
def _(t):
    g = station_pairs(t).filter("o IS NOT NULL AND s IS NOT NULL AND dz IS NOT NULL").groupBy("station_id", F.month("day").alias("month")).agg(
        F.avg(F.col("s") - F.col("o")).alias("gap"), F.first("dz").alias("dz"))
    half = S.calibrating("station_id")
    return S.lapse_variants(g.filter(~half), S.lapse_fit(g.filter(half)))


@query("reg14_station_agreement", "station_id:i correlation:4 rms:3 far_share:4 bias:3", """
 SELECT station_id, CORR(s, o) AS correlation, SQRT(AVG((s-o)*(s-o))) AS rms, AVG(CASE WHEN ABS(s-o) > 3.0000001 THEN 1.0 ELSE 0 END) AS far_share, AVG(s-o) AS bias FROM sp
 WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY 1""", sp=STATION_PAIRS)
def _(t):
    return S.daily_agreement(station_pairs(t), ["station_id"], 3.0000001)


@query("reg14_summer_quantiles", "role:s cell_id:i hottest:3 q50:3 q95:3 q99:3", """
 SELECT s.role, s.cell_id, AVG(value) AS hottest, ANY_VALUE(q50) AS q50, ANY_VALUE(q95) AS q95, ANY_VALUE(q99) AS q99 FROM st AS s JOIN (SELECT role, cell_id, QUANTILE_CONT(value, 0.5) AS q50,
  QUANTILE_CONT(value, 0.95) AS q95, QUANTILE_CONT(value, 0.99) AS q99 FROM st WHERE month IN (6, 7, 8) GROUP BY 1, 2) AS c USING (role, cell_id) WHERE month IN (6, 7, 8) AND value >= q95 GROUP BY 1, 2""", st=TAS)
def _(t):
    h = S.hottest_share(samples(t, "tas").filter("month IN (6, 7, 8)"), ("role", "cell_id"))
    return h.select("role", "cell_id", "hottest", *[F.get("q", F.lit(i)).alias(n) for i, n in ((2, "q50"), (4, "q95"), (5, "q99"))])
