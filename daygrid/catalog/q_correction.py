"""Queries: blended reference and bias correction."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.config import Variable
from daygrid.functions.quantiles import levels
from daygrid.operators import blend as B
from daygrid.operators import correction as Q
from daygrid.operators import polygon as P

# --- reference ------------------------------------------------------------------
NAMES = ("tasmax", "tasmin", "tas")


@query("ref1_completeness", "cell_id:i tasmax:4 tasmin:4 tas:4", """
 SELECT cell_id, COUNT(tasmax)/COUNT(*) AS tasmax, COUNT(tasmin)/COUNT(*) AS tasmin, COUNT(tas)/COUNT(*) AS tas FROM obs GROUP BY 1""")
def _(t):
    return B.completeness(t.obs, NAMES)


GAP = """SELECT o.cell_id, MONTH(o.day) AS month, AVG(o.tasmax - s.tasmax) AS tasmax, AVG(o.tasmin - s.tasmin) AS tasmin, AVG(o.tas - s.tas) AS tas
 FROM obs AS o JOIN sim AS s ON s.cell_id = o.cell_id AND s.day = o.day GROUP BY 1, 2"""


@query("ref2_monthly_gap", "cell_id:i month:i tasmax:3 tasmin:3 tas:3", "SELECT * FROM gap", gap=GAP)
def _(t):
    return B.monthly_gap(t.obs, t.sim, NAMES)


REGION = """SELECT cell_id FROM cells JOIN ring_edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat-y1)/(y2-y1)*(x2-x1) GROUP BY cell_id, region HAVING COUNT(*) % 2 = 1"""
MASK = """SELECT c.cell_id, COALESCE(LEAST(a, b, d) >= 0.6, FALSE) AND COALESCE(m, 0) = 12 AND c.cell_id NOT IN (SELECT cell_id FROM region) AND COALESCE(k, 0) > 0
  AND (c.cell_id % 10)/10.0 >= 0.2 AS from_primary FROM cells AS c
 LEFT JOIN (SELECT cell_id, COUNT(tasmax)/COUNT(*) AS a, COUNT(tasmin)/COUNT(*) AS b, COUNT(tas)/COUNT(*) AS d FROM obs GROUP BY 1) AS s ON s.cell_id = c.cell_id
 LEFT JOIN (SELECT cell_id, LEAST(COUNT(tasmax), COUNT(tasmin), COUNT(tas)) AS m FROM gap GROUP BY 1) AS g ON g.cell_id = c.cell_id
 LEFT JOIN (SELECT cell_id, COUNT(tas) AS k FROM sim GROUP BY 1) AS f ON f.cell_id = c.cell_id"""


def mask(t):
    land = t.cells.withColumn("land_share", (F.col("cell_id") % 10) / 10.0)
    return B.source_mask(B.completeness(t.obs, NAMES), B.monthly_gap(t.obs, t.sim, NAMES), t.sim, land,
                         P.in_region(t.cells, t.ring_edges), NAMES, 0.6, 0.2)


@query("ref3_source_mask", "cell_id:i from_primary:b", """SELECT * FROM mask""", gap=GAP, region=REGION, mask=MASK)
def _(t):
    return mask(t)


@query("ref4_blend", "cell_id:i day:d from_primary:b tas:3 tasmax:3", """
 SELECT s.cell_id, s.day, m.from_primary, CASE WHEN m.from_primary THEN COALESCE(o.tas, s.tas + g.tas) ELSE s.tas END AS tas,
  CASE WHEN m.from_primary THEN COALESCE(o.tasmax, s.tasmax + g.tasmax) ELSE s.tasmax END AS tasmax FROM sim AS s JOIN mask AS m ON m.cell_id = s.cell_id
 LEFT JOIN obs AS o ON o.cell_id = s.cell_id AND o.day = s.day LEFT JOIN gap AS g ON g.cell_id = s.cell_id AND g.month = MONTH(s.day)""",
       gap=GAP, region=REGION, mask=MASK)
def _(t):
    return B.blend(t.obs, t.sim, B.monthly_gap(t.obs, t.sim, NAMES), mask(t), ["tas", "tasmax"])


# --- quantile delta mapping -----------------------------------------------------------

N = 20  # levels of most checked runs; one uses 100
ADD, HUMID, WIND = Variable("add"), Variable("add", low=0.0, high=100.0), Variable("mul", low=0.0)
RAIN = Variable("mul", low=0.0, wet=1.0)
PRESSURE = Variable("add", mean_only=(12, 1, 2, 3))
FIRST, LAST, SPAN = 1995, 2033, 3


def level_list(n):
    return "[" + ", ".join(f"{v:.6f}" for v in levels(n)) + "]"


def qs(value, table, extra="", when="", n=N):
    return f"""SELECT cell_id, MONTH(day) AS month{extra}, LIST_TRANSFORM(QUANTILE_CONT({value}, {level_list(n)}), lambda v: ROUND(v, 9)) AS q, AVG({value}) AS mean FROM {table} {when} GROUP BY ALL"""


def values(df, name):
    return df.select("cell_id", "day", F.col(name).alias("value"))


def all_sim(t):
    return t.daily.filter("source = 'sim'")


RANKED = """LEAST(GREATEST(CASE WHEN le - lt > 1 THEN (lt + le - 1)/2.0 ELSE le - 1 + CASE WHEN hi > lo THEN (x - lo)/(hi - lo) ELSE 0 END END, 0), {top})"""


def rank_sql(table, q="q", name="f", keep="*", n=N):
    """Adds the fractional index of x among the quantiles of a row."""
    return f"""SELECT {keep}, CASE WHEN x IS NOT NULL AND {q} IS NOT NULL THEN {RANKED.format(top=n - 1)} END AS {name} FROM (SELECT *, {q}[GREATEST(le, 1)] AS lo, {q}[LEAST(le + 1, {n})] AS hi FROM (
  SELECT *, LEN(LIST_FILTER({q}, lambda v: v <= x)) AS le, LEN(LIST_FILTER({q}, lambda v: v < x)) AS lt FROM {table}) AS r0) AS r1"""


def read_sql(arr, f, n=N):
    return (f"((1 - ({f} - FLOOR({f})))*{arr}[CAST(FLOOR({f}) AS INTEGER) + 1] + ({f} - FLOOR({f}))*{arr}[LEAST(CAST(FLOOR({f}) AS INTEGER) + 2, {n})])")


def apply_sql(x, f, kind, low=None, high=None, n=N):
    r, h = read_sql("rq", f, n), read_sql("hq", f, n)
    y = f"{x} + ({r} - {h})" if kind == "add" else f"CASE WHEN {h} > 0 THEN {r}*LEAST(GREATEST({x}/{h}, 0.0), 10.0) ELSE {x} END"
    if low is not None:
        y = f"GREATEST({y}, {low})"
    if high is not None:
        y = f"LEAST({y}, {high})"
    return f"CASE WHEN {x} IS NOT NULL AND {f} IS NOT NULL THEN {y} END"


CAL_TAS = dict(r=qs("tas", "obs"), h=qs("tas", "sim"))


@query("qdm1_quantiles", "cell_id:i month:i level:i q:5 mean:4", """
 SELECT cell_id, month, l AS level, q[l + 1] AS q, mean FROM r CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS l) AS ls WHERE q IS NOT NULL""", r=qs("tas", "obs"))
def _(t):
    q = Q.quantiles(Q.by_month(values(t.obs, "tas")), N)
    return q.select("cell_id", "month", "mean", F.posexplode("q").alias("level", "q"))


@query("qdm2_3_calibration", "cell_id:i month:i level:i ref:5 hist:5", """
 SELECT r.cell_id, r.month, l AS level, CASE WHEN r.month IN (12, 1, 2, 3) THEN h.q[l+1] + (r.mean - h.mean) ELSE r.q[l+1] END AS ref, h.q[l+1] AS hist
 FROM r JOIN h USING (cell_id, month) CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS l) AS ls""", r=qs("psl", "obs"), h=qs("psl", "sim"))
def _(t):
    c = Q.calibrate(values(t.obs, "psl"), values(t.sim, "psl"), PRESSURE, N)
    return c.select("cell_id", "month", F.posexplode(F.arrays_zip("ref", "hist")).alias("level", "z")).select(
        "cell_id", "month", "level", "z.ref", "z.hist")


@query("qdm4_bias_table", "kind:s cell_id:i month:i level:i bias:5", """
 SELECT 'add' AS kind, r.cell_id, r.month, l AS level, r.q[l+1] - h.q[l+1] AS bias FROM r JOIN h USING (cell_id, month) CROSS JOIN ls UNION ALL
 SELECT 'mul', wr.cell_id, wr.month, l, CASE WHEN wh.q[l+1] > 0 THEN wr.q[l+1]/wh.q[l+1] ELSE 1 END FROM wr JOIN wh USING (cell_id, month) CROSS JOIN ls""",
       **CAL_TAS, wr=qs("sfcWind", "obs"), wh=qs("sfcWind", "sim"), ls="SELECT UNNEST(GENERATE_SERIES(0, 19)) AS l")
def _(t):
    a = Q.bias_table(Q.calibrate(values(t.obs, "tas"), values(t.sim, "tas"), ADD, N), ADD).withColumn("kind", F.lit("add"))
    m = Q.bias_table(Q.calibrate(values(t.obs, "sfcWind"), values(t.sim, "sfcWind"), WIND, N), WIND).withColumn("kind", F.lit("mul"))
    return a.unionByName(m).select("kind", "cell_id", "month", F.posexplode("bias").alias("level", "bias"))


@query("qdm5_rank_among_quantiles", "cell_id:i day:d f:5", "SELECT cell_id, day, f FROM ranked", r=qs("clt", "obs"),
       j="SELECT s.cell_id, s.day, s.clt AS x, r.q FROM sim AS s JOIN r ON r.cell_id = s.cell_id AND r.month = MONTH(s.day)", ranked=rank_sql("j"))
def _(t):
    from daygrid.functions.quantiles import rank_in
    q = Q.quantiles(Q.by_month(values(t.obs, "clt")), N)
    return Q.by_month(values(t.sim, "clt")).join(q, ["cell_id", "month"]).withColumn("f", rank_in("value", "q"))


def sliding(name, cal_r="obs", cal_h="sim", span=SPAN, n=N, days="(SELECT * FROM daily WHERE source = 'sim')"):
    """CTEs of the additive or multiplicative run over sliding windows."""
    return dict(
        r=qs(name, cal_r, n=n), h=qs(name, cal_h, n=n),
        wq=f"""SELECT cell_id, month, win, LIST_TRANSFORM(QUANTILE_CONT(x, {level_list(n)}), lambda v: ROUND(v, 9)) AS q FROM (
  SELECT cell_id, MONTH(day) AS month, YEAR(day) AS y, {name} AS x FROM {days} AS a) AS d
  JOIN (SELECT UNNEST(GENERATE_SERIES({FIRST}, {LAST - span + 1})) AS win) AS w ON y BETWEEN win AND win + {span - 1} GROUP BY 1, 2, 3""",
        j=f"""SELECT d.*, wq.q, r.q AS rq, h.q AS hq FROM (SELECT cell_id, day, {name} AS x, MONTH(day) AS month, LEAST(GREATEST(YEAR(day) - {span // 2}, {FIRST}), {LAST - span + 1}) AS win
  FROM {days} AS a) AS d LEFT JOIN wq USING (cell_id, month, win) JOIN r USING (cell_id, month) JOIN h USING (cell_id, month)""",
        ranked=rank_sql("j", n=n))


def run(t, name, var, fn=Q.correct, span=SPAN, n=N):
    cal = Q.calibrate(values(t.obs, name), values(t.sim, name), var, n)
    return fn(values(all_sim(t), name), cal, var, FIRST, LAST, span, n)


@query("qdm7_10_additive_sliding", "cell_id:i day:d corrected:4", f"SELECT cell_id, day, {apply_sql('x', 'f', 'add')} AS corrected FROM ranked",
       **sliding("tas"))
def _(t):
    return run(t, "tas", ADD)


@query("perf1_hundred_levels", "cell_id:i day:d corrected:4", f"SELECT cell_id, day, {apply_sql('x', 'f', 'add', n=100)} AS corrected FROM ranked",
       headline=True, **sliding("tas", span=30, n=100))
def _(t):
    return run(t, "tas", ADD, Q.correct_by_group, 30, 100)


@query("perf1_additive_by_group", "cell_id:i day:d corrected:4", f"SELECT cell_id, day, {apply_sql('x', 'f', 'add')} AS corrected FROM ranked",
       headline=True, **sliding("tas"))
def _(t):
    return run(t, "tas", ADD, Q.correct_by_group)


@query("qdm8_multiplicative_sliding", "cell_id:i day:d corrected:4",
       f"SELECT cell_id, day, {apply_sql('x', 'f', 'mul', '0.0')} AS corrected FROM ranked", **sliding("sfcWind"))
def _(t):
    return run(t, "sfcWind", WIND)


@query("qdm9_bounded_additive", "cell_id:i day:d corrected:4",
       f"SELECT cell_id, day, {apply_sql('x', 'f', 'add', '0.0', '100.0')} AS corrected FROM ranked", **sliding("clt"))
def _(t):
    return run(t, "clt", HUMID)


SORTED = """SELECT cell_id, MONTH(day) AS month, LIST_SORT(LIST(pr)) AS s FROM {table} WHERE pr IS NOT NULL GROUP BY 1, 2"""
TH = """SELECT *, GREATEST(CASE WHEN dry < n THEN hs[dry + 1] ELSE CAST('inf' AS DOUBLE) END, COALESCE(LIST_FILTER(hs, lambda v: v > 0)[1], CAST('inf' AS DOUBLE))) AS th FROM (
  SELECT *, CAST(ROUND_EVEN(LEN(LIST_FILTER(rs, lambda v: v < 1.0))/LEN(rs)*n, 0) AS BIGINT) AS dry FROM (
   SELECT a.cell_id, a.month, a.s AS rs, b.s AS hs, LEN(b.s) AS n FROM rsorted AS a JOIN hsorted AS b USING (cell_id, month)) AS x) AS y"""


def lq(cond):
    return f"(SELECT LIST_TRANSFORM(QUANTILE_CONT(v, {level_list(N)}), lambda z: ROUND(z, 9)) FROM (SELECT UNNEST({cond}) AS v) AS u)"


WET_CAL = f"""SELECT cell_id, month, th, LEN(LIST_FILTER(rs, lambda v: v >= 1.0)) AS n_ref, LEN(LIST_FILTER(hs, lambda v: v >= th)) AS n_hist,
  {lq('LIST_FILTER(rs, lambda v: v >= 1.0)')} AS rq, {lq('LIST_FILTER(hs, lambda v: v >= th)')} AS hq, {lq('LIST_FILTER(rs, lambda v: v < 1.0)')} AS drq,
  {lq('LIST_FILTER(hs, lambda v: v < th)')} AS dhq FROM ths"""
RAIN_PARTS = dict(rsorted=SORTED.format(table="obs"), hsorted=SORTED.format(table="sim"), ths=TH, wet_cal=WET_CAL)


@query("qdm11_wet_threshold", "cell_id:i month:i threshold:4 n_ref:i n_hist:i", "SELECT cell_id, month, th AS threshold, n_ref, n_hist FROM wet_cal", **RAIN_PARTS)
def _(t):
    return Q.calibrate(values(t.obs, "pr"), values(t.sim, "pr"), RAIN, N)


RAIN_RUN = dict(
    **RAIN_PARTS,
    wq=f"""SELECT d.cell_id, d.month, win, LIST_TRANSFORM(QUANTILE_CONT(CASE WHEN x >= th THEN x END, {level_list(N)}), lambda v: ROUND(v, 9)) AS q FROM (
  SELECT cell_id, MONTH(day) AS month, YEAR(day) AS y, pr AS x FROM daily WHERE source = 'sim') AS d JOIN ths USING (cell_id, month)
  JOIN (SELECT UNNEST(GENERATE_SERIES({FIRST}, {LAST - SPAN + 1})) AS win) AS w ON y BETWEEN win AND win + {SPAN - 1} GROUP BY 1, 2, 3""",
    j=f"""SELECT d.*, wq.q, c.* EXCLUDE (cell_id, month) FROM (SELECT cell_id, day, pr AS x, MONTH(day) AS month, LEAST(GREATEST(YEAR(day) - {SPAN // 2}, {FIRST}), {LAST - SPAN + 1}) AS win
  FROM daily WHERE source = 'sim') AS d LEFT JOIN wq USING (cell_id, month, win) JOIN wet_cal AS c USING (cell_id, month)""",
    ranked=rank_sql("j", keep="* EXCLUDE (le, lt, lo, hi)"), ranked_dry=rank_sql("ranked", "dhq", "g"))
RAIN_SQL = f"""SELECT cell_id, day, CASE WHEN x IS NULL THEN NULL WHEN x < th THEN CASE WHEN dhq IS NULL THEN 0.0 ELSE {read_sql('drq', 'g')} END
  WHEN n_ref >= 10 AND n_hist >= 10 AND q IS NOT NULL THEN {apply_sql('x', 'f', 'mul', '0.0')} ELSE x END AS corrected FROM ranked_dry"""


def rain(t, fn):
    cal = Q.calibrate(values(t.obs, "pr"), values(t.sim, "pr"), RAIN, N)
    return fn(values(all_sim(t), "pr"), cal, RAIN, FIRST, LAST, SPAN, N, 10)


@query("qdm12_13_rain", "cell_id:i day:d corrected:4", RAIN_SQL, **RAIN_RUN)
def _(t):
    return rain(t, Q.correct)


@query("perf1_rain_by_group", "cell_id:i day:d corrected:4", RAIN_SQL, **RAIN_RUN)
def _(t):
    return rain(t, Q.correct_by_group)


@query("qdm15_fine_grid", "cell_id:i month:i days:i corrected:3",
       f"SELECT cell_id, MONTH(day) AS month, COUNT(x) AS days, AVG({apply_sql('x', 'f', 'add')}) AS corrected FROM ranked GROUP BY 1, 2",
       fo="SELECT fine_id AS cell_id, day, tas FROM daily010 WHERE source = 'obs'", fs="SELECT fine_id AS cell_id, day, tas FROM daily010 WHERE source = 'sim'",
       fh="SELECT * FROM fs WHERE day <= DATE '2001-12-31'", **sliding("tas", "fo", "fh", days="fs"))
def _(t):
    """Calibrated over the days both sources have, applied to every simulated day by its sliding window."""
    f = t.daily010.withColumnRenamed("fine_id", "cell_id").drop("eobs")
    sim = f.filter("source = 'sim'")
    cal = Q.calibrate(values(f.filter("source = 'obs'"), "tas"), values(sim.filter("day <= DATE '2001-12-31'"), "tas"), ADD, N)
    out = Q.correct_by_group(values(sim, "tas"), cal, ADD, FIRST, LAST, SPAN, N)
    return out.groupBy("cell_id", F.month("day").alias("month")).agg(
        F.count("value").alias("days"), F.avg("corrected").alias("corrected"))


HALF1, HALF2 = (1995, 1997), (1998, 2001)


@query("qdm16_split_sample", "cell_id:i day:d corrected:4", f"SELECT cell_id, day, {apply_sql('x', 'f', 'add')} AS corrected FROM ranked",
       r=qs("tas", "obs", when="WHERE YEAR(day) <= 1997"), h=qs("tas", "sim", when="WHERE YEAR(day) <= 1997"), w=qs("tas", "sim", when="WHERE YEAR(day) >= 1998"),
       j="""SELECT d.cell_id, d.day, d.tas AS x, w.q, r.q AS rq, h.q AS hq FROM sim AS d JOIN r ON r.cell_id = d.cell_id AND r.month = MONTH(d.day)
 JOIN h ON h.cell_id = d.cell_id AND h.month = MONTH(d.day) LEFT JOIN w ON w.cell_id = d.cell_id AND w.month = MONTH(d.day) WHERE YEAR(d.day) >= 1998""",
       ranked=rank_sql("j"))
def _(t):
    return Q.split_sample(values(t.obs, "tas"), values(t.sim, "tas"), ADD, HALF1, HALF2, N)


@query("qdm17_reliability", "cell_id:i month:i slope:4 reliability:s", """
 SELECT cell_id, month, MIN(s) AS slope, CASE WHEN MIN(s) > 0.5 THEN 'sure' WHEN MIN(s) >= 0 THEN 'weak' WHEN MIN(s) IS NOT NULL THEN 'reversed' END AS reliability FROM (
  SELECT r.cell_id, r.month, CASE WHEN h.q[2*k+2] > h.q[2*k] THEN (r.q[2*k+2] - r.q[2*k])/(h.q[2*k+2] - h.q[2*k]) END AS s FROM r JOIN h USING (cell_id, month)
  CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 9)) AS k) AS ks) AS x GROUP BY 1, 2""", **CAL_TAS)
def _(t):
    return Q.reliability(Q.calibrate(values(t.obs, "tas"), values(t.sim, "tas"), ADD, N), N)


@query("val21_quantile_pairs", "cell_id:i level:i ref:4 hist:4 bias:4", """
 SELECT r.cell_id, l AS level, r.q[l+1] AS ref, h.q[l+1] AS hist, r.q[l+1] - h.q[l+1] AS bias FROM r JOIN h USING (cell_id, month) CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS l) AS ls
 WHERE month = 7""", **CAL_TAS)
def _(t):
    c = Q.calibrate(values(t.obs, "tas"), values(t.sim, "tas"), ADD, N).filter("month = 7")
    return c.select("cell_id", F.posexplode(F.arrays_zip("ref", "hist")).alias("level", "z")).select(
        "cell_id", "level", "z.ref", "z.hist", (F.col("z.ref") - F.col("z.hist")).alias("bias"))
