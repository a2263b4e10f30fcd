"""Queries: sources, sinks, checks, records, searches."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.operators import records as R
from daygrid.sources import checks, export, layout, packed, places, provenance, stations

NINE = ("tasmax", "tasmin", "tas", "pr", "clt", "hurs", "sfcWind", "psl", "rsds")


@query("src1_read_daily", "source:s cell_id:i day:d tasmax:2 pr:1", """
 SELECT source, cell_id, day, tasmax, pr FROM daily WHERE source = 'sim' AND day BETWEEN DATE '2027-06-01' AND DATE '2031-08-31'""")
def _(t):
    return layout.read_daily(t.daily, "sim", ("tasmax", "pr"), "2027-06-01", "2031-08-31")


PACK_SQL = """SELECT source, cell_id, day, """ + ", ".join(
    f"COALESCE(CAST(ROUND_EVEN({n}/{s}, 0) AS BIGINT), {f}) AS {n}" for n, (s, f) in {
        "tasmax": (0.01, -32768), "tasmin": (0.01, -32768), "tas": (0.01, -32768), "pr": (0.1, 65535),
        "clt": (0.01, 65535), "hurs": (0.01, 65535), "sfcWind": (0.01, 65535), "psl": (0.1, 65535),
        "rsds": (0.1, 65535)}.items()) + " FROM daily"


@query("src3_pack", "source:s cell_id:i day:d tasmax:i tasmin:i tas:i pr:i clt:i hurs:i sfcWind:i psl:i rsds:i", PACK_SQL)
def _(t):
    return packed.pack(t.daily)


@query("src2_unpack", "source:s cell_id:i day:d tasmax:f tasmin:f tas:f pr:f clt:f hurs:f sfcWind:f psl:f rsds:f",
       "SELECT source, cell_id, day, " + ", ".join(f"ROUND_EVEN({n}, 2) AS {n}" for n in NINE) + " FROM daily")
def _(t):
    return packed.unpack(packed.pack(t.daily))


@query("src4_unit_conversion", "source:s cell_id:i day:d celsius:4 mm:4 mm_day:4 percent:4 hpa:4 watt:4 kmh:4", """
 SELECT source, cell_id, day, (tas+280.0)-273.15 AS celsius, pr*1000.0 AS mm, (pr/86400.0)*86400.0 AS mm_day,
  (clt/100.0)*100.0 AS percent, (psl*100.0)/100.0 AS hpa, (rsds*86400.0)/86400.0 AS watt, sfcWind*3.6 AS kmh FROM daily""")
def _(t):
    from daygrid.functions.units import convert
    return t.daily.select(
        "source", "cell_id", "day", convert("kelvin_to_celsius", F.col("tas") + 280.0).alias("celsius"),
        convert("metre_to_mm", "pr").alias("mm"), convert("flux_to_mm_day", F.col("pr") / 86400.0).alias("mm_day"),
        convert("fraction_to_percent", F.col("clt") / 100.0).alias("percent"),
        convert("pascal_to_hpa", F.col("psl") * 100.0).alias("hpa"),
        convert("joule_day_to_watt", F.col("rsds") * 86400.0).alias("watt"), convert("ms_to_kmh", "sfcWind").alias("kmh"))


@query("src5_model_units", "source:s cell_id:i day:d pr:8 clt:4 evspsbl:8 alb:4 rsus:4", """
 SELECT source, cell_id, day, pr*1000.0/86400.0 AS pr, clt*100.0 AS clt, -tas*1000.0/86400.0 AS evspsbl,
  CASE WHEN rsds IS NOT NULL AND clt IS NOT NULL THEN LEAST(GREATEST(((rsds - clt)/86400.0)/GREATEST(rsds/86400.0, 1.0), 0.0), 1.0) END AS alb,
  (rsds - clt)/86400.0 AS rsus FROM daily""")
def _(t):
    from daygrid.functions.units import to_model
    return t.daily.select(
        "source", "cell_id", "day", to_model("pr", "pr").alias("pr"), to_model("clt", "clt").alias("clt"),
        to_model("evspsbl", "tas").alias("evspsbl"), to_model("alb", "rsds", "clt").alias("alb"),
        to_model("rsus", "rsds", "clt").alias("rsus"))


@query("src8_complete_years", "source:s cell_id:i year:i rows:i days:i complete:b", """
 SELECT source, cell_id, YEAR(day) AS year, COUNT(*) AS rows, COUNT(DISTINCT day) AS days,
  COUNT(*) = MAX(DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31))) AND COUNT(DISTINCT day) = MAX(DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31))) AS complete
 FROM (SELECT source, cell_id, day FROM daily UNION ALL SELECT source, cell_id, day FROM base WHERE tas_i > 2800) AS d
 GROUP BY 1, 2, 3""")
def _(t):
    extra = t.base.filter("tas_i > 2800").select("source", "cell_id", "day")
    return checks.completeness(t.daily.select("source", "cell_id", "day").unionByName(extra))


@query("src9_reconcile", "variable:s lone_rows:i lone_gaps:i largest:4 agrees:b", """
 SELECT variable, SUM(CASE WHEN ha IS NULL OR hb IS NULL THEN 1 ELSE 0 END) AS lone_rows,
  SUM(CASE WHEN ha IS NOT NULL AND hb IS NOT NULL AND (va IS NULL) <> (vb IS NULL) THEN 1 ELSE 0 END) AS lone_gaps,
  MAX(ABS(va - vb)) AS largest,
  SUM(CASE WHEN ha IS NULL OR hb IS NULL THEN 1 ELSE 0 END) = 0
   AND SUM(CASE WHEN ha IS NOT NULL AND hb IS NOT NULL AND (va IS NULL) <> (vb IS NULL) THEN 1 ELSE 0 END) = 0
   AND COALESCE(MAX(ABS(va - vb)), 0.0) <= CASE variable WHEN 'tas' THEN 0.5 WHEN 'pr' THEN 0.1 ELSE 2.0 END/2 + 0.0001 AS agrees
 FROM (SELECT variable, va, vb, ha, hb FROM a FULL JOIN b USING (source, cell_id, day, variable)) AS j GROUP BY variable""",
       a="""SELECT source, cell_id, day, 'tas' AS variable, tas AS va, 1 AS ha FROM daily UNION ALL
 SELECT source, cell_id, day, 'pr', pr, 1 FROM daily UNION ALL SELECT source, cell_id, day, 'hurs', hurs, 1 FROM daily""",
       b="""SELECT source, cell_id, day, 'tas' AS variable, ROUND_EVEN(tas/0.5, 0)*0.5 AS vb, 1 AS hb FROM daily UNION ALL
 SELECT source, cell_id, day, 'pr', CASE WHEN pr < 3 THEN pr END, 1 FROM daily UNION ALL
 SELECT source, cell_id, day, 'hurs', hurs + 1.0, 1 FROM daily""")
def _(t):
    other = t.daily.withColumns({
        "tas": F.bround(F.col("tas") / 0.5, 0) * 0.5, "pr": F.when(F.col("pr") < 3, F.col("pr")),
        "hurs": F.col("hurs") + 1.0})
    return checks.reconcile(t.daily, other, {"tas": 0.5, "pr": 0.1, "hurs": 2.0})


@query("src10_one_run", "p_type:s arrays:i runs:i named:i consistent:b", """
 SELECT p_type, COUNT(*) AS arrays, COUNT(DISTINCT run) AS runs, COUNT(run) AS named,
  COUNT(DISTINCT run) = 1 AND COUNT(run) = COUNT(*) AS consistent
 FROM (SELECT p_type, CASE WHEN p_type = 'ECONOMY' THEN 'one' WHEN p_size > 2 THEN p_brand END AS run FROM part) AS p GROUP BY p_type""")
def _(t):
    p = t.raw("part").selectExpr(
        "p_type", "CASE WHEN p_type = 'ECONOMY' THEN 'one' WHEN p_size > 2 THEN p_brand END AS run")
    return checks.one_run(p, ["p_type"], "run")


STORED_ARRAYS = """SELECT p_partkey // 40 AS store, CASE WHEN k < 18 THEN 'obs' ELSE 'sim' END AS source, CASE WHEN (k // 9) % 2 = 0 THEN 'coarse' ELSE 'fine' END AS grid,
  (['tasmax', 'tasmin', 'tas', 'pr', 'clt', 'hurs', 'sfcWind', 'psl', 'rsds'])[k % 9 + 1] AS variable,
  CASE WHEN p_size = 1 THEN NULL WHEN p_size > 45 THEN p_brand ELSE 'blend' END AS dataset, CASE WHEN (p_partkey // 40) % 2 = 0 OR p_size = 7 THEN 'rest' END AS fallback,
  CASE WHEN k >= 18 AND p_size <> 2 THEN CASE WHEN p_size = 3 THEN p_brand ELSE 'run ' || (p_partkey // 40) % 3 END END AS run
 FROM (SELECT *, p_partkey % 40 AS k FROM part) AS p WHERE k < 36 AND ((k // 9) % 2 = 0 OR k % 9 < 3)"""
STORE_MASKS = """SELECT DISTINCT p_partkey // 40 AS store, grid FROM part CROSS JOIN (VALUES ('coarse'), ('fine')) AS g(grid)
 WHERE (p_partkey // 40) % 3 <> 0 OR grid = 'coarse'"""


def stored_arrays(t):
    """Arrays of many stores, forty parts to a store, with what parts of odd sizes leave out or name otherwise."""
    p = t.raw("part").selectExpr("*", "p_partkey div 40 AS store", "CAST(p_partkey % 40 AS INT) AS k").filter("k < 36 AND ((k div 9) % 2 = 0 OR k % 9 < 3)")
    variables = ", ".join(f"'{n}'" for n in NINE)
    return p.selectExpr(
        "store", "IF(k < 18, 'obs', 'sim') AS source", "IF((k div 9) % 2 = 0, 'coarse', 'fine') AS grid", f"array({variables})[k % 9] AS variable",
        "CASE WHEN p_size = 1 THEN NULL WHEN p_size > 45 THEN p_brand ELSE 'blend' END AS dataset", "CASE WHEN store % 2 = 0 OR p_size = 7 THEN 'rest' END AS fallback",
        "CASE WHEN k >= 18 AND p_size <> 2 THEN IF(p_size = 3, p_brand, concat('run ', store % 3)) END AS run")


def store_masks(t):
    stores = t.raw("part").selectExpr("p_partkey div 40 AS store").distinct()
    return stores.select("store", F.explode(F.array(F.lit("coarse"), F.lit("fine"))).alias("grid")).filter("store % 3 <> 0 OR grid = 'coarse'")


@query("src10_provenance_faults", "store:i source:s grid:s variable:s rule:s", """
 SELECT store, source, grid, variable, 'dataset_unnamed' AS rule FROM arrays WHERE dataset IS NULL
 UNION ALL SELECT store, source, grid, variable, 'mixed_temperatures' FROM arrays AS a WHERE variable IN ('tasmax', 'tasmin', 'tas') AND EXISTS (
  SELECT 1 FROM arrays AS b WHERE b.store = a.store AND b.source = a.source AND b.grid = a.grid AND b.variable IN ('tasmax', 'tasmin', 'tas')
   AND (b.dataset IS DISTINCT FROM a.dataset OR b.fallback IS DISTINCT FROM a.fallback))
 UNION ALL SELECT store, source, grid, variable, 'run_unnamed' FROM arrays WHERE source = 'sim' AND run IS NULL
 UNION ALL SELECT a.store, source, grid, variable, 'other_run' FROM arrays AS a JOIN (SELECT store, ARG_MIN(run, grid || ' ' || variable) AS first_run FROM arrays
  WHERE source = 'sim' AND run IS NOT NULL GROUP BY 1) AS f ON f.store = a.store WHERE source = 'sim' AND run <> first_run
 UNION ALL SELECT a.store, source, a.grid, variable, 'fallback_without_mask' FROM arrays AS a LEFT JOIN masks AS m ON m.store = a.store AND m.grid = a.grid
  WHERE fallback IS NOT NULL AND m.grid IS NULL""", arrays=STORED_ARRAYS, masks=STORE_MASKS)
def _(t):
    return provenance.faults(stored_arrays(t), store_masks(t), ["store"], "sim")


@query("src11_covers", "source:s held_from:d held_to:d covered:b", """
 SELECT p.source, held_from, held_to, COALESCE(held_from <= first_day AND held_to >= last_day, FALSE) AS covered FROM periods AS p
 LEFT JOIN (SELECT source, MIN(day) AS held_from, MAX(day) AS held_to FROM grown GROUP BY source) AS h ON h.source = p.source""")
def _(t):
    return checks.covers(t.grown, t.periods)


@query("src12_domain", "source:s cell_id:i inside:b", """
 SELECT source, cell_id, ARG_MIN(tasmax IS NOT NULL, day) AS inside FROM daily GROUP BY source, cell_id""")
def _(t):
    return checks.domain(t.daily)


@query("map2_served_variables", "variable:s sources:i all_built:b named:b served:b", """
 SELECT variable, COUNT(DISTINCT source) AS sources, MIN(built IS NOT NULL) AS all_built,
  MAX(source = 'cordex' AND simulation IS NOT NULL) AS named,
  COUNT(DISTINCT source) = 2 AND MIN(built IS NOT NULL) AND MAX(source = 'cordex' AND simulation IS NOT NULL) AS served
 FROM (SELECT p_brand AS variable, CASE WHEN p_partkey % 2 = 0 THEN 'era5' ELSE 'cordex' END AS source,
  CASE WHEN p_size > 1 OR p_brand < 'Brand#2' THEN p_size END AS built, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS simulation FROM part) AS p
 GROUP BY variable""")
def _(t):
    p = t.raw("part").selectExpr(
        "p_brand AS variable", "CASE WHEN p_partkey % 2 = 0 THEN 'era5' ELSE 'cordex' END AS source",
        "CASE WHEN p_size > 1 OR p_brand < 'Brand#2' THEN p_size END AS built",
        "CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS simulation")
    return checks.served_variables(p)


@query("src13_build_places", "gid:i name:s lat:4 lon:4 country:s population:i", """
 SELECT c.place_id AS gid, CASE WHEN country = 'FRANCE' THEN c.name ELSE COALESCE(best_name, c.name) END AS name,
  ROUND_EVEN(lat, 4) AS lat, ROUND_EVEN(lon, 4) AS lon, country, population
 FROM places AS c JOIN customer ON c_custkey = c.place_id LEFT JOIN best ON gid = c.place_id
 WHERE c_mktsegment <> 'BUILDING' AND lat BETWEEN 45.1 AND 45.9 AND lon BETWEEN 4.8 AND 5.8""",
       best="""SELECT o_custkey AS gid, ARG_MIN(o_orderpriority || ' ' || o_orderkey, r*100000000000 + o_orderkey) AS best_name FROM (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 2 END AS r FROM orders
  WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 7 <> 0) AS o GROUP BY o_custkey""")
def _(t):
    cities = t.places.join(
        t.raw("customer").selectExpr("c_custkey AS place_id", "if(c_mktsegment = 'BUILDING', 'PPLX', 'PPL') AS code"),
        "place_id").withColumnRenamed("place_id", "gid")
    names = t.raw("orders").selectExpr(
        "o_custkey AS gid", "o_orderkey AS position", "concat(o_orderpriority, ' ', o_orderkey) AS name",
        "o_orderstatus = 'F' AS preferred", "o_orderkey % 4 = 0 AS short", "o_orderpriority = '5-LOW' AS colloquial",
        "o_orderkey % 7 = 0 AS historic")
    return places.build_places(cities, names, 45.1, 45.9, 4.8, 5.8, "FRANCE")


@query("join11_largest_towns", "place_id:i name:s population:i", """
 SELECT place_id, name, population FROM places WHERE population >= 500000""")
def _(t):
    return places.largest(t.places, 500_000)


@query("src14_station_lines", "station_id:i valid:i mean:4 lowest:1", """
 SELECT l_suppkey AS station_id, COUNT(*) AS valid, AVG((CAST(l_quantity AS BIGINT)*7 - 20)/10.0) AS mean,
  MIN((CAST(l_quantity AS BIGINT)*7 - 20)/10.0) AS lowest FROM lineitem
 WHERE l_returnflag <> 'R' AND CAST(l_quantity AS BIGINT)*7 - 20 >= 0 GROUP BY l_suppkey HAVING COUNT(*) >= 0.05*2557""")
def _(t):
    lines = t.raw("lineitem").select(F.concat_ws(
        ",", F.format_string("%6d", "l_suppkey"), F.lit("   101"), F.date_format("l_shipdate", "yyyyMMdd"),
        (F.col("l_quantity").cast("long") * 7 - 20).cast("string"),
        F.when(F.col("l_returnflag") != "R", " 0").otherwise(" 9")).alias("value"))
    lines = lines.union(t.raw("supplier").select(F.lit("STAID, SOUID,    DATE,   TX, Q_TX").alias("value")))
    daily = stations.parse_daily(lines, keep_negative=False)
    figures = daily.groupBy("station_id").agg(F.avg("value").alias("mean"), F.min("value").alias("lowest"))
    return stations.well_observed(daily, 2557, 0.05).join(figures, "station_id")


@query("src14_station_list", "station_id:i name:s lat:6 lon:6 elevation:1", """
 SELECT s_suppkey AS station_id, s_name AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (CAST(40 + s_suppkey % 20 AS DOUBLE) + (s_suppkey % 60)/60.0 + (s_suppkey*7 % 60)/3600.0) AS lat,
  CAST(s_suppkey % 30 AS DOUBLE) + (s_suppkey*11 % 60)/60.0 + (s_suppkey*13 % 60)/3600.0 AS lon,
  CAST((s_suppkey*53)%2000 AS DOUBLE) AS elevation FROM supplier""")
def _(t):
    text = t.raw("supplier").selectExpr(
        "concat(s_suppkey, ',', s_name, '  ,FR,', if(s_suppkey % 3 = 0, '-', '+'), 40 + s_suppkey % 20, ':', s_suppkey % 60, ':', "
        "s_suppkey*7 % 60, ',+', s_suppkey % 30, ':', s_suppkey*11 % 60, ':', s_suppkey*13 % 60, ',', (s_suppkey*53)%2000) AS value")
    return stations.parse_stations(text)


CSV_SQL = """SELECT source, cell_id, day, CAST(day AS VARCHAR) || ';' || CASE WHEN source = 'sim' THEN 'simulated' ELSE 'observed' END || ';'
  || COALESCE(CASE WHEN ROUND_EVEN(tas, 0) = tas THEN CAST(CAST(tas AS BIGINT) AS VARCHAR) ELSE REPLACE(CAST(tas AS VARCHAR), '.', ',') END, '') || ';'
  || COALESCE(CASE WHEN ROUND_EVEN(pr, 0) = pr THEN CAST(CAST(pr AS BIGINT) AS VARCHAR) ELSE REPLACE(CAST(pr AS VARCHAR), '.', ',') END, '') AS line FROM daily"""


@query("src15_csv_lines", "source:s cell_id:i day:d line:s", CSV_SQL)
def _(t):
    r = R.records(t.daily, "sim").withColumn("day", F.col("date"))
    return export.csv_lines(r, ("date", "origin", "temperature_mean", "precipitation"), ("source", "cell_id", "day"))


YEARLY = "SELECT source, YEAR(day) AS year, AVG(tas) AS tas, SUM(pr) AS pr, MAX(tasmax) AS tasmax, COUNT(tas) AS days FROM daily GROUP BY 1, 2"


@query("src16_long_results", "source:s year:i days:i variable:s value:3", """
 SELECT source, year, days, 'tas' AS variable, tas AS value FROM y UNION ALL SELECT source, year, days, 'pr', pr FROM y
 UNION ALL SELECT source, year, days, 'tasmax', tasmax FROM y""", y=YEARLY)
def _(t):
    y = t.daily.groupBy("source", F.year("day").alias("year")).agg(
        F.avg("tas").alias("tas"), F.sum("pr").alias("pr"), F.max("tasmax").alias("tasmax"), F.count("tas").alias("days"))
    return export.long_results(y, ("source", "year", "days"), ("tas", "pr", "tasmax"))


@query("src17_wide_results", "year:i obs:3 sim:3", """
 SELECT year, MAX(CASE WHEN source = 'obs' THEN tas END) AS obs, MAX(CASE WHEN source = 'sim' THEN tas END) AS sim FROM y GROUP BY year""",
       y=YEARLY)
def _(t):
    y = t.daily.groupBy("source", F.year("day").alias("year")).agg(F.avg("tas").alias("value"))
    return export.wide_results(y, ["year"], "source", ["obs", "sim"])


@query("proj1_records", "source:s cell_id:i date:d origin:s temperature_max:2 precipitation:1 wind_speed_mean:4", """
 SELECT source, cell_id, day AS date, CASE WHEN source = 'sim' THEN 'simulated' ELSE 'observed' END AS origin,
  tasmax AS temperature_max, pr AS precipitation, sfcWind*3.6 AS wind_speed_mean FROM daily""")
def _(t):
    return R.records(t.daily, "sim")


@query("proj2_dataset_label", "cell_id:i source:s label:s", """
 SELECT cell_id, source, CASE WHEN source = 'sim' THEN 'RCM' WHEN eobs THEN 'E-OBS (temperatures), ERA5' ELSE 'ERA5' END AS label
 FROM cells CROSS JOIN (VALUES ('obs'), ('sim')) AS s(source)""")
def _(t):
    prov = F.expr("array(struct('obs' AS source, 'E-OBS' AS temperatures, 'ERA5' AS fallback, 'ERA5' AS rest), "
                  "struct('sim' AS source, 'RCM' AS temperatures, CAST(NULL AS STRING) AS fallback, 'RCM' AS rest))")
    return t.cells.select("*", F.inline(prov)).withColumn("label", R.dataset_label(
        F.col("temperatures"), F.col("fallback"), F.col("eobs"), F.col("rest")))


@query("proj3_transform_hook", "source:s cell_id:i day:d tas:2", "SELECT source, cell_id, day, tas + 1.5 AS tas FROM daily")
def _(t):
    return R.transformed(t.daily, lambda df: df.withColumn("tas", F.col("tas") + 1.5))


VALIDATED = """SELECT s.search_id, s.place_id, s.first_day, s.last_day, p.source, DATE_DIFF('day', s.first_day, s.last_day) + 1 AS days,
  CASE WHEN s.first_day > s.last_day THEN 'EmptyRange' WHEN DATE_DIFF('day', s.first_day, s.last_day) + 1 > 92 THEN 'RangeTooLong'
   WHEN p.source IS NULL THEN 'Unavailable' ELSE 'ok' END AS status
 FROM searches AS s LEFT JOIN periods AS p ON p.first_day <= s.first_day AND s.last_day <= p.last_day"""


@query("filt1_validate_searches", "search_id:i source:s days:i status:s", VALIDATED)
def _(t):
    return R.validate(t.searches, t.periods)


# A third of the cells have no gap.
@query("filt4_always_valid", "source:s cell_id:i", """
 SELECT source, cell_id FROM (SELECT source, cell_id, CASE WHEN cell_id % 3 = 0 THEN COALESCE(tas, 0) ELSE tas END AS tas FROM daily) AS d GROUP BY 1, 2
 HAVING BOOL_AND(tas IS NOT NULL)""")
def _(t):
    return R.always_valid(t.daily.withColumn("tas", F.expr("if(cell_id % 3 = 0, coalesce(tas, 0D), tas)")), "tas")


@query("filt5_enough_days", "source:s cell_id:i winter_year:i rows:i valid:i scale:4", """
 SELECT source, cell_id, YEAR(day) + CASE WHEN MONTH(day) >= 8 THEN 1 ELSE 0 END AS winter_year, COUNT(*) AS rows, COUNT(tas) AS valid,
  COUNT(*) / COUNT(tas) AS scale FROM daily WHERE MONTH(day) IN (11, 12, 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING COUNT(tas) >= 0.6*COUNT(*)""")
def _(t):
    from daygrid.functions.calendar import in_snow_season, snow_year
    w = t.daily.filter(in_snow_season("day")).withColumn("winter_year", snow_year("day"))
    return R.enough(w, "tas", 0.6, ["source", "cell_id", "winter_year"])
