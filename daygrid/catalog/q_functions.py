"""Queries: calendar columns and scalar climate functions, over every day of the daily table."""

from pyspark.sql import functions as F

from daygrid.catalog.base import query
from daygrid.functions import calendar as C
from daygrid.functions import classes, et0, geo, humidity
from daygrid.operators import hourly as H

IDS = ["source", "cell_id", "day"]


@query("cal1_to_6_calendar_keys",
       "source:s cell_id:i day:d year:i month:i dom:i slot366:i slot365:i snow_year:i winter:b season:s season_year:i", """
 SELECT source, cell_id, day, YEAR(day) AS year, MONTH(day) AS month, DAY(day) AS dom,
  DATE_DIFF('day', DATE '2000-01-01', MAKE_DATE(2000, MONTH(day), DAY(day))) AS slot366,
  CASE WHEN MONTH(day) = 2 AND DAY(day) = 29 THEN 58 ELSE DATE_DIFF('day', DATE '2001-01-01', MAKE_DATE(2001, MONTH(day), DAY(day))) END AS slot365,
  YEAR(day) + CASE WHEN MONTH(day) >= 8 THEN 1 ELSE 0 END AS snow_year, MONTH(day) >= 11 OR MONTH(day) <= 4 AS winter,
  CASE (MONTH(day) % 12) // 3 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END AS season,
  YEAR(day) + MONTH(day) // 12 AS season_year FROM daily""")
def _(t):
    return C.with_calendar(t.daily)


@query("cal4_shifted_dates", "search_id:i years:i first_shifted:d last_shifted:d", """
 SELECT search_id, y AS years, CAST(first_day + TO_YEARS(CAST(y AS INTEGER)) AS DATE) AS first_shifted,
  CAST(last_day + TO_YEARS(CAST(y AS INTEGER)) AS DATE) AS last_shifted
 FROM (SELECT *, UNNEST(GENERATE_SERIES(-3, 5)) AS y FROM searches) AS s""")
def _(t):
    s = t.searches.select("*", F.explode(F.sequence(F.lit(-3), F.lit(5))).alias("years"))
    return s.withColumns({"first_shifted": C.shifted("first_day", "years"), "last_shifted": C.shifted("last_day", "years")})


@query("cal7_display_seasons", "search_id:i season:s days_in_season:i title:s", """
 SELECT search_id, season, n AS days_in_season, CASE WHEN MONTH(first_day)*100+DAY(first_day) IN (321, 621, 921, 1221)
   AND last_day = CAST(CAST(first_day + INTERVAL 3 MONTH AS DATE) - 1 AS DATE)
   THEN CASE MONTH(first_day) WHEN 3 THEN 'spring' WHEN 6 THEN 'summer' WHEN 9 THEN 'autumn' ELSE 'winter' END || ' ' || YEAR(first_day)
    || CASE WHEN MONTH(first_day) = 12 THEN '-' || (YEAR(first_day) + 1) ELSE '' END ELSE CAST(first_day AS VARCHAR) || ' / ' || CAST(last_day AS VARCHAR) END AS title
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY search_id ORDER BY n DESC, latest DESC) AS k FROM (
  SELECT search_id, first_day, last_day, opens, season, COUNT(*) AS n, MAX(day) AS latest FROM (
   SELECT search_id, first_day, last_day, day, CASE WHEN south THEN o ELSE s END AS season, CASE WHEN south THEN o1 ELSE s1 END AS opens FROM (
    SELECT *, CASE s WHEN 'spring' THEN 'autumn' WHEN 'summer' THEN 'winter' WHEN 'autumn' THEN 'spring' ELSE 'summer' END AS o,
     CASE s1 WHEN 'spring' THEN 'autumn' WHEN 'summer' THEN 'winter' WHEN 'autumn' THEN 'spring' ELSE 'summer' END AS o1 FROM (
     SELECT *, CASE WHEN m < 321 OR m >= 1221 THEN 'winter' WHEN m < 621 THEN 'spring' WHEN m < 921 THEN 'summer' ELSE 'autumn' END AS s,
      CASE WHEN m1 < 321 OR m1 >= 1221 THEN 'winter' WHEN m1 < 621 THEN 'spring' WHEN m1 < 921 THEN 'summer' ELSE 'autumn' END AS s1 FROM (
      SELECT search_id, first_day, last_day, place_id % 4 = 0 AS south, day, MONTH(day)*100+DAY(day) AS m, MONTH(first_day)*100+DAY(first_day) AS m1 FROM (
       SELECT *, CAST(UNNEST(GENERATE_SERIES(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM searches WHERE first_day <= last_day) AS a) AS b) AS c) AS d) AS e
  GROUP BY ALL) AS f) AS g WHERE k = 1""")
def _(t):
    s = t.searches.withColumn("lat", F.expr("if(place_id % 4 = 0, -45D, 45D)"))
    best = C.dominant_season(s, "search_id")
    return best.join(s, "search_id").withColumn("title", C.season_title("first_day", "last_day"))


@query("cal7_season_requests", "place_id:i season:s year:i source:s first_day:d last_day:d", """
 SELECT place_id, season, y AS year, source, a AS first_day, b AS last_day FROM (
  SELECT place_id, season, y, source, f, l, MAKE_DATE(y, m, 21) AS a,
   CAST(CAST(MAKE_DATE(y, m, 21) + INTERVAL 3 MONTH AS DATE) - 1 AS DATE) AS b FROM (
   SELECT place_id, source, first_day AS f, last_day AS l, UNNEST(GENERATE_SERIES(YEAR(first_day), YEAR(last_day))) AS y,
    season, CASE WHEN lat < 45.5 THEN (m + 6 - 1) % 12 + 1 ELSE m END AS m
   FROM places CROSS JOIN periods CROSS JOIN (VALUES ('spring', 3), ('summer', 6), ('autumn', 9), ('winter', 12)) AS s(season, m)) AS x) AS z
 WHERE a >= f AND b <= l""")
def _(t):
    p = t.places.select("place_id", F.expr("lat - 45.5D").alias("lat"))
    return C.season_requests(p, t.periods)


@query("cal8_9_10_windows", "search_id:i mid_year:i slide_from:i window_from:i window_to:i", """
 SELECT search_id, mid AS mid_year, LEAST(GREATEST(mid - 15, 1970), 2071) AS slide_from,
  LEAST(GREATEST(mid - 2, YEAR(first_day)), YEAR(last_day) - 4) AS window_from,
  LEAST(GREATEST(mid - 2, YEAR(first_day)), YEAR(last_day) - 4) + 4 AS window_to FROM (
  SELECT search_id, YEAR(CAST(first_day + CAST(FLOOR(DATE_DIFF('day', first_day, last_day)/2) AS INTEGER) AS DATE)) AS mid FROM searches) AS s
 JOIN periods AS p ON mid BETWEEN YEAR(first_day) AND YEAR(last_day)""")
def _(t):
    from daygrid.operators.climate import windows
    s = t.searches.withColumn("mid_year", C.mid_year("first_day", "last_day"))
    return windows(s, t.periods, "mid_year", 5).withColumn("slide_from", C.sliding_first("mid_year"))


@query("cal11_season_titles", "place_id:i season:s year:i title:s", """
 SELECT place_id, season, year, season || ' ' || year || CASE WHEN season = 'winter' THEN '-' || (year + 1) ELSE '' END AS title FROM (
  SELECT place_id, season, y AS year FROM (
   SELECT place_id, first_day AS f, last_day AS l, UNNEST(GENERATE_SERIES(YEAR(first_day), YEAR(last_day))) AS y, season, m
   FROM places CROSS JOIN periods CROSS JOIN (VALUES ('spring', 3), ('summer', 6), ('autumn', 9), ('winter', 12)) AS s(season, m)) AS x
  WHERE MAKE_DATE(y, m, 21) >= f AND CAST(CAST(MAKE_DATE(y, m, 21) + INTERVAL 3 MONTH AS DATE) - 1 AS DATE) <= l) AS z""")
def _(t):
    r = C.season_requests(t.places.select("place_id", "lat"), t.periods)
    return r.withColumn("title", C.season_title("first_day", "last_day"))


@query("scal1_ordered_extremes", "source:s cell_id:i day:d tasmin:2 tasmax:2", """
 SELECT source, cell_id, day, CASE WHEN tasmin+9 > tasmax THEN tasmax ELSE tasmin+9 END AS tasmin,
  CASE WHEN tasmin+9 > tasmax THEN tasmin+9 ELSE tasmax END AS tasmax FROM daily""")
def _(t):
    from daygrid.operators.derive import ordered_extremes
    return ordered_extremes(t.daily.withColumn("tasmin", F.col("tasmin") + 9))


@query("scal2_3_4_derived_fields", "source:s cell_id:i day:d huss:8 rsus:4 es:3", """
 SELECT source, cell_id, day, 0.622*e/(psl*100 - (1.0-0.622)*e) AS huss, rsds*(clt/200.0) AS rsus, es FROM (
  SELECT *, 611.21*EXP(17.502*(tas+273.15-273.16)/(tas+273.15-32.19)) AS es,
   hurs/100.0*(611.21*EXP(17.502*(tas+273.15-273.16)/(tas+273.15-32.19))) AS e FROM daily) AS d""")
def _(t):
    from daygrid.operators.derive import derived_fields
    k = t.daily.select(*IDS, "hurs", "rsds", (F.col("tas") + 273.15).alias("tas"), (F.col("psl") * 100).alias("ps"),
                       (F.col("clt") / 200.0).alias("alb"))
    return derived_fields(k).withColumn("es", humidity.saturation_pa("tas"))


FAO = """SELECT d.source, d.cell_id, d.day, d.tasmax, d.tasmin, d.hurs, d.rsds, sfcWind, COALESCE(elevation, 0) AS alt,
  0.6108*EXP(17.27*tasmax/(tasmax+237.3)) AS e1, 0.6108*EXP(17.27*tasmin/(tasmin+237.3)) AS e2,
  RADIANS(lat) AS phi, 2*PI()*DAYOFYEAR(day)/365.0 AS ang FROM daily AS d JOIN cells USING (cell_id)"""
FAO2 = """SELECT *, (e1+e2)/2 AS es, (e1+e2)/2*hurs/100 AS ea, 101.3*POW((293.0-0.0065*alt)/293.0, 5.26) AS p,
  sfcWind*4.87/LN(67.8*10.0-5.42) AS u2, 0.409*SIN(ang-1.39) AS tilt, 1+0.033*COS(ang) AS dist, rsds*0.0864 AS rs FROM fao"""
FAO3 = """SELECT *, ACOS(GREATEST(-1.0, LEAST(1.0, -TAN(phi)*TAN(tilt)))) AS ws FROM fao2"""
FAO4 = """SELECT *, 24*60/PI()*0.0820*dist*(ws*SIN(phi)*SIN(tilt)+COS(phi)*COS(tilt)*SIN(ws)) AS ra FROM fao3"""
FAO5 = """SELECT *, (0.75+0.00002*alt)*ra AS rso FROM fao4"""
FAO6 = """SELECT *, 4.903/1000000000.0*(POW(tasmax+273.16, 4)+POW(tasmin+273.16, 4))/2*(0.34-0.14*SQRT(ea))
  *(1.35*CASE WHEN rs IS NOT NULL THEN LEAST(1.0, GREATEST(0.0, CASE WHEN rso > 0 THEN rs/rso ELSE 0 END)) END - 0.35) AS rnl FROM fao5"""
FAO7 = """SELECT *, 4098*(0.6108*EXP(17.27*((tasmax+tasmin)/2)/((tasmax+tasmin)/2+237.3)))/POW((tasmax+tasmin)/2+237.3, 2) AS delta,
  0.000665*p AS gam, 0.77*rs - rnl AS rn FROM fao6"""
ET0_SQL = """SELECT source, cell_id, day, es, ea, p, u2, ra, rso, rnl, CASE WHEN rn IS NOT NULL AND u2 IS NOT NULL THEN GREATEST(0.0,
  (0.408*delta*rn + gam*900/((tasmax+tasmin)/2+273.0)*u2*(es-ea))/(delta+gam*(1+0.34*u2))) END AS et0 FROM fao7"""
FAO_PARTS = dict(fao=FAO, fao2=FAO2, fao3=FAO3, fao4=FAO4, fao5=FAO5, fao6=FAO6, fao7=FAO7)


@query("scal5_to_9_evapotranspiration",
       "source:s cell_id:i day:d es:5 ea:5 p:5 u2:5 ra:5 rso:5 rnl:5 et0:5", ET0_SQL, **FAO_PARTS)
def _(t):
    c = t.cells.select("cell_id", "lat", F.coalesce("elevation", F.lit(0.0)).alias("alt"))
    d = t.daily.join(c, "cell_id")
    es, ea = et0.mean_saturation("tasmax", "tasmin"), et0.actual_vapour("tasmax", "tasmin", "hurs")
    ra = et0.extraterrestrial("lat", F.dayofyear("day"))
    rso = et0.clear_sky(ra, "alt")
    return et0.with_et0(d, "lat", "alt").select(
        *IDS, "et0", es.alias("es"), ea.alias("ea"), et0.pressure("alt").alias("p"), et0.wind_2m("sfcWind").alias("u2"),
        ra.alias("ra"), rso.alias("rso"),
        et0.net_longwave("tasmax", "tasmin", ea, F.col("rsds") * 0.0864, rso).alias("rnl"))


WET_BULB_SQL = """SELECT source, cell_id, day, pr, tas, clt, tasmax, tasmin, CASE WHEN tas IS NOT NULL AND hurs IS NOT NULL THEN LEAST(tas,
  tas*ATAN(0.151977*SQRT(LEAST(hurs, 100.0)+8.313659)) + ATAN(tas+LEAST(hurs, 100.0)) - ATAN(LEAST(hurs, 100.0)-1.676331)
  + 0.00391838*POW(LEAST(hurs, 100.0), 1.5)*ATAN(0.023101*LEAST(hurs, 100.0)) - 4.686035) END AS wb FROM daily"""


@query("scal10_to_13_day_classes", "source:s cell_id:i day:d wet_bulb:5 humid_heat:f sky:s band_max:f band_min:f", """
 SELECT source, cell_id, day, wb AS wet_bulb, CASE WHEN wb >= 30 THEN 2 WHEN wb >= 26 THEN 1 WHEN wb IS NOT NULL THEN 0 END AS humid_heat,
  CASE WHEN pr >= 1 THEN CASE WHEN tas IS NULL THEN NULL WHEN tas < 1.5 THEN 'snow' ELSE 'rain' END WHEN pr IS NULL OR clt IS NULL THEN NULL
   WHEN clt >= 70 THEN 'overcast' WHEN clt >= 30 THEN 'cloudy' ELSE 'clear' END AS sky,
  CASE WHEN tasmax IS NOT NULL THEN LEAST(GREATEST(CAST(FLOOR(tasmax/5) AS BIGINT)+1, 0), 9) END AS band_max,
  CASE WHEN tasmin IS NOT NULL THEN LEAST(GREATEST(CAST(FLOOR(tasmin/5) AS BIGINT)+1, 0), 9) END AS band_min FROM w""", w=WET_BULB_SQL)
def _(t):
    wb = humidity.wet_bulb("tas", "hurs")
    return t.daily.select(*IDS, wb.alias("wet_bulb"), classes.humid_heat(wb).alias("humid_heat"),
                          classes.sky("pr", "tas", "clt").alias("sky"), classes.temperature_band("tasmax").alias("band_max"),
                          classes.temperature_band("tasmin").alias("band_min"))


@query("scal14_to_16_20_gap_classes", "source:s cell_id:i day:d temperature_class:s rain_class:s tone:s position:4", """
 SELECT source, cell_id, day, CASE WHEN ABS(s) < 0.5 THEN 'near' WHEN s >= 1.5 THEN 'much_warmer' WHEN s <= -1.5 THEN 'much_colder'
   WHEN s > 0 THEN 'warmer' WHEN s < 0 THEN 'colder' END AS temperature_class,
  CASE WHEN r < 0.5 THEN 'much_drier' WHEN r < 0.8 THEN 'drier' WHEN r <= 1.2 THEN 'near' WHEN r <= 1.5 THEN 'wetter'
   WHEN r IS NOT NULL THEN 'much_wetter' END AS rain_class,
  CASE WHEN tas-12.3 >= 5 THEN 'much-warm' WHEN tas-12.3 > 0 THEN 'warm' WHEN tas-12.3 <= -5 THEN 'much-cool' WHEN tas-12.3 < 0 THEN 'cool'
   WHEN tas IS NOT NULL THEN '' END AS tone,
  CASE WHEN s IS NOT NULL THEN (LEAST(3.0, GREATEST(-3.0, s))+3.0)/6.0*4 END AS position
 FROM (SELECT *, (tas-12.3)/6.0 AS s, pr/4.0 AS r FROM daily) AS d""")
def _(t):
    s, r = (F.col("tas") - 12.3) / 6.0, F.col("pr") / 4.0
    return t.daily.select(*IDS, classes.temperature_class(s).alias("temperature_class"), classes.rain_class(r).alias("rain_class"),
                          classes.gap_tone(F.col("tas") - 12.3).alias("tone"), classes.colour_position(s).alias("position"))


def _bands(name, edges):
    return "CASE WHEN {0} IS NOT NULL THEN ".format(name) + " + ".join(
        f"CAST({name} >= {e} AS INTEGER)" for e in edges) + " END"


@query("scal17_map_bands", "source:s cell_id:i day:d tasmax:f tasmin:f pr:f clt:f",
       "SELECT source, cell_id, day, " + ", ".join(f"{_bands(n, classes.MAP_EDGES[n])} AS {n}" for n in (
           "tasmax", "tasmin", "pr", "clt")) + " FROM daily")
def _(t):
    return t.daily.select(*IDS, *[classes.map_band(n, n).alias(n) for n in ("tasmax", "tasmin", "pr", "clt")])


@query("scal18_haversine", "place_id:i km:4", """
 SELECT place_id, 2*6371.0*ASIN(SQRT(LEAST(1.0, POW(SIN((RADIANS(45.5)-RADIANS(lat))/2), 2)
  + COS(RADIANS(lat))*COS(RADIANS(45.5))*POW(SIN((RADIANS(7.0)-RADIANS(lon))/2), 2)))) AS km FROM places""")
def _(t):
    return t.places.select("place_id", geo.haversine_km("lat", "lon", 45.5, 7.0).alias("km"))


@query("scal19_projections", "place_id:i lat_geo:6 lon_geo:6 x:6 y:6", """
 SELECT place_id, DEGREES(ASIN(GREATEST(-1.0, LEAST(1.0, gz)))) AS lat_geo, DEGREES(ATAN2(gy, gx)) AS lon_geo,
  SQRT(2/(1+SIN(RADIANS(52.0))*SIN(RADIANS(lat))+COS(RADIANS(52.0))*COS(RADIANS(lat))*COS(RADIANS(lon-10.0))))*COS(RADIANS(lat))*SIN(RADIANS(lon-10.0)) AS x,
  SQRT(2/(1+SIN(RADIANS(52.0))*SIN(RADIANS(lat))+COS(RADIANS(52.0))*COS(RADIANS(lat))*COS(RADIANS(lon-10.0))))
   *(COS(RADIANS(52.0))*SIN(RADIANS(lat))-SIN(RADIANS(52.0))*COS(RADIANS(lat))*COS(RADIANS(lon-10.0))) AS y
 FROM (SELECT *, -(COS(a)*vx - SIN(a)*vz)*COS(b) + vy*SIN(b) AS gx, -(COS(a)*vx - SIN(a)*vz)*SIN(b) - vy*COS(b) AS gy, SIN(a)*vx + COS(a)*vz AS gz FROM (
  SELECT *, COS(RADIANS(lat-45))*COS(RADIANS(lon-6)) AS vx, COS(RADIANS(lat-45))*SIN(RADIANS(lon-6)) AS vy, SIN(RADIANS(lat-45)) AS vz,
   RADIANS(90-39.25) AS a, RADIANS(-162.0) AS b FROM places) AS p) AS q""")
def _(t):
    lat, lon = geo.rotated_to_geographic(F.col("lat") - 45, F.col("lon") - 6, 39.25, -162.0)
    x, y = geo.laea_sphere("lat", "lon")
    return t.places.select("place_id", lat.alias("lat_geo"), lon.alias("lon_geo"), x.alias("x"), y.alias("y"))


# --- hourly to daily -----------------------------------------------------------

HOUR_SPEC = {"mean": ("value", "mean", False), "highest": ("value", "max", True), "lowest": ("value", "min", True),
             "total": ("value", "sum", True)}


@query("agg1_2_hourly_to_daily", "cell_id:i day:d mean:3 highest:3 lowest:3 total:3", """
 SELECT COALESCE(a.cell_id, b.cell_id) AS cell_id, COALESCE(a.day, b.day) AS day, mean, highest, lowest, total
 FROM (SELECT cell_id, CAST(ts AS DATE) AS day, AVG(value) AS mean FROM hourly GROUP BY 1, 2) AS a FULL JOIN
  (SELECT cell_id, CAST(ts - INTERVAL 1 HOUR AS DATE) AS day, MAX(value) AS highest, MIN(value) AS lowest, SUM(value) AS total FROM hourly GROUP BY 1, 2) AS b
  ON a.cell_id = b.cell_id AND a.day = b.day""")
def _(t):
    return H.hourly_to_daily(t.hourly, HOUR_SPEC)


@query("agg3_hourly_formulas", "cell_id:i day:d wind:5 hurs:5 huss:8 zg:3", """
 SELECT cell_id, CAST(ts AS DATE) AS day, AVG(SQRT(u10*u10+v10*v10)) AS wind, AVG(LEAST(100.0, 100.0*ed/et)) AS hurs,
  AVG(0.622*ed/(sp-0.378*ed)) AS huss, AVG(geopotential/9.80665) AS zg FROM (
  SELECT *, 611.21*EXP(17.502*(d2m+273.15-273.16)/(d2m+273.15-32.19)) AS ed, 611.21*EXP(17.502*(t2m+273.15-273.16)/(t2m+273.15-32.19)) AS et
  FROM hourly) AS h GROUP BY 1, 2""")
def _(t):
    h = t.hourly.withColumns({"t2m": F.col("t2m") + 273.15, "d2m": F.col("d2m") + 273.15})
    return H.hourly_to_daily(H.hourly_fields(h), {
        "wind": ("wind_speed", "mean", False), "hurs": ("relative_humidity", "mean", False),
        "huss": ("specific_humidity", "mean", False), "zg": ("height", "mean", False)})


@query("agg4_longitude_wrap", "place_id:i lon:4", """
 SELECT place_id, lon FROM (SELECT place_id, CASE WHEN far > 180 THEN far - 360 ELSE far END AS lon FROM (
  SELECT place_id, (lon - 5.3 + 360.0) - 360.0*FLOOR((lon - 5.3 + 360.0)/360.0) AS far FROM places) AS p) AS q WHERE lon BETWEEN -0.2 AND 0.3""")
def _(t):
    p = t.places.withColumn("lon", F.col("lon") - 5.3 + 360.0)
    return H.box(p.withColumn("lon", F.col("lon") - 360.0 * F.floor(F.col("lon") / 360.0)), -0.2, 0.3)
