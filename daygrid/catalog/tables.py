"""Climate-shaped tables derived from the given sales tables, by whole-table jobs.

Suppliers give the observed cells, parts the simulated ones; both grids grow
with the data (four suppliers, or eighty parts, to a cell). All base values are
integers (hundredths or tenths), so both engines hold exactly the same doubles.
Every table exists twice: a DataFrame here, a SQL text in ``PRELUDE``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrid.config import MEASURES
from daygrid.operators.spine import dense_rows, densify, parts_of, spread
from daygrid.session import shared_folder
from daygrid.sources import layout

OBS_START, OBS_END = "1995-01-01", "2001-12-31"
SIM_START, SIM_END = "2027-01-01", "2033-12-31"
HELD = (("obs", OBS_START, OBS_END), ("sim", OBS_START, OBS_END), ("sim", SIM_START, SIM_END))
SHIFT_YEARS = 32  # keeps leap years aligned
REFERENCE = (1995, 2001)

PRELUDE: dict[str, str] = {}

PRELUDE["counted"] = """
 SELECT 'obs' AS source, l_suppkey // 4 AS cell_id, CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
  CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS BIGINT) AS a,
  CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS BIGINT) AS b
 FROM lineitem GROUP BY 1, 2, 3
 UNION ALL
 SELECT 'sim', l_partkey // 80, CAST(l_shipdate AS DATE), COUNT(*),
  CAST(SUM(1 + CAST(ROUND(l_extendedprice*100) AS BIGINT) % 50) AS BIGINT),
  CAST(SUM((CAST(ROUND(l_extendedprice*100) AS BIGINT) // 50) % 11) AS BIGINT),
  CAST(SUM((CAST(ROUND(l_extendedprice*100) AS BIGINT) // 550) % 9) AS BIGINT)
 FROM lineitem GROUP BY 1, 2, 3"""

PRELUDE["measured"] = """
 SELECT source, cell_id, day, q, q // n AS qm, a // n AS am, b // n AS bm,
  900 + CASE MONTH(day) WHEN 1 THEN -900 WHEN 2 THEN -700 WHEN 3 THEN -300 WHEN 4 THEN 100 WHEN 5 THEN 500
   WHEN 6 THEN 900 WHEN 7 THEN 1100 WHEN 8 THEN 1000 WHEN 9 THEN 600 WHEN 10 THEN 100
   WHEN 11 THEN -400 ELSE -800 END
   + 40*(q // n - 25) + CASE WHEN source = 'sim' THEN 150 ELSE 0 END AS tas_i
 FROM counted"""

PRELUDE["base"] = """
 SELECT source, cell_id, day, tas_i, tas_i+200+100*bm AS tasmax_i, tas_i-200-100*am AS tasmin_i,
  CASE WHEN am>4 THEN 30*(am-4) WHEN am=4 THEN 5 ELSE 0 END AS pr_i,
  100*((q*7+am*3)%101) AS clt_i, 3000+100*((q+11*bm)%71) AS hurs_i,
  50+25*(q%40) AS wind_i, 500+10*((q*3)%250) AS rsds_i, 9800+10*(q%50) AS psl_i
 FROM measured"""

PRELUDE["grown"] = """
 SELECT * FROM base
 UNION ALL
 SELECT source, cell_id, CAST(day + INTERVAL 32 YEAR AS DATE), tas_i+200, tasmax_i+230, tasmin_i+170,
  (pr_i*11)//10, clt_i, hurs_i, wind_i, rsds_i, psl_i
 FROM base WHERE source = 'sim'"""

PRELUDE["periods"] = """
 SELECT * FROM (VALUES ('obs', DATE '1995-01-01', DATE '2001-12-31', 'observed'),
  ('sim', DATE '2027-01-01', DATE '2033-12-31', 'simulated')) AS p(source, first_day, last_day, origin)"""

PRELUDE["days_held"] = """
 SELECT 'obs' AS source, CAST(UNNEST(GENERATE_SERIES(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day
 UNION ALL
 SELECT 'sim', CAST(UNNEST(GENERATE_SERIES(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE)
 UNION ALL
 SELECT 'sim', CAST(UNNEST(GENERATE_SERIES(DATE '2027-01-01', DATE '2033-12-31', INTERVAL 1 DAY)) AS DATE)"""

PRELUDE["cells"] = """
 SELECT k AS cell_id, k % 5 AS "row", k // 5 AS col, 46.0 - 0.25*(k % 5) AS lat, 5.0 + 0.25*(k // 5) AS lon,
  k <> 0 AS domain, k <> 0 AS land, k % 24 <> 0 AS eobs,
  CASE WHEN k % 25 <> 9 THEN CAST((k*37*11) % 1500 AS DOUBLE) END AS elevation,
  CASE WHEN k % 25 <> 6 THEN 15.0 + 5*(k % 4) END AS capacity
 FROM (SELECT DISTINCT s_suppkey // 4 AS k FROM supplier) AS ids"""

PRELUDE["daily"] = """MATERIALIZED 
 SELECT d.source, c.cell_id, d.day, tasmax_i/100.0 AS tasmax, tasmin_i/100.0 AS tasmin, tas_i/100.0 AS tas,
  pr_i/10.0 AS pr, clt_i/100.0 AS clt, hurs_i/100.0 AS hurs, wind_i/100.0 AS sfcWind, psl_i/10.0 AS psl,
  rsds_i/10.0 AS rsds
 FROM cells AS c CROSS JOIN days_held AS d
 LEFT JOIN grown AS g ON g.source = d.source AND g.cell_id = c.cell_id AND g.day = d.day"""

PRELUDE["obs"] = "SELECT * FROM daily WHERE source = 'obs'"
PRELUDE["sim"] = "SELECT * FROM daily WHERE source = 'sim' AND day < DATE '2002-01-01'"
PRELUDE["served"] = """
 SELECT d.* FROM daily AS d JOIN periods AS p ON d.source = p.source AND d.day BETWEEN p.first_day AND p.last_day"""

# Each coarse cell holds the 0.1 degree cells (i, j) whose nearest coarse cell it is.
PRELUDE["cells010"] = """
 SELECT (CAST(i AS BIGINT) * 1000000 + CAST(j AS BIGINT)) AS fine_id, cell_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
  46.0 - 0.1*i AS lat, 5.0 + 0.1*j AS lon, NOT (i >= 9 AND j % 11 >= 9) AS domain,
  NOT (i = 5 AND j % 11 = 5) AS eobs, elevation + 20*(i-j%11) AS elevation
 FROM (SELECT *, UNNEST(GENERATE_SERIES(0, 11)) AS i FROM cells) AS x,
  LATERAL (SELECT UNNEST(GENERATE_SERIES(GREATEST(0, (10*col - 5)//4 - 1), (10*col + 4)//4 + 1)) AS j) AS y
 WHERE (4*i+5)//10 = "row" AND (4*j+5)//10 = col"""

PRELUDE["daily010"] = """
 SELECT d.source, f.fine_id, d.day, d.tasmax + ((3*i+7*j)%11)*0.1 AS tasmax, d.tasmin + ((3*i+7*j)%11)*0.1 AS tasmin,
  d.tas + ((3*i+7*j)%11)*0.1 AS tas
 FROM cells010 AS f JOIN daily AS d ON f.cell_id = d.cell_id"""

PRELUDE["places"] = """
 SELECT c_custkey AS place_id, c_name AS name, 45.0 + ((c_custkey*7919)%1000)/1000.0 AS lat,
  5.0 + 0.25*(c_custkey//300) + ((c_custkey*104729)%1000)/1000.0 - 0.5 AS lon,
  CAST(ROUND((c_acctbal+1000)*100) AS BIGINT) AS population, n_name AS country,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 2000 AS DOUBLE) END AS elevation
 FROM customer JOIN nation ON c_nationkey = n_nationkey"""

PRELUDE["searches"] = """
 SELECT o_orderkey AS search_id, o_custkey AS place_id,
  CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 2 = 1 THEN INTERVAL 32 YEAR ELSE INTERVAL 0 YEAR END AS DATE) AS first_day,
  CAST(CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 2 = 1 THEN INTERVAL 32 YEAR ELSE INTERVAL 0 YEAR END AS DATE)
   + CAST(o_orderkey % 97 - 2 AS INTEGER) AS DATE) AS last_day
 FROM orders"""

PRELUDE["stations"] = """
 SELECT s_suppkey AS station_id, s_suppkey // 4 AS cell_id,
  46.0 - 0.25*((s_suppkey//4) % 5) + ((s_suppkey*7919)%200 - 100)/1000.0 AS lat,
  5.0 + 0.25*((s_suppkey//4) // 5) + ((s_suppkey*104729)%200 - 100)/1000.0 AS lon,
  CAST((s_suppkey*53)%2000 AS DOUBLE) AS elevation, 1995 + s_suppkey%4 AS first_year, 2001 - s_suppkey%3 AS last_year
 FROM supplier"""

PRELUDE["station_daily"] = """
 SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS day,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT)*40 // COUNT(*) / 100.0 - 10.0
   + CASE WHEN MONTH(CAST(l_shipdate AS DATE)) IN (5,6,7,8,9) THEN 12.0 ELSE 0.0 END AS tas,
  CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS BIGINT) * 10 // COUNT(*) / 10.0 AS pr,
  CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS BIGINT) // COUNT(*) AS depth
 FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""

# Every day of the observed years at every station; most have no report.
PRELUDE["station_days"] = """MATERIALIZED SELECT s.station_id, d.day, tas, pr, depth
 FROM stations AS s CROSS JOIN (SELECT day FROM days_held WHERE source = 'obs') AS d LEFT JOIN station_daily AS r ON r.station_id = s.station_id AND r.day = d.day"""

# The same days with each report held for up to REPORT_DAYS days, so that most winters are reported nearly whole.
REPORT_DAYS = 20
PRELUDE["station_series"] = "MATERIALIZED SELECT station_id, day, " + ", ".join(
    f"LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN {REPORT_DAYS} PRECEDING AND CURRENT ROW) AS {c}"
    for c in ("tas", "pr", "depth")) + " FROM station_days"

PRELUDE["hourly"] = """
 SELECT user_id // 6 AS cell_id, ts, value, value/10.0 - 10.0 AS t2m, value/12.0 - 12.0 AS d2m,
  (event_id % 21) - 10.0 AS u10, (event_id % 17) - 8.0 AS v10, 100000.0 - event_id % 500 AS sp,
  50000.0 + event_id % 3000 AS geopotential
 FROM events"""

# One hexagon to each block of five columns of the grid.
PRELUDE["ring_edges"] = """
 SELECT b AS region, x1 + 1.25*b AS x1, y1, x2 + 1.25*b AS x2, y2
 FROM (SELECT DISTINCT col // 5 AS b FROM cells) AS blocks CROSS JOIN (VALUES
  (5.1, 45.11, 5.6, 45.06), (5.6, 45.06, 5.95, 45.41), (5.95, 45.41, 5.8, 45.91),
  (5.8, 45.91, 5.3, 45.96), (5.3, 45.96, 5.05, 45.52), (5.05, 45.52, 5.1, 45.11)) AS e(x1, y1, x2, y2)"""

# The hexagon of the sample regions.
HEXAGON = ((5.1, 45.11), (5.6, 45.06), (5.95, 45.41), (5.8, 45.91), (5.3, 45.96), (5.05, 45.52))
MONTH_SHIFT = (-900, -700, -300, 100, 500, 900, 1100, 1000, 600, 100, -400, -800)


class Tables:
    """The sample tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def counted(self) -> DataFrame:
        """Sums of each cell and day. Lines are dealt by their number before they are combined: combined in the scan a task
        holds what its file gives, and parts merged by their bytes grow with the table. Lines are dealt by cell, as its days are later; those of a day make one
        row in the task they meet in."""
        line = self.raw("lineitem")
        lines = line.count()
        day = F.to_date("l_shipdate").alias("day")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
        by = ("cell_id", "day")
        obs = (
            spread(line.select(F.expr("l_suppkey div 4").alias("cell_id"), day, F.col("l_quantity").cast("long").alias("q"),
                               hundredths("l_discount").alias("a"), hundredths("l_tax").alias("b")), lines, "cell_id")
            .groupBy(F.lit("obs").alias("source"), *by)
            .agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        )
        sim = (
            spread(line.select(F.expr("l_partkey div 80").alias("cell_id"), day, cents.alias("cents")), lines, "cell_id")
            .groupBy(F.lit("sim").alias("source"), *by)
            .agg(F.count("*").alias("n"), F.sum(F.expr("1 + cents % 50")).alias("q"),
                 F.sum(F.expr("(cents div 50) % 11")).alias("a"), F.sum(F.expr("(cents div 550) % 9")).alias("b"))
        )
        return obs.unionByName(sim)

    @cached_property
    def base(self) -> DataFrame:
        season = F.element_at(F.array(*[F.lit(v) for v in MONTH_SHIFT]), F.month("day"))
        m = self.counted.select(
            "source", "cell_id", "day", "q", F.expr("q div n").alias("qm"), F.expr("a div n").alias("am"),
            F.expr("b div n").alias("bm"), season.alias("season"))
        m = m.withColumn("tas_i", F.expr("900 + season + 40*(qm-25) + if(source = 'sim', 150, 0)"))
        return m.selectExpr(
            "source", "cell_id", "day", "tas_i", "tas_i+200+100*bm AS tasmax_i", "tas_i-200-100*am AS tasmin_i",
            "CASE WHEN am>4 THEN 30*(am-4) WHEN am=4 THEN 5 ELSE 0 END AS pr_i",
            "100*((q*7+am*3)%101) AS clt_i", "3000+100*((q+11*bm)%71) AS hurs_i", "50+25*(q%40) AS wind_i",
            "500+10*((q*3)%250) AS rsds_i", "9800+10*(q%50) AS psl_i")

    @cached_property
    def grown(self) -> DataFrame:
        """Base rows, the simulated ones a second time 32 years later, warmer and wetter.

        One pass: each simulated row is exploded into its two copies."""
        later = F.when(F.col("source") == "sim", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        b = self.base.withColumn("later", F.explode(later))
        return b.selectExpr(
            "source", "cell_id", f"add_months(day, {12 * SHIFT_YEARS}*later) AS day", "tas_i + 200*later AS tas_i",
            "tasmax_i + 230*later AS tasmax_i", "tasmin_i + 170*later AS tasmin_i",
            "if(later = 1, (pr_i*11) div 10, pr_i) AS pr_i", "clt_i", "hurs_i", "wind_i", "rsds_i", "psl_i")

    @cached_property
    def periods(self) -> DataFrame:
        return self.spark.sql(
            "SELECT * FROM VALUES ('obs', DATE '1995-01-01', DATE '2001-12-31', 'observed'), "
            "('sim', DATE '2027-01-01', DATE '2033-12-31', 'simulated') AS p(source, first_day, last_day, origin)")

    @cached_property
    def cells(self) -> DataFrame:
        ids = self.raw("supplier").select(F.expr("s_suppkey div 4").alias("k")).distinct()
        return ids.selectExpr(
            "k AS cell_id", "k % 5 AS row", "k div 5 AS col", "46.0D - 0.25D*(k % 5) AS lat",
            "5.0D + 0.25D*(k div 5) AS lon", "k <> 0 AS domain", "k <> 0 AS land", "k % 24 <> 0 AS eobs",
            "CASE WHEN k % 25 <> 9 THEN CAST((k*37*11) % 1500 AS DOUBLE) END AS elevation",
            "CASE WHEN k % 25 <> 6 THEN 15.0D + 5*(k % 4) END AS capacity")

    @cached_property
    def daily(self) -> DataFrame:
        values = self.grown.selectExpr(
            "source", "cell_id", "day", "tasmax_i/100D AS tasmax", "tasmin_i/100D AS tasmin", "tas_i/100D AS tas",
            "pr_i/10D AS pr", "clt_i/100D AS clt", "hurs_i/100D AS hurs", "wind_i/100D AS sfcWind",
            "psl_i/10D AS psl", "rsds_i/10D AS rsds")
        return densify(values, self.cells, HELD, MEASURES)

    @cached_property
    def daily_rows(self) -> int:
        return dense_rows(self.cells, HELD)

    @cached_property
    def obs(self) -> DataFrame:
        return self.daily.filter("source = 'obs'")

    @cached_property
    def sim(self) -> DataFrame:
        return self.daily.filter("source = 'sim' AND day < DATE '2002-01-01'")

    @cached_property
    def served(self) -> DataFrame:
        """Served periods only: past from the observed source, future from the simulated one."""
        return self.daily.filter("(source = 'obs') OR (source = 'sim' AND day >= DATE '2027-01-01')")

    @cached_property
    def cells010(self) -> DataFrame:
        x = self.cells.selectExpr("*", "explode(sequence(0L, 11L)) AS i").filter("(4*i+5) div 10 = row")
        x = x.selectExpr("*", "explode(sequence(greatest(0L, (10*col - 5) div 4 - 1), (10*col + 4) div 4 + 1)) AS j")
        return x.filter("(4*j+5) div 10 = col").selectExpr(
            "i*1000000 + j AS fine_id", "cell_id", "i", "j", "46.0D - 0.1D*i AS lat", "5.0D + 0.1D*j AS lon",
            "NOT (i >= 9 AND j % 11 >= 9) AS domain", "NOT (i = 5 AND j % 11 = 5) AS eobs",
            "elevation + 20*(i-j%11) AS elevation")

    @cached_property
    def stored(self) -> DataFrame:
        """The daily table as the point copy a page reads: built once, then pruned by cell and day."""
        path = shared_folder(self.spark)
        layout.write_points(self.daily, path, parts_of(self.daily, self.daily_rows))
        return layout.read_copy(self.spark, path)

    @cached_property
    def daily010(self) -> DataFrame:
        return self.fine_of(self.daily)

    def fine_of(self, daily: DataFrame) -> DataFrame:
        f = self.cells010.select("fine_id", "cell_id", F.expr("((3*i+7*j)%11)*0.1D").alias("up"))
        return daily.select("source", "cell_id", "day", "tasmax", "tasmin", "tas").join(f, "cell_id").selectExpr(
            "source", "fine_id", "day", "tasmax + up AS tasmax", "tasmin + up AS tasmin", "tas + up AS tas")

    @cached_property
    def places(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "c_custkey AS place_id", "c_name AS name", "45.0D + ((c_custkey*7919)%1000)/1000D AS lat",
            "5.0D + 0.25D*(c_custkey div 300) + ((c_custkey*104729)%1000)/1000D - 0.5D AS lon",
            "CAST(ROUND((c_acctbal+1000)*100) AS BIGINT) AS population", "n_name AS country",
            "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 2000 AS DOUBLE) END AS elevation")

    @cached_property
    def searches(self) -> DataFrame:
        o = self.raw("orders").selectExpr(
            "o_orderkey AS search_id", "o_custkey AS place_id",
            f"add_months(CAST(o_orderdate AS DATE), CAST((o_orderkey % 2)*{12 * SHIFT_YEARS} AS INT)) AS first_day",
            "CAST(o_orderkey % 97 - 2 AS INT) AS n")
        return o.selectExpr("search_id", "place_id", "first_day", "date_add(first_day, n) AS last_day")

    @cached_property
    def stations(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS station_id", "s_suppkey div 4 AS cell_id",
            "46.0D - 0.25D*((s_suppkey div 4) % 5) + ((s_suppkey*7919)%200 - 100)/1000D AS lat",
            "5.0D + 0.25D*((s_suppkey div 4) div 5) + ((s_suppkey*104729)%200 - 100)/1000D AS lon",
            "CAST((s_suppkey*53)%2000 AS DOUBLE) AS elevation", "1995 + s_suppkey%4 AS first_year",
            "2001 - s_suppkey%3 AS last_year")

    @cached_property
    def station_daily(self) -> DataFrame:
        g = self.raw("lineitem").groupBy(
            F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("day")
        ).agg(
            F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("a"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("b"))
        return g.selectExpr(
            "station_id", "day",
            "((q*40) div n)/100D - 10D + if(month(day) IN (5,6,7,8,9), 12D, 0D) AS tas",
            "((a*10) div n)/10D AS pr", "b div n AS depth")

    @cached_property
    def station_days(self) -> DataFrame:
        held = self.station_daily.withColumn("source", F.lit("obs"))
        return densify(held, self.stations, HELD[:1], ("tas", "pr", "depth"), "station_id").drop("source")

    @cached_property
    def station_series(self) -> DataFrame:
        # The last report of all and its day: a frame that only grows costs a step a day, one that slides REPORT_DAYS.
        w = Window.partitionBy("station_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        names = ("tas", "pr", "depth")
        last = self.station_days.select("station_id", "day", *[
            F.last(F.when(F.col(c).isNotNull(), F.struct("day", c)), ignorenulls=True).over(w).alias(c) for c in names])
        return last.select("station_id", "day", *[
            F.when(F.datediff("day", F.col(f"{c}.day")) <= REPORT_DAYS, F.col(f"{c}.{c}")).alias(c) for c in names])

    @cached_property
    def hourly(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "user_id div 6 AS cell_id", "ts", "value", "value/10D - 10D AS t2m", "value/12D - 12D AS d2m",
            "(event_id % 21) - 10D AS u10", "(event_id % 17) - 8D AS v10", "100000D - event_id % 500 AS sp",
            "50000D + event_id % 3000 AS geopotential")

    @cached_property
    def ring_edges(self) -> DataFrame:
        blocks = self.cells.select(F.expr("col div 5").alias("region")).distinct()
        turned = HEXAGON[1:] + HEXAGON[:1]
        edges = F.array(*[
            F.struct(F.lit(a[0]).alias("x1"), F.lit(a[1]).alias("y1"), F.lit(b[0]).alias("x2"), F.lit(b[1]).alias("y2"))
            for a, b in zip(HEXAGON, turned)])
        return blocks.select("region", F.inline(edges)).selectExpr(
            "region", "x1 + 1.25D*region AS x1", "y1", "x2 + 1.25D*region AS x2", "y2")
