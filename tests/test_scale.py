"""Steps that many queries share: how rows travel, on rows built here."""

import math
import re
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.catalog import tables
from daygrid.functions import quantiles
from daygrid.operators import carry
from daygrid.operators import climate as C
from daygrid.operators import grid as G
from daygrid.operators import nearby as N
from daygrid.operators import spine
from daygrid.operators import years as Y
from daygrid.plans import days as D
from daygrid.sources import checks
from daygrid.streaming import carry as stream

RANGES = (("obs", "2000-01-01", "2000-01-10"), ("sim", "2000-01-01", "2000-01-03"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dense(spark):
    cells = spark.createDataFrame([(k,) for k in (1, 2, 2, 3)], "cell_id long")
    rows = [("obs", 1, date(2000, 1, 2), 4.0), ("sim", 1, date(2000, 1, 9), 5.0), ("obs", 9, date(2000, 1, 2), 6.0), ("obs", 3, None, 7.0)]
    return spine.densify(spark.createDataFrame(rows, "source string, cell_id long, day date, tas double"), cells, RANGES, ["tas"])


def test_dense_rows_are_the_spine_with_its_values(spark):
    got = sorted(tuple(r) for r in dense(spark).collect())
    want = [(s, c, date.fromisoformat(a) + timedelta(days=n), 4.0 if (s, c, n) == ("obs", 1, 1) else None)
            for s, a, b in RANGES for c in (1, 2, 3) for n in range((date.fromisoformat(b) - date.fromisoformat(a)).days + 1)]
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == [r[3] for r in want]


def test_the_spine_is_exploded_where_it_arrives_and_parts_follow_its_rows(spark, monkeypatch):
    """Before, every day of every cell went through the shuffle, into parts whose number did not follow them."""
    monkeypatch.setattr(spine, "TASK_ROWS", 2)
    df = dense(spark)
    lines = plan(df).splitlines()
    at = {word: next(i for i, line in enumerate(lines) if word in line) for word in ("Generate explode", "Exchange hashpartitioning")}
    assert at["Generate explode"] < at["Exchange hashpartitioning"]  # a plan is read from its end
    assert df.rdd.getNumPartitions() == 26  # 4 rows of cells, 13 days, 2 rows a part


def test_parts_of_few_bytes_are_not_merged(spark):
    """Before, parts of packed rows were merged by their bytes, and the dense rows of all of them met in one task."""
    assert dense(spark).rdd.getNumPartitions() == 4  # the session asks for 4 and has 4 cores


def test_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Before, lines were combined file by file and again in parts that were merged by their bytes."""
    monkeypatch.setattr(spine, "TASK_ROWS", 5)
    day = datetime(1996, 3, 1)
    lines = [(s, 100 * s, day + timedelta(days=n), 10.0 + n, 950.5, 0.05, 0.02) for s in range(8) for n in range(5)] * 2
    lines += [(None, 90, day, 1.0, 950.5, None, 0.02), (1, None, day, 1.0, 950.5, 0.05, 0.02), (1, 90, None, None, None, 0.05, 0.02)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    counted = tables.Tables(spark, str(tmp_path)).counted
    assert plan(counted).count("REPARTITION_BY_NUM") == plan(counted).count("Exchange ") == 2
    assert counted.rdd.getNumPartitions() in (17, 34)  # 83 lines, 5 a part, of each source
    cents = 95050
    want = Counter()
    for s, p, d, q, _, a, b in lines:
        at = None if d is None else d.date()
        known = q is not None
        price = cents if known else None
        for key, figures in ((("obs", None if s is None else s // 4, at), (q, None if a is None else a * 100, b * 100)),
                             (("sim", None if p is None else p // 80, at), (1 + price % 50, price // 50 % 11, price // 550 % 9) if known else (None,) * 3)):
            want[key, "n"] += 1
            for name, v in zip("qab", figures):
                want[key, name] += round(v or 0)
    got = {(tuple(r[:3]), name): r[name] or 0 for r in counted.select("source", "cell_id", "day", "n", "q", "a", "b").collect() for name in "nqab"}
    assert got == dict(want)


def test_days_go_to_blocks_in_parts_that_follow_their_rows(spark, monkeypatch):
    """Before, days of blocks were merged by their bytes. By hand: a whole block, one with a gap, one without a fourth cell."""
    monkeypatch.setattr(spine, "TASK_ROWS", 2)
    cells = spark.createDataFrame([(10 * r + c, r, c) for r in range(2) for c in range(5)], "cell_id long, row long, col long")
    days = [(s, 10 * r + c, date(2000, 1, n), None if (c, n) == (2, 1) else float(r + c + n)) for s in ("obs", "sim") for r in range(2) for c in range(5) for n in (1, 2)]
    daily = spark.createDataFrame(days + [(None, 0, None, 9.0)], "source string, cell_id long, day date, psl double")
    want = sorted([(s, date(2000, 1, n), 0, k, None if (k, n) == (1, 1) else 1.0 + 2 * k + n) for s in ("obs", "sim") for n in (1, 2) for k in (0, 1)] + [(None, None, 0, 0, None)], key=str)
    for rows, parts in ((41, 21), (None, 21), (60, 30)):
        df = G.coarsen(daily, cells, "psl", rows=rows)
        assert df.rdd.getNumPartitions() == parts
        assert sorted((tuple(r) for r in df.select("source", "day", "block_row", "block_col", "psl").collect()), key=str) == want


def test_two_rows_of_a_day_are_an_error(spark):
    rows = [("obs", 1, date(2000, 1, 2), 4.0)] * 2
    df = spine.densify(spark.createDataFrame(rows, "source string, cell_id long, day date, tas double"),
                       spark.createDataFrame([(1,)], "cell_id long"), RANGES, ["tas"])
    with pytest.raises(Exception, match="two rows of one cell and day"):
        df.collect()


def test_figures_of_years_meet_days_without_a_join_of_them(spark):
    """Held years by hand; before, every year of a request met the running sums in two joins, the wide rows twice."""
    periods = spark.createDataFrame([("obs", date(2000, 1, 1), date(2001, 12, 31)), ("sim", date(2003, 1, 1), date(2003, 12, 31))],
                                    "source string, first_day date, last_day date")
    days = [(s, 1, date(y, 1, 1) + timedelta(days=n), None if n == 4 else float(y - 2000 + n), float(n), float(n) - 2, 1.0 if n % 2 else None)
            for s, y in (("obs", 2000), ("obs", 2001), ("sim", 2003), ("sim", 2000)) for n in range(365)]
    daily = spark.createDataFrame(days, "source string, cell_id long, day date, tasmax double, tasmin double, tas double, pr double")
    asked = spark.createDataFrame([(7, 1, date(2000, 1, 3), date(2000, 1, 6)), (7, 1, date(2000, 1, 3), date(2000, 1, 6)), (8, None, date(2000, 1, 3), date(2000, 1, 6)),
                                   (9, 5, date(2000, 1, 3), date(2000, 1, 3)), (None, 1, date(2000, 12, 30), date(2001, 1, 2))],
                                  "search_id long, cell_id long, first_day date, last_day date")
    df = Y.year_figures(asked, daily, periods, 2000, 2003)
    assert "SortMergeJoin" not in plan(df)
    got = {}
    for r in df.collect():
        got.setdefault((r.search_id, r.year), []).append(r)
    assert len(got) == 16 and [len(v) for k, v in sorted(got.items(), key=str) if k[0] == 7] == [2] * 4
    for y, source in ((2000, "obs"), (2001, "obs"), (2003, "sim")):
        r = got[7, y][0]
        assert (r.source, r.first_day, r.days) == (source, date(y, 1, 3), 4)
        assert r.tasmax_mean == pytest.approx(y - 2000 + 10 / 3) and r.tas_mean == pytest.approx(1.5) and r.precipitation == 4.0
    assert all(got[k, 2002][0].source is None and got[k, 2002][0].tas_mean is None for k in (7, 8, 9, None))
    assert got[8, 2000][0].source == "obs" and got[8, 2000][0].tasmax_mean is None  # held, but of no cell
    assert got[9, 2000][0].source == "obs" and got[9, 2000][0].days == 1 and got[9, 2000][0].frost_days is None
    assert got[None, 2000][0].days == 4 and got[None, 2001][0].source is None and got[None, 2000][0].tas_mean == pytest.approx((362 - 2 - 1) / 3)  # one of its days is missing


def test_contrast_cities_meet_few_tiles_and_a_position_once(spark, monkeypatch):
    """Before, a point met all cities within 1 400 km and more of its target, and copies of a point met them again."""
    met, put = [], N.written
    monkeypatch.setattr(N, "written", lambda df: met.append(put(df)) or met[-1])
    towns = [(k, 36.0 + 0.2 * (k // 100), -9.0 + 0.4 * (k % 100), "FR", 600000, True) for k in range(10000)]
    cities = spark.createDataFrame(towns, "place_id long, lat double, lon double, country string, population long, served boolean")
    asked = [(k, 48.03, 8.07) for k in range(50)] + [(50, None, 1.0), (51, 37.0, 3.0), (51, 50.0, 30.0), (None, 48.0, 8.0)]
    points = spark.createDataFrame(asked, "point_id long, lat double, lon double")
    got = [tuple(r) for r in N.contrast_city(points, cities, "point_id").collect()]
    assert met[0].count() == 4 and met[-1].count() < 4000 < 4 * 10000  # positions; pairs of narrow tiles

    def km(a, b, c, d):
        a, b, c, d = (math.radians(v) for v in (a, b, c, d))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    def best(*at):
        return min((math.floor(km(lat + (7.2 if lat < 44 else -7.2), lon, t[1], t[2]) * 1e7 + 0.5), t[0])
                   for lat, lon in at for t in towns if km(lat, lon, t[1], t[2]) >= 300)[1]

    want = {k: best((48.03, 8.07)) for k in range(50)} | {50: None, 51: best((37.0, 3.0), (50.0, 30.0)), None: None}
    assert len(got) == 54 and all(want[k] == v for k, v in got)


def test_copies_are_compared_in_one_pass(spark):
    """Before, each copy was read and shuffled twice."""
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, float("nan")), (4, 0.0), (None, 5.0)], "k long, v double")
    b = spark.createDataFrame([(None, 5.0), (1, 1.0), (2, None), (3, float("nan")), (4, -0.0), (6, None), (6, None)], "k long, v double")
    df = checks.same_rows(a, b)
    assert plan(df).count("Scan ExistingRDD") == 2
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1.0, "a"), (6, None, "b"), (6, None, "b")]


def test_cells_of_a_task_step_together_whatever_the_block(spark, tmp_path):
    """Before, blocks of one cell made a step of every row."""
    rows = [("obs", c, date(2000, 1, 1) + timedelta(days=n), float(c)) for c in range(40) for n in range(5 + c % 2)]
    df = spark.createDataFrame(rows, "source string, cell_id long, day date, x double")

    def step(day, states):
        with open(tmp_path / "steps", "a") as f:
            f.write(".")
        return {"total": states[0] + day["x"]}, [states[0] + day["x"]]

    got = carry.stepped(df, step, ["x"], ["total"], [0.0], block=1).collect()
    assert {(r.cell_id, r.day): r.total for r in got} == {(c, d): c * ((d - date(2000, 1, 1)).days + 1.0) for _, c, d, _ in rows}
    assert len((tmp_path / "steps").read_text()) <= 6 * 4 * 2 < len(rows)  # days, tasks, and days cut by a batch


def test_windows_shared_by_requests_are_summed_once(spark):
    """Before, each request met twelve rows of every year of its window."""
    months = [("obs", 1, y, m, *[float(y + m)] * 4, *[28] * 4, 28) for y in (1990, 1991, 1993) for m in (1, 2)]
    sums = spark.createDataFrame(months, "source string, cell_id long, year int, month int, " + ", ".join(
        f"sum_{n} double" for n in ("tas", "tasmin", "tasmax", "pr")) + ", " + ", ".join(f"n_{n} long" for n in ("tas", "tasmin", "tasmax", "pr")) + ", days long")
    asked = [(7, "obs", 1, 1990, 1992), (8, "obs", 1, 1990, 1992), (8, "obs", 1, 1990, 1992), (9, "obs", 1, 1991, 1993), (9, "obs", 1, 1990, 1991), (5, "obs", None, 1990, 1992)]
    requests = spark.createDataFrame(asked, "search_id long, source string, cell_id long, window_from int, window_to int")
    df = C.window_diagram(sums, requests, ["source", "cell_id"], "search_id")
    per_year = requests.select("search_id", "source", "cell_id", F.explode(F.sequence("window_from", "window_to")).alias("year"))
    want = C.diagram(per_year.join(sums, ["source", "cell_id", "year"]), ("search_id",))
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(sorted(d.columns)).collect())
    assert rows(df) == rows(want) and len(rows(df)) == 6
    assert "window_from" in plan(df).split("HashAggregate(keys=[search_id")[-1]


PLACE = "place_id long, cell_id long, fine_id long, lift double"
NAMES = "tasmax tasmin tas pr clt hurs sfcWind psl rsds".split()


def test_places_that_read_one_fine_cell_lie_side_by_side(spark):
    """Before, places were told apart by a hash alone, and each fine cell's days went to every share of its cell."""
    rows = [(40 * f + k, 7, 70 + f if f else None, None) for f in range(5) for k in range(40)] + [(None, 7, 71, None)] * 2 + [(1, None, 71, None), (900, 8, 80, None)]
    got = G.shares(spark.createDataFrame(rows, PLACE), "place_id", 40).collect()
    assert len(got) == len(rows) - 1 and all(len({r._share for r in got if (r.cell_id, r.fine_id) == (7, f)}) <= 2 for f in (None, 71, 72, 73, 74))
    held = Counter((r.cell_id, r._share) for r in got)
    assert len([k for k in held if k[0] == 7]) == 6 and max(held.values()) < 80


def place_days(spark, **kw):
    coarse = spark.createDataFrame([("obs", 7, date(2000, 1, d), *[float(d)] * 9) for d in (1, 2, 3)],
                                   "source string, cell_id long, day date, " + ", ".join(f"{n} double" for n in NAMES))
    fine = spark.createDataFrame([("obs", 70, date(2000, 1, 1), None, None, None), ("obs", 70, date(2000, 1, 2), 5.0, None, 6.0)],
                                 "source string, fine_id long, day date, tasmax double, tasmin double, tas double")
    at = spark.createDataFrame([(k, 7, 70 if k % 2 else None, None) for k in range(6)], PLACE)
    return G.place_daily(at, coarse, fine, **kw)


def test_days_meet_their_shares_where_they_lie(spark, monkeypatch):
    """Before, fine days were exchanged by their cell to learn their shares, days without a value among them."""
    want = sorted((k, d, *((None, None, None) if k % 2 and d != 2 else (5.0, None, 6.0) if k % 2 else (float(d),) * 3), float(d)) for k in range(6) for d in (1, 2, 3))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for sent in (G.SENT, 0):
            monkeypatch.setattr(G, "SENT", sent)
            df = place_days(spark)
            assert ("BroadcastExchange" in plan(df)) == bool(sent) and ("hashpartitioning(_f#" not in plan(df)) == bool(sent) and "isnotnull(coalesce(" in plan(df)
            assert sorted(((r.place_id, r.day.day, r.tasmax, r.tasmin, r.tas, r.pr) for r in df.collect()), key=lambda r: r[:2]) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_days_of_places_come_in_the_parts_they_are_met_in(spark):
    """Before, parts were counted from places and sources, and what met the days was dealt out a second time."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    had = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        assert place_days(spark, parts=7).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set(name, had)


def test_snow_cover_reads_its_days_once(spark):
    """Before, all days were built once for the searches that know one and once for the runs."""
    days = spark.createDataFrame([(s, date(2000, 1, d), f) for s, flags in ((1, (True, True, False, None, True)), (2, (False, None)), (3, (None,)))
                                  for d, f in enumerate(flags, 1)], "search_id long, date date, snow_on_ground boolean")
    df = D.snow_cover(days)
    assert "ExistingRDD" not in plan(df)
    assert sorted(tuple(r) for r in df.select("search_id", "days", "longest", "first_day").collect()) == [(1, 3, 2, date(2000, 1, 1)), (2, 0, None, None)]


def test_rare_snow_is_told_by_the_winters_held(spark):
    """A mean over held winters; a span of 64 years and more gives what a short one gives."""
    cold = lambda k, y, n: [(s, 7, 0, k, date(y, 1, 1) + timedelta(days=i), -5.0, 10.0 if i < n else 0.0, 100.0, None) for s in ("obs", "sim") for i in range(90 if n else 1)]
    rows = cold(1, 1996, 1) + cold(2, 1996, 0) + [r for y in (1996, 1997, 1998) for r in cold(3, y, 1)]
    rows = [(*r[:5], -5.0 if r[3] != 2 else 9.0, *r[6:]) for r in rows]
    days = spark.createDataFrame(rows, "source string, cell_id long, _share long, spot_id long, day date, tas double, pr double, read_elevation double, lift double")
    first = spark.createDataFrame([("obs", date(1995, 1, 1)), ("sim", date(1995, 1, 1))], "source string, first_day date")
    told = []
    for last in (1998, 2070):
        got = D.snow_at_places(days, first, (1996, last), "sim", "spot_id").collect()
        told.append(sorted((r.source, r.spot_id, r.day, r.snow_on_ground) for r in got if r.snow_on_ground is not None))
    assert told[0] == told[1] and {(s, k) for s, k, *_ in told[0]} == {("obs", 1), ("obs", 2), ("obs", 3), ("sim", 1), ("sim", 3)}


def test_copies_meet_in_parts_that_follow_their_rows(spark, monkeypatch):
    """Before, rows were combined file by file, which no two rows of a copy can be, and met in as many parts whatever their number."""
    monkeypatch.setattr(spine, "TASK_ROWS", 2)
    a = spark.createDataFrame([(k, None if k == 3 else float(k)) for k in range(10)] + [(None, 0.0)], "k long, v double")
    b = spark.createDataFrame([(k, None if k == 3 else float(k)) for k in range(1, 11)] + [(None, -0.0)], "k long, v double")
    df = checks.same_rows(a, b, 22)
    assert plan(df).rindex("HashAggregate") < plan(df).index("Exchange hashpartitioning")  # a plan is read from its end
    assert df.rdd.getNumPartitions() == 11 and sorted((r.k, r.side) for r in df.collect()) == [(0, "a"), (10, "b")]


def test_a_rank_counts_the_quantiles_twice(spark):
    """Before, each mention of a count in the rank's formula went through all quantiles again. Ranks by hand."""
    rows = [(1, 2.5, [1.0, 2.0, 3.0]), (2, 2.0, [1.0, 2.0, 2.0]), (3, 9.0, [1.0, 2.0]), (4, -9.0, [1.0, 2.0]), (5, None, [1.0]), (6, 1.0, None), (7, 1.0, [None, None]), (8, 1.0, [1.0])]
    df = spark.createDataFrame(rows, "k long, x double, q array<double>").select("k", quantiles.rank_in("x", "q").alias("f"))
    assert len(re.findall(r"\bfilter\(", df._jdf.queryExecution().optimizedPlan().toString())) == 2
    assert {r.k: r.f for r in df.collect()} == {1: 1.5, 2: 1.5, 3: 1.0, 4: 0.0, 5: None, 6: None, 7: 0.0, 8: 0.0}


def test_days_of_a_cell_are_stepped_without_frames():
    """Before, the days of a cell were a frame and its rows, at several times the cost. A late day, a gap, a new winter."""
    nan = float("nan")
    days = np.array([(5.0, 2000.0, -1.0, 4.0, 2.0, 40.0), (6.0, 2000.0, nan, nan, nan, 40.0), (6.0, 2000.0, -1.0, 4.0, 2.0, 40.0), (7.0, 2001.0, 1.0, 3.0, 1.0, 40.0)])
    (ordinals, stock, water, fill, drainage, late), state = stream._advance(days, 1.0, 10.0, 4, 2000)
    assert ordinals == [5, 6, 6, 7] and late == [False, False, True, False]
    assert stock[:2] == [5.0, 5.0] and stock[2] != stock[2] and stock[3] == 0.0 and water[0] == 0.0 and water[3] == 3.0
    assert fill[0] == 1.0 - 12.0 / 40.0 and fill[1] != fill[1] and fill[3] == 0.75 and drainage[3] == 0.0 and state == (0.0, 10.0, 7, 2001)
