"""Trial grids against a day-by-day walk."""

import itertools
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.operators import spine
from daygrid.operators import trials as T
from daygrid.operators.snow import Melt

SCHEMA = "station_id long, day date, tas double, pr double, seen boolean, extra string"


def made(station, first, n, seed):
    """A series with gaps in every column, from a small linear generator."""
    out, x = [], seed
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        day = first + timedelta(k)
        cold = -3.0 if day.month in (11, 12, 1, 2, 3, 4) else 12.0
        out.append((station, day, None if x % 17 == 0 else cold + (x >> 8) % 90 / 10, None if x % 13 == 0 else (x >> 16) % 60 / 10,
                    None if x % 40 == 0 else (x >> 5) % 3 == 0, "x"))
    return out


def walked(rows, fall, melt, level, days=0, ground=0.0):
    stock, past, out = 0.0, [], {}
    for _, day, tas, pr, seen, _ in rows:
        if (day.month, day.day) == (8, 1):
            stock = 0.0
        winter = day.year + (day.month >= 8)
        mean = [v for v in past[-days:] if v is not None] if days else []
        new = (pr or 0.0) if tas is not None and tas < fall else 0.0
        gone = melt * max(tas, 0.0) + ground * max(sum(mean) / len(mean) if mean else 0.0, 0.0) if tas is not None else 0.0
        stock = max(stock + new - gone, 0.0)
        past.append(tas)
        one = out.setdefault(winter, {"held": False, "known": 0, "n": 0, "m": 0})
        one["held"] |= (day.month, day.day) == (8, 1)
        if day.month in (11, 12, 1, 2, 3, 4) and seen is not None:
            one["known"] += 1
            one["n"] += seen
            one["m"] += stock >= level - 1e-9
    return out


@pytest.mark.parametrize("share", [0.95, 0.985])
def test_winters_equal_the_walk(spark, share):
    rows = {s: made(s, date(2000, 9, 10), 1500, 77 * s) for s in (1, 2, 3)}
    settings = [T.Setting({"ts": a, "n": n, "g": g}, Melt(a, 2.5, 2.0), ground=g, warm=f"w{n}") for a, n, g in itertools.product((0.5, 1.5), (5, 20), (0.0, 1.0))]
    df = spark.createDataFrame([r for v in rows.values() for r in v], SCHEMA)
    df = df.withColumns({f"w{n}": T.warm_column("tas", n, ["station_id"]) for n in (5, 20)})
    got = {(r.station_id, r.winter, r.ts, r.n, r.g): (r.observed_days, r.snow_days) for r in T.trial_winters(df, settings, ["station_id"], "seen", share).collect()}
    want = {}
    for (s, v), one in itertools.product(rows.items(), settings):
        for winter, c in walked(v, one.melt.fall_c, 2.5, 2.0, one.labels["n"], one.ground).items():
            days = (date(winter, 4, 30) - date(winter - 1, 11, 1)).days + 1
            if c["held"] and c["known"] >= share * days:
                want[(s, winter, *one.labels.values())] = (c["n"] * days / c["known"], c["m"] * days / c["known"])
    assert want and set(got) == set(want)
    assert 2001 not in {k[1] for k in got}  # its 1 August is not held
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_winters_without_reports_keys_or_rows(spark):
    settings = [T.Setting({"ts": 0.5})]
    rows = [(None, d, -1.0, 3.0, True, "x") for _, d, *_ in made(1, date(2000, 8, 1), 300, 1)]
    rows += [(1, d, None, None, None, None) for _, d, *_ in made(1, date(2000, 8, 1), 300, 1)] + [(2, None, 1.0, 1.0, True, "x")]
    for r in (rows, []):
        assert T.trial_winters(spark.createDataFrame(r, SCHEMA), settings, ["station_id"], "seen").count() == 0


def test_scores_by_hand(spark):
    rows = [(1, 2001, 10.0, 14.0), (1, 2002, 20.0, 20.0), (2, 2001, 5.0, 4.0), (2, 2002, 5.0, 4.0), (3, 2001, 90.0, 0.0)]
    w = spark.createDataFrame(rows, "station_id long, winter int, observed_days double, snow_days double").withColumn("ts", F.lit(0.5))
    r = T.trial_scores(w, ["station_id"], ["ts"], 2).first()
    assert (r.error, r.bias, r.observed, r.computed, r.stations) == (1.5, 0.5, 10.0, 10.5, 2)
    assert r.correlation == pytest.approx(1.0)


def test_one_exchange_and_no_row_multiplied(spark):
    df = spark.createDataFrame(made(1, date(2000, 8, 1), 30, 1), SCHEMA)
    many = [T.Setting({"ts": k / 10}, Melt(k / 10)) for k in range(60)]
    plan = T.trial_winters(df, many, ["station_id"], "seen")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert plan.index("MapInArrow") > plan.index("Generate")  # counts are exploded after the task, days never


def test_days_that_lie_by_station_are_not_moved_and_no_frame_slides(spark):
    """Before, the days of stations were shuffled for the windows and again for the trials, and a day cost as many steps as
    its windows have days."""
    held = spark.createDataFrame([(1, date(2000, 1, 2), 4.0)], "station_id long, day date, tas double").withColumn("source", F.lit("obs"))
    cells = spark.createDataFrame([(1,), (2,)], "station_id long")
    df = spine.densify(held, cells, (("obs", "2000-01-01", "2000-12-31"),), ["tas"], "station_id").drop("source")
    df = df.withColumns({f"w{n}": T.warm_column("tas", n, ["station_id"]) for n in (5, 20)}).withColumns({"pr": F.lit(1.0), "seen": F.lit(True)})
    one = T.trial_winters(df, [T.Setting({"n": n}, warm=f"w{n}") for n in (5, 20)], ["station_id"], "seen")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$()") == plan.count("specifiedwindowframe(RangeFrame") > 0


def test_warm_days_are_calendar_days(spark):
    rows = [(1, date(2000, 1, d), t) for d, t in ((1, 1.25), (2, None), (3, 2.5), (9, 4.0), (10, 0.1), (11, 0.2), (20, float("nan")), (21, 1.0), (27, 3.0))]
    df = spark.createDataFrame([*rows, (2, date(2000, 1, 12), 9.0), (None, date(2000, 1, 13), 8.0)], "station_id long, day date, tas double")
    got = {(r.station_id, r.day.day): r.w for r in df.withColumn("w", T.warm_column("tas", 5, ["station_id"])).collect()}
    want = {1: None, 2: 1.25, 3: 1.25, 9: None, 10: 4.0, 11: 2.05, 20: None, 21: float("nan"), 27: None}
    assert got == {(1, d): pytest.approx(v, nan_ok=True) if v is not None else None for d, v in want.items()} | {(2, 12): None, (None, 13): None}


def test_settings_that_differ_by_the_level_share_a_stock(monkeypatch):
    """Before, each level had its own stock."""
    columns = {"tas": np.array([-1.0, -1.0, 0.5]), "_pr": np.array([1.0, 2.0, 0.0]), "_season": np.ones(3), "_seen": np.ones(3)}
    wide, real = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda a, axis: wide.append(a.shape) or real(a, axis))
    settings = [T.Setting({}, Melt(0.0, m, s)) for s in (1.0, 2.5) for m in (1.0, 4.0)]
    assert T._counts(settings, columns).tolist() == [3, 3, 2, 1] and wide == [(2, 3)]
