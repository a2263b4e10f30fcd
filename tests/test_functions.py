"""Column functions against published numbers and hand values."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.functions import calendar as C
from daygrid.functions import classes, et0, geo, humidity
from daygrid.functions.expr import clip, half_even
from daygrid.functions.quantiles import levels, quantile_array, quantiles_of_sorted, rank_in, read_at

D = lambda y, m, d: F.lit(date(y, m, d))


def test_penman_monteith_worked_example(spark, one):
    """FAO-56 example 18."""
    u2 = et0.wind_2m(F.lit(2.78))
    ea, es = F.lit(1.409), et0.mean_saturation(F.lit(21.5), F.lit(12.3))
    ra = et0.extraterrestrial(F.lit(50.80), F.lit(187))
    rso = et0.clear_sky(ra, F.lit(100.0))
    rnl = et0.net_longwave(F.lit(21.5), F.lit(12.3), ea, F.lit(22.07), rso)
    rn = 0.77 * F.lit(22.07) - rnl
    value = et0.penman_monteith(F.lit(21.5), F.lit(12.3), ea, es, u2, rn, et0.pressure(F.lit(100.0)))
    got = one(u2, et0.pressure(F.lit(100.0)), ra, rso, rnl, rn, value)
    assert np.allclose(got, [2.078, 100.1, 41.09, 30.90, 3.71, 13.28, 3.88], atol=[0.002, 0.06, 0.02, 0.02, 0.02, 0.03, 0.02])


def test_penman_monteith_hot_example(one):
    """FAO-56 example 17: monthly means at 13.73 N."""
    es = et0.mean_saturation(F.lit(34.8), F.lit(25.6))
    value = et0.penman_monteith(F.lit(34.8), F.lit(25.6), F.lit(2.85), es, F.lit(2.0), F.lit(14.33), et0.pressure(F.lit(2.0)), F.lit(0.14))
    got = one(es, et0.extraterrestrial(F.lit(13.73), F.lit(105)), value)
    assert np.allclose(got, [4.42, 38.06, 5.72], atol=[0.02, 0.02, 0.02])


def test_radiation(one):
    got = one(et0.extraterrestrial(F.lit(45.72), F.lit(196)), et0.extraterrestrial(F.lit(80.0), F.lit(1)))
    assert got[0] == pytest.approx(40.55, abs=0.02) and got[1] == pytest.approx(0.0, abs=1e-9)


def test_staged_et0_equals_the_formula(spark):
    df = spark.createDataFrame([(date(2001, 7, 6), 21.5, 12.3, 70.0, 2.78, 255.0, 50.8, 100.0), (date(2001, 1, 6), None, 1.0, 80.0, 3.0, 40.0, 50.8, 0.0)],
                               "day date, tasmax double, tasmin double, hurs double, sfcWind double, rsds double, lat double, alt double")
    a, b = et0.with_et0(df, "lat", "alt").orderBy("day").collect()
    assert a.et0 is None
    es = et0.mean_saturation("tasmax", "tasmin")
    ea = et0.actual_vapour("tasmax", "tasmin", "hurs")
    rs = F.col("rsds") * 0.0864
    rso = et0.clear_sky(et0.extraterrestrial("lat", F.dayofyear("day")), "alt")
    rn = 0.77 * rs - et0.net_longwave("tasmax", "tasmin", ea, rs, rso)
    whole = et0.penman_monteith("tasmax", "tasmin", ea, es, et0.wind_2m("sfcWind"), rn, et0.pressure("alt"))
    assert b.et0 == pytest.approx(df.filter("tasmax is not null").select(whole).first()[0], abs=1e-9)


def test_wet_bulb_and_humid_heat(one):
    wb = humidity.wet_bulb(F.lit(32.0), F.lit(90.0))
    got = one(wb, humidity.wet_bulb(F.lit(20.0), F.lit(120.0)), humidity.wet_bulb(F.lit(None).cast("double"), F.lit(50.0)),
              classes.humid_heat(F.lit(30.0)), classes.humid_heat(F.lit(26.0)), classes.humid_heat(F.lit(25.9)), classes.humid_heat(F.lit(None).cast("double")))
    assert got[0] == pytest.approx(30.6, abs=0.06) and got[1] <= 20.0 and got[2] is None and list(got[3:]) == [2, 1, 0, None]


def test_specific_humidity(one):
    a, b = one(humidity.specific_humidity(F.lit(100.0), F.lit(293.15), F.lit(101325.0)), humidity.specific_humidity(F.lit(50.0), F.lit(293.15), F.lit(101325.0)))
    assert a == pytest.approx(0.01448, abs=2e-5) and b / a == pytest.approx(0.5, abs=0.005)


@pytest.mark.parametrize("pr,tas,clt,want", [
    (1.0, 1.4, 0.0, "snow"), (1.0, 1.5, 0.0, "rain"), (5.0, None, 50.0, None), (0.9, 0.0, 70.0, "overcast"), (0.0, 0.0, 69.9, "cloudy"),
    (0.0, 0.0, 30.0, "cloudy"), (0.0, 0.0, 29.9, "clear"), (None, 0.0, 10.0, None), (0.0, 0.0, None, None)])
def test_sky(one, pr, tas, clt, want):
    c = [F.lit(v).cast("double") for v in (pr, tas, clt)]
    assert one(classes.sky(*c))[0] == want


def test_bands_and_classes(one):
    bands = one(*[classes.temperature_band(F.lit(v).cast("double")) for v in (-0.1, 0.0, 4.9, 5.0, 39.9, 40.0, 60.0, None)])
    assert list(bands) == [0, 1, 1, 2, 8, 9, 9, None]
    t = one(*[classes.temperature_class(F.lit(v)) for v in (-2.0, -1.5, -0.5, -0.49, 0.0, 0.5, 1.49, 1.5)])
    assert list(t) == ["much_colder", "much_colder", "colder", "near", "near", "warmer", "warmer", "much_warmer"]
    r = one(*[classes.rain_class(F.lit(v)) for v in (0.3, 0.5, 0.79, 0.8, 1.2, 1.21, 1.5, 1.6)])
    assert list(r) == ["much_drier", "drier", "drier", "near", "near", "wetter", "wetter", "much_wetter"]
    g = one(*[classes.gap_tone(F.lit(v)) for v in (5.0, 0.1, 0.0, -0.1, -5.0)])
    assert list(g) == ["much-warm", "warm", "", "cool", "much-cool"]
    assert list(one(*[classes.colour_position(F.lit(v)) for v in (-9.0, -3.0, 0.0, 1.5, 9.0)])) == [0.0, 0.0, 2.0, 3.0, 4.0]


def test_slots(one):
    got = one(C.slot365(D(2020, 2, 27)), C.slot365(D(2020, 2, 28)), C.slot365(D(2020, 2, 29)), C.slot365(D(2020, 3, 1)),
              C.slot365(D(2021, 12, 31)), C.slot365(D(2100, 3, 1)), C.slot366(D(2021, 3, 1)), C.slot366(D(2020, 2, 29)))
    assert list(got) == [57, 58, 58, 59, 364, 59, 60, 59]


def test_windows(one):
    first = [one(C.sliding_first(F.lit(y)))[0] for y in (2050, 1970, 2100)]
    assert first == [2035, 1970, 2071]
    held = {1985: (1970, 2025), 1972: (1970, 2025), 2020: (1970, 2025), 2030: (2027, 2100), 2084: (2027, 2100), 2098: (2027, 2100)}
    got = [one(C.window_first(F.lit(y), 15, F.lit(a), F.lit(b)))[0] for y, (a, b) in held.items()]
    assert got == [1978, 1970, 2011, 2027, 2077, 2086]


def test_shifted_dates(one):
    got = one(C.shifted(D(2048, 2, 29), F.lit(-1)), C.shifted(D(2048, 4, 30), F.lit(-1)), C.shifted(D(2046, 12, 21), F.lit(-55)), C.shifted(D(2047, 3, 20), F.lit(-55)))
    assert list(got) == [date(2047, 2, 28), date(2047, 4, 30), date(1991, 12, 21), date(1992, 3, 20)]


def test_seasons_round_trip(one):
    for lat in (45.0, -45.0):
        for name in ("spring", "summer", "autumn", "winter"):
            r = C.season_range(F.lit(name), F.lit(2030), F.lit(lat))
            a, b = one(C.display_season(r["first_day"], F.lit(lat)), C.display_season(r["last_day"], F.lit(lat)))
            assert (a, b) == (name, name)


def test_guarded_clip_and_rounding(one):
    none = F.lit(None).cast("double")
    got = one(clip(none, 0.0, 1.0), clip(F.lit(2.0), 0.0, 1.0), half_even(F.lit(0.5)), half_even(F.lit(1.5)), half_even(F.lit(2.345), 2), half_even(none, 1))
    assert list(got) == [None, 1.0, 0.0, 2.0, np.round(2.345, 2), None]


def test_rank_with_ties(one):
    q = F.array(*[F.lit(0.0)] * 30, *[F.lit(float(v)) for v in range(1, 71)])
    got = one(*[rank_in(F.lit(v), q) for v in (0.0, 100.0, -5.0, 500.0)])
    assert list(got) == [14.5, 99.0, 0.0, 99.0]


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=257)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = df.agg(quantile_array("v").alias("q"), quantiles_of_sorted(F.array_sort(F.collect_list("v"))).alias("s")).first()
    want = np.quantile(x, levels(100))
    assert np.allclose(got.q, want, atol=1e-9) and np.allclose(got.s, want, atol=1e-9)


def test_table_read(one):
    t = F.array(F.lit(0.0), F.lit(10.0), F.lit(40.0))
    assert list(one(*[read_at(t, F.lit(v)) for v in (0.0, 0.5, 1.5, 2.0)])) == [0.0, 5.0, 25.0, 40.0]


def test_projections(one):
    lat, lon = geo.rotated_to_geographic(F.lit(0.0), F.lit(0.0), 39.25, -162.0)
    assert np.allclose(one(lat, lon), [50.75, 18.0], atol=1e-9)
    la, lo = geo.laea_to_geographic(F.lit(4321000.0), F.lit(3210000.0))
    assert np.allclose(one(la, lo), [52.0, 10.0], atol=1e-9)
    # Paris in the European equal-area projection.
    la, lo = geo.laea_to_geographic(F.lit(3760605.0), F.lit(2889234.0))
    assert np.allclose(one(la, lo), [48.85, 2.35], atol=0.02)
    assert one(geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(45.764), F.lit(4.8357)))[0] == pytest.approx(391.5, abs=1.0)
