"""Plans that must hold at scale: no row-level cross join, no unpartitioned window, no collection in operators."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from conftest import ROOT, SMALL

BIG = ("join9_nearest_town", "join12_cells_in_region", "join19_neighbours", "norm1_2_pooled_normals", "year3_against_reference", "snow1_stock_soil1_liquid",
       "qdm7_10_additive_sliding", "perf1_additive_by_group", "reg12_heat_waves", "val5_spatial_coherence", "map7_contours", "map4_smooth_twice")


def plan(spark, name):
    df = entry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BIG)
def test_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert not re.search(r"Window \[[^\]]*\], \[\]", text)


def test_smoothing_shuffles_its_rows_once(spark):
    """Both windows of every pass live inside one hashing by (source, day)."""
    text = plan(spark, "map4_smooth_twice")
    assert len(re.findall(r"hashpartitioning\(source#\d+, day#\d+, ", text)) == 1


def test_operators_collect_nothing():
    for folder in ("operators", "functions", "plans", "streaming", "sources"):
        for path in pathlib.Path(ROOT, "daygrid", folder).glob("*.py"):
            text = path.read_text()
            assert not re.search(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(", text), path


def test_remap_shuffles_packed_rows_once(spark):
    """Days travel packed by cell and year: nothing is exchanged by day or by target."""
    text = plan(spark, "join6_remap")
    assert not re.search(r"hashpartitioning\([^)]*(day#|cell_to#)", text.replace("cell_from", "")) and len(re.findall(r"hashpartitioning\(_block#\d+L?, _salt#\d+", text)) == 1


@pytest.mark.parametrize("name", ["join15_stations_around", "join16_station_cell", "val17_by_distance", "val17_by_density_and_altitude"])
def test_nearest_by_one_meeting(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text and len(re.findall("FileScan", text)) < 30


@pytest.mark.parametrize("name", ["day1_classified_days", "day1_every_column", "snow2_flags_at_places", "soil3_water_at_places"])
def test_days_of_places_stay_where_they_are_made(spark, name):
    """Before, every day of every reading spot was exchanged by (source, spot), and again to meet the searches."""
    assert not re.search(r"hashpartitioning\([^)]*(day#|source#\d+, spot_id#)", plan(spark, name))


@pytest.mark.parametrize("name", ["qdm12_13_rain", "qdm8_multiplicative_sliding"])
def test_days_meet_their_quantiles_where_they_are(spark, name):
    """Before, days were exchanged by window too, and went on to the calibration with the quantiles of their window."""
    assert not re.search(r"hashpartitioning\([^)]*win#", plan(spark, name))
