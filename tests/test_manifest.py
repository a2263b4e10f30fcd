"""Increments of a stored copy and its manifest; copies compared."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daygrid.session import shared_folder
from daygrid.sources import checks, layout, manifest

SCHEMA = "source string, cell_id long, day date, tas double"


def days(source, cell, first, n, value=1.0):
    return [(source, cell, first + timedelta(k), value) for k in range(n)]


def held(spark, path):
    return sorted(map(tuple, layout.read_copy(spark, path).select("source", "cell_id", "day", "tas").collect()))


def told(spark, path):
    return {(r.source, r.year): r.n_rows for r in spark.read.schema(manifest.SCHEMA).parquet(f"{path}/{manifest.NAME}").collect()}


def test_increments(spark):
    path = shared_folder(spark)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    first = days("a", 1, date(2000, 12, 1), 60) + days("b", 1, date(2001, 1, 1), 10)
    layout.write_years(make(first), path)
    assert held(spark, path) == sorted(first)
    assert told(spark, path) == {("a", 2000): 31, ("a", 2001): 29, ("b", 2001): 10}
    # equal years are not read again: other values change nothing
    assert layout.missing_years(make([(*r[:3], 9.0) for r in first]), spark, path).count() == 0
    # one year gains a cell and keeps a row that only the copy holds; a new year comes
    more = days("a", 2, date(2001, 1, 1), 5) + days("a", 1, date(2001, 1, 2), 3, 7.0) + days("b", 1, date(2002, 1, 1), 2)
    layout.write_years(make(more), path)
    want = {r[:3]: r[3] for r in first} | {r[:3]: r[3] for r in more}
    assert held(spark, path) == sorted((*k, v) for k, v in want.items())
    assert told(spark, path) == {("a", 2000): 31, ("a", 2001): 34, ("b", 2001): 10, ("b", 2002): 2}


def test_a_lost_manifest_is_counted_again(spark):
    path = shared_folder(spark)
    rows = days("a", 1, date(2000, 1, 1), 40)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("year", F.year("day"))
    df.write.partitionBy("source", "year").parquet(path)  # a copy from before there were manifests
    assert layout.missing_years(df.drop("year"), spark, path).count() == 0
    layout.write_years(spark.createDataFrame(rows + days("a", 2, date(2000, 1, 1), 1), SCHEMA), path)
    assert len(held(spark, path)) == 41 and told(spark, path) == {("a", 2000): 41}


def test_a_manifest_that_tells_too_little_only_costs_a_look(spark):
    path = shared_folder(spark)
    df = spark.createDataFrame(days("a", 1, date(2000, 1, 1), 40), SCHEMA)
    layout.write_years(df, path)
    manifest.write(manifest.manifest(df.filter("day < '2000-01-20'")), path)
    assert layout.missing_years(df, spark, path).count() == 0
    layout.write_years(df, path)
    assert len(held(spark, path)) == 40


def test_digest(spark):
    rows = days("a", 1, date(2000, 1, 1), 20)
    digest = lambda r: [x.digest for x in manifest.manifest(spark.createDataFrame(r, SCHEMA)).collect()]
    assert digest(rows) == digest(rows[::-1])
    assert digest(rows) != digest(rows + rows[:1]) and digest(rows) != digest(rows[1:] + days("a", 2, date(2000, 1, 1), 1))
    assert digest([("a", 1, None, 1.0)]) == [] == digest([])


def test_reconcile_by_its_own_step(spark):
    schema = "source string, cell_id long, day date, x double, y double"
    d = date(2000, 1, 1)
    a = spark.createDataFrame([("s", 1, d, 1.0, 1.0), ("s", 2, d, None, 2.0)], schema)
    b = spark.createDataFrame([("s", 1, d, 1.4, 1.4), ("s", 2, d, 3.0, 2.0)], schema)
    got = {r.variable: r for r in checks.reconcile(a, b, {"x": 1.0, "y": 0.5}).collect()}
    assert (got["x"].lone_rows, got["x"].lone_gaps, got["x"].agrees) == (0, 1, False)
    assert (got["y"].lone_gaps, got["y"].agrees) == (0, False) and got["y"].largest == pytest.approx(0.4)
    assert checks.reconcile(a, b, {"y": 1.0}).first().agrees
    lone = checks.reconcile(a, b.filter("cell_id = 1"), {"y": 1.0}).first()
    assert lone.lone_rows == 1 and not lone.agrees
    assert checks.reconcile(a.limit(0), b.limit(0), {"y": 1.0}).first().agrees
    plan = checks.reconcile(a, b, {"x": 1.0, "y": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Generate") < plan.index("Join ")  # rows per variable only after the sums


def test_only_pairs_that_the_copy_holds_in_part_meet_its_rows(spark, monkeypatch):
    """Before, the rows of every new year were shuffled against the copy and checkpointed, and all of them counted again."""
    path, met, counted = shared_folder(spark), [], []
    layout.write_years(spark.createDataFrame(days("a", 1, date(2000, 1, 1), 300), SCHEMA), path)
    more = days("a", 2, date(2000, 1, 1), 3) + days("a", 1, date(2001, 1, 1), 365) + days("b", 1, date(2000, 1, 1), 366)
    put, count = layout.cut, manifest.manifest
    monkeypatch.setattr(layout, "cut", lambda df: met.append(put(df)) or met[-1])
    monkeypatch.setattr(manifest, "manifest", lambda df: counted.append(df) or count(df))
    layout.write_years(spark.createDataFrame(more, SCHEMA).repartition(3), path)
    assert [df.count() for df in met] == [300]  # what only the copy has of the one year both hold
    assert len(counted) == 2 and counted[0].count() == len(more)
    assert told(spark, path) == {("a", 2000): 303, ("a", 2001): 365, ("b", 2000): 366}
    assert held(spark, path) == sorted(days("a", 1, date(2000, 1, 1), 300) + more)
