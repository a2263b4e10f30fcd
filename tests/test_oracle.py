"""Every registered query against its SQL twin, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from daygrid import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.8g}"
        return str(v)

    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_every_query_has_its_twin():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
