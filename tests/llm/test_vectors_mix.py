"""Neighbours and mixing."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.llm import ann_graph, poisson_mix


def exact(rows, ask, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in good:
        if ask(q):
            near = [(-float(good[q] @ v / np.sqrt(good[q] @ good[q]) / np.sqrt(v @ v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("shard", [8192, 300])
def test_recall(spark, monkeypatch, shard):
    draw = np.random.default_rng(2)
    rows = [(int(k), v.tolist()) for k, v in enumerate(draw.normal(size=(1500, 24)))]
    rows += [(2000 + k, rows[0][1]) for k in range(200)]  # a vector that many rows share
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann_graph.build, "__defaults__", (shard,))
    got, want = found(ann_graph.nearest(df, "vec_id % 20 = 0", 5)), exact(rows, lambda q: q % 20 == 0, 5)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    score = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - score[q, i]) < 1e-8 for q in got for i, s in got[q] if (q, i) in score)
    assert [i for i, _ in got[0]] == [2000, 2001, 2002, 2003, 2004] and [i for i, _ in got[2020]] == [0, 2000, 2001, 2002, 2003]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
            (7, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (10, [3e38, 3e38])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, members string")
    got = found(ann_graph.nearest(df, "true", 5))
    # 7 and 10 point the same way, up to the last bit
    assert {q: [i for i, _ in v][:1] for q, v in got.items()} == {0: [1], 1: [0], 7: [10], 10: [7]}
    assert {q: {i for i, _ in v} for q, v in got.items()} == {0: {1, 7, 10}, 1: {0, 7, 10}, 7: {10, 0, 1}, 10: {7, 0, 1}}
    assert [i for i, _ in got[7]] == [10, 0, 1] and [i for i, _ in got[10]] == [7, 0, 1]
    assert ann_graph.nearest(df.limit(0), "true", 5).collect() == []


def test_copies_follow_the_rates(spark, documents):
    rows = [(k, "x" * 50, "en", "big" if k % 3 else "small", 50) for k in range(3000)] + [(5000, "y", "en", None, 1), (5001, None, "en", "empty", 0)]
    docs = documents(rows)
    rate = {r.source: r.rate for r in poisson_mix.rates(docs, {"big": 1.0, "small": 3.0}, other=0.0).collect()}
    total = 3000 * 50 + 1
    assert rate["big"] == pytest.approx(total / 4 / (2000 * 50)) and rate["small"] == pytest.approx(3 * total / 4 / (1000 * 50))
    assert rate[None] == 0 and rate["empty"] == 1
    out = poisson_mix.mixed(docs, {"big": 1.0, "small": 3.0}, other=0.0)
    again = poisson_mix.mixed(docs.repartition(7), {"big": 1.0, "small": 3.0}, other=0.0)
    assert sorted(out.columns) == sorted([*docs.columns, "order_key"])
    got = [(r.doc_id, r.copy, r.order_key) for r in out.collect()]
    assert sorted(got) == sorted((r.doc_id, r.copy, r.order_key) for r in again.collect())
    assert [k for *_, k in got] == sorted(k for *_, k in got)
    counts = Counter(d for d, *_ in got)
    for name, ids in (("big", [r[0] for r in rows if r[3] == "big"]), ("small", [r[0] for r in rows if r[3] == "small"])):
        n = np.array([counts[d] for d in ids])
        assert n.mean() == pytest.approx(rate[name], rel=0.08) and n.var() == pytest.approx(rate[name], rel=0.2)
    assert counts[5000] == 0


def test_large_rates(spark, documents):
    docs = documents([(k, "x", "en", "few", 1) for k in range(30)])
    n = Counter(r.doc_id for r in poisson_mix.mixed(docs, epochs=900.0).select("doc_id").collect())
    assert np.mean([n[k] for k in range(30)]) == pytest.approx(900, rel=0.03)


def large(spark, u, rate):
    df = spark.createDataFrame([(k, float(x), rate) for k, x in enumerate(u)], "at int, u double, rate double")
    for name, step in poisson_mix.large_steps("u", "rate"):
        df = df.withColumn(name, F.expr(step))
    return [r[0] for r in df.orderBy("at").select("__k").collect()]


def test_large_counts_against_the_table(spark):
    """The expansion against the inverse of the summed distribution, and for a rate no table could hold."""
    for rate in (201.0, 1000.0, 30_000.0):
        k = np.arange(int(rate + 12 * rate**0.5 + 24))
        upto = np.cumsum(np.exp(-rate + np.r_[0, np.cumsum(np.log(rate) - np.log(k[1:]))]))
        u = (np.arange(4000) + 0.5) / 4000
        want = (upto[None, :] <= u[:, None]).sum(1)
        gap = np.array(large(spark, u, rate)) - want
        assert abs(gap).max() <= 1 and (gap != 0).mean() < 0.01
    assert abs(large(spark, [0.5], 4e12)[0] - 4 * 10**12) < 10 and 0 < large(spark, [0.0], 201.0)[0] < 100


def test_one_short_text_beside_many(spark, documents):
    """A rate of hundreds of thousands ends, with as many copies as drawn."""
    docs = documents([(k, "x" * 5000, "en", "big", 5000) for k in range(400)] + [(1000, "abcd", "en", "tiny", 4)])
    rate = {r.source: r.rate for r in poisson_mix.rates(docs).collect()}["tiny"]
    assert rate > 200_000
    n = poisson_mix.mixed(docs).filter("source = 'tiny'").agg(F.count("*"), F.countDistinct("copy"), F.max("copy")).first()
    assert len(set(n)) == 1 and abs(n[0] - rate) < 6 * rate**0.5


def test_messy_rows(messy):
    out = poisson_mix.mixed(messy, epochs=3.0)
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in messy.collect()}
    assert poisson_mix.mixed(messy.limit(0)).collect() == []


def test_salted_join_gives_the_same(messy, monkeypatch):
    want = sorted(str(r) for r in poisson_mix.mixed(messy, epochs=3.0).select("doc_id", "copy", "order_key").collect())
    monkeypatch.setattr(poisson_mix, "MOST_SENT", 0)
    assert sorted(str(r) for r in poisson_mix.mixed(messy, epochs=3.0).select("doc_id", "copy", "order_key").collect()) == want


def test_seeds_differ(messy):
    keys = {r.order_key for r in poisson_mix.mixed(messy, epochs=5.0, seed=1).collect()}
    assert not keys & {r.order_key for r in poisson_mix.mixed(messy, epochs=5.0, seed=2).collect()}
