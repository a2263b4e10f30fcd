"""Near duplicates and components against brute force."""

import random
import re

import pytest
from conftest import SMALL

from daygrid.llm import components, minhash_dedup


def brute(rows, words, percent):
    sets = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.setdefault(doc_id, set()).update({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    names = sorted(sets)
    least = {n: n for n in names}
    again = True
    linked = [(a, b) for a in names for b in names if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while again:
        again = False
        for a, b in linked:
            m = min(least[a], least[b])
            again |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return {n: (len(sets[n]), least[n]) for n in names}


def answer(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, **how).collect()}


def near_copies(seed=5):
    """A text with copies at all distances, copies of copies, exact copies, and short texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(3):
        first = [word() for _ in range(120)]
        out.append(first)
        for k in range(24):
            copy = list(draw.choice(out[-3:]) if k % 3 == 0 else first)
            for _ in range(k % 7):
                copy[draw.randrange(len(copy))] = word()
            out.append(copy)
    draw.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)] + [(200, "one two"), (201, "ONE  two"), (202, "one"), (203, ""), (204, None), (205, " \n")]


@pytest.mark.parametrize("block", [2048, 3])
@pytest.mark.parametrize("how", [{"words": 3, "percent": 85}, {"words": 5, "percent": 80}])
def test_against_all_pairs(documents, monkeypatch, block, how):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)  # 3: buckets are cut to many blocks
    rows = near_copies()
    want = brute(rows, **how)
    assert answer(documents(rows), **how) == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 3, 85)
    from daygrid.llm import q_dedup

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q_dedup.dedup(spark, SMALL).collect()}
    assert got == want


def test_messy_rows(messy):
    rows = minhash_dedup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 0 and not by[5].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept and by[3].kept
    assert by[6].n_shingles == 1 and by[6].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash_dedup.near_duplicates(messy.limit(0)).collect() == []


def test_components(spark):
    draw = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {n: n for pair in links for n in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: least[n] for a, b in links if a != b for n in (a, b)}


def test_misses_at_the_threshold_are_rare():
    for percent in (70, 80, 85, 95):
        rows, least = minhash_dedup.plan(percent)
        assert (1 - (percent / 100) ** rows) ** minhash_dedup.BANDS <= minhash_dedup.MISS
        assert 0 < least <= rows * minhash_dedup.BANDS
