"""The pipeline stage by stage, and every query with a SQL twin against DuckDB."""

import re

import numpy as np
import pytest
from conftest import SMALL
from test_oracle import rows

import __spark_entry__ as entry
import corpus_pipeline
from daygrid import llm
from daygrid.llm import q_tokens, shared
from llm.test_dedup import brute

ORACLES = llm.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = llm.queries()[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_all_queries_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SMALL)
        if name != "encoding":
            assert sorted(out.columns) == sorted(docs.columns)
        kept.append(shared.written(out, name))
    good, single, clean, mixed, ids = ([tuple(r) for r in df.select("doc_id", "text").collect()] if "text" in df.columns else df.collect() for df in kept[1:])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {d for d, _ in good}
    assert all(d in left for d, q in labels.items() if q == 1) and sum(q == 0 and d in left for d, q in labels.items()) <= 2
    groups = brute(good, 5, 80)
    assert sorted(d for d, _ in single) == sorted({g for _, g in groups.values()})
    before = dict(single)
    assert {d for d, _ in clean} == set(before)
    for d, text in clean:
        assert text == before[d] or ("[secret]" in text and not re.search("[0-9a-f]{24}", text))
    texts = dict(clean)
    assert all(texts[d] == t for d, t in mixed) and abs(len(mixed) - len(clean)) < 0.5 * len(clean)
    tokenizer = Tokenizer.from_file(q_tokens.vocabulary_file())
    want = sorted((d, len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in ids) == want
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(whole) == sorted(ids)
    assert np.all([r.decoded_sha256 for r in whole])


def test_messy_documents_go_through_every_stage(spark, messy):
    for docs in (messy, messy.limit(0)):
        now = shared.written(docs, "messy")
        for name, stage in corpus_pipeline.STAGES:
            now = shared.written(stage(spark, now, SMALL), name)
        assert now.columns[0] == "doc_id"
