"""Language and quality: held-out results, and scores against plain sums."""

import zlib

import numpy as np
import pyarrow as pa
from conftest import SMALL

from daygrid.llm import compress_lang, gam_quality, q_classes

MIDDLE = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = q_classes.language(spark, MIDDLE).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == langs[r.doc_id] for r in sure) >= 0.97 * len(sure)


def test_language_of_messy_rows(messy):
    model = compress_lang.learn(messy)
    assert "xx" in model and None not in model
    rows = compress_lang.predict(messy, model).collect()
    assert len(rows) == messy.count()
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 4, 5)} <= set(model)
    nothing = compress_lang.predict(messy, compress_lang.learn(messy.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_the_dictionary_is_bounded(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert all(0 < len(v) <= 5000 for v in compress_lang.learn(docs, 5000).values())


def test_languages_whose_texts_are_all_long_are_learned(spark, documents):
    given = {}
    for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect():
        given.setdefault(r.lang, []).append(r.text)
    long = {x: "\n".join(t for t in given[x][40:] if len(t) < 5000)[:60_000] for x in ("de", "fr")}
    rows = [(0, long["de"], "de", "a", 0), (1, long["fr"], "fr", "a", 0)] + [(2 + k, t, "en", "a", 0) for k, t in enumerate(given["en"][:20])]
    model = compress_lang.learn(documents(rows))
    assert set(model) == {"de", "fr", "en"}
    # a long text gives its bound, from several places
    assert all(compress_lang.SAMPLE_TEXT // 2 < len(model[x]) <= compress_lang.SAMPLE_TEXT + compress_lang.PLACES for x in ("de", "fr"))
    only_long = compress_lang.learn(documents(rows[:2]))
    assert set(only_long) == {"de", "fr"}
    asked = [(k, t, x) for k, (x, t) in enumerate((x, t) for x in ("de", "fr") for t in given[x][:40] if len(t) > 400)]
    for m in (model, only_long):
        got = {r.doc_id: r.lang_pred for r in compress_lang.predict(documents([(k, t, None, "a", 0) for k, t, _ in asked]), m).collect()}
        assert sum(got[k] == x for k, _, x in asked) >= 0.9 * len(asked)


def test_quality_of_held_out_texts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = q_classes.quality(spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = np.array([r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1])
    bad = np.array([r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0])
    assert (good[:, None] > bad[None, :]).mean() >= 0.95 and (good >= 0.3).mean() >= 0.98


def test_scores_are_sums_of_tables():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)) | (x[:, 2] > 1.5)
    model = gam_quality.fit(x, y.astype(float))
    assert (0, 1) in model.pairs  # the interaction is found
    assert ((model.scores(x) > 0.5) == y).mean() > 0.93
    for k in (0, 17, 3999):
        total = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, x[k], strict=True))
        total += sum(g[tuple(np.searchsorted(model.coarse[i], x[k, i], side="right") for i in p)] for p, g in zip(model.pairs, model.grids, strict=True))
        assert abs(model.scores(x[k:k + 1])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_features_do_not_depend_on_the_batch():
    texts = ["One two.\nOne two.\nThree *** four!!", "", None, "é|é", "a a a a", "x" * 3_000_000 + " end", "same same words again same same words again"]
    whole = gam_quality.features(pa.array(texts))
    assert whole.shape == (len(texts), len(gam_quality.FEATURES)) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert np.allclose(gam_quality.features(pa.array([t])), whole[k])
    at = {n: k for k, n in enumerate(gam_quality.FEATURES)}
    assert whole[1].tolist() == whole[2].tolist() == [0.0] * len(gam_quality.FEATURES)
    assert whole[4, at["same_next"]] == 0.75 and whole[4, at["top_word"]] == 1 and whole[4, at["distinct_words"]] == 0.25
    assert np.isclose(whole[0, at["repeated_lines"]], 1 / 3) and np.isclose(whole[0, at["signed_words"]], 1 / 7)


def test_quality_of_messy_rows(spark, messy):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = gam_quality.learn(messy, labels)
    rows = gam_quality.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert gam_quality.kept(messy, model, 0.0).count() == messy.count() and gam_quality.kept(messy, model, 0.0).columns == messy.columns
    empty = gam_quality.learn(messy, labels.limit(0))
    assert {r.score for r in gam_quality.score(messy, empty).collect()} == {0.5}
    assert gam_quality.score(messy.limit(0), model).collect() == []


def test_letters_are_of_category_l(documents):
    rows = documents([(k, t, "en", "a", 1) for k, t in enumerate(["\u00bd \u00b2", "\u2460 \u2167", "12_3", "\u0301", "a", "\u00e9t\u00e9"])])
    got = {r.doc_id: r for r in compress_lang.predict(rows, {"en": b"the word and other words", "fr": b"le mot et les autres"}).collect()}
    assert [got[k].lang_pred == "und" and got[k].score == 0 for k in range(6)] == [True] * 4 + [False] * 2
