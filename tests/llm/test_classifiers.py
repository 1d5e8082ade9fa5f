"""Held-out accuracy of the trained operators, and the cases that their docstrings define."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from quernstone.llm import language_id as L
from quernstone.llm import quality as Q
from quernstone.llm import toxicity as X

MORE = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.01")


def held(doc_id, divisor, remainder):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


def test_languages(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang")
    rows = L.op1_language_id(spark, MORE).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, f"the cat and the dog number {i} walked home", "en") for i in range(40)] + [(i, f"der Hund und die Katze Nummer {i} gingen heim", "de") for i in range(40, 80)] + [(90, "le chat", None)], "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 %$ 34"), (4, "the dog walked"), (5, "die Katze"), (6, "xqzv wkj"), (7, "the dog walked"), (8, "the cat " * 20_000), (None, "x")], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS lang_pred0", "'z' AS _score")
    got = {r.doc_id: r for r in model.with_language(rows).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert (got[4].lang_pred, got[5].lang_pred, got[8].lang_pred) == ("en", "de", "en") and got[4].score == got[7].score
    assert got[6].rejected and {r.doc_id for r in L.keep_known(rows, model).collect()} >= {4, 7}
    assert L.keep_known(rows, model).columns == rows.columns and model.with_language(rows.limit(0)).count() == 0
    empty = L.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in empty.with_language(rows).collect()} == {"und"}


@pytest.mark.parametrize(("query", "label", "threshold", "least"), [(X.op3_toxicity, "toxic", 0.5, 0.85), (Q.op5_quality, "quality", 0.3, 0.93)])
def test_labels(spark, query, label, threshold, least):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, MORE).join(labels, "doc_id").where("y IS NOT NULL").collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.y for r in tested) >= least * len(tested)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, "a plain sentence of words, one after the other." if i % 2 else "BUY NOW!! $$$ ### !!") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None), (999, 1), (None, 1)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "another plain sentence of words."), (4, "BUY!! $$$ ###"), (5, "word " * 60_000)], "doc_id long, text string").selectExpr("doc_id", "text", "7 AS quality", "8 AS features")
    got = {r.doc_id: r.score for r in model.with_quality(rows).collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4] and all(0 <= s <= 1 for s in got.values())
    assert len(model.attention("word " * 200)) == 4 and model.attention("word " * 200).sum() == pytest.approx(1)
    assert model.with_quality(rows.limit(0)).count() == 0
    one_class = Q.fit_quality(docs, labels.where("quality = 1"))
    assert {r.score for r in one_class.with_quality(rows).collect()} == {1.0}
    assert {r.score for r in Q.fit_quality(docs, labels.limit(0)).with_quality(rows).collect()} == {0.0}


def test_quality_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    model = Q.QualityModel(0.5)
    x, parts, y = rng.normal(size=(12, len(Q.FEATURES))), np.array([3, 1, 5, 3]), np.array([0.0, 1, 1, 0])
    model.fit(x, parts, y, 3)

    def nudge(weight, at, by):
        out = np.array(weight, dtype=float)
        out[at] += by
        return out

    def loss():
        p = model._forward(x, parts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * sum((w**2).sum() for w in model.weights.values())

    for name, gradient in model._gradients(x, parts, y).items():
        weight = model.weights[name]
        at = tuple(int(rng.integers(n)) for n in weight.shape)
        before = np.array(weight, dtype=float)
        model.weights[name] = nudge(before, at, 1e-5)
        up = loss()
        model.weights[name] = nudge(before, at, -1e-5)
        down = loss()
        model.weights[name] = before
        assert (up - down) / 2e-5 == pytest.approx(np.asarray(gradient)[at], abs=1e-5)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, f"you are a moron and trash number {i}" if i % 2 else f"the weather of day {i} was fine") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (999, 1)], "doc_id long, toxic int")
    model = X.fit_toxicity(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "you moron"), (4, "fine weather"), (5, "calm " * 60_000)], "doc_id long, text string").selectExpr("doc_id", "text", "7 AS toxic", "8 AS features", "9 AS _features")
    got = {r.doc_id: r.score for r in model.with_toxicity(rows).collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4] and all(0 <= s <= 1 for s in got.values())
    assert model.with_toxicity(rows.limit(0)).count() == 0
    assert {r.score for r in X.fit_toxicity(docs, labels.limit(0)).with_toxicity(rows).collect()} == {0.0}
