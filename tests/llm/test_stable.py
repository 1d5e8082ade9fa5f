"""Trained operators give the same model however rows are dealt out, and keep columns whose names clash."""

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import language_id as L
from quernstone.llm import quality as Q
from quernstone.llm import toxicity as X
from quernstone.llm.common import below_share, labelled_sample


def tables(spark, parts):
    docs = spark.createDataFrame([(i % 300, f"you are a moron and trash number {i % 190}" if i % 190 % 2 else f"the weather of day {i % 190} was fine") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 190 % 2 if i % 7 else 1) for i in range(300)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    return docs.repartition(parts), labels.repartition(parts)


def test_same_model_on_any_partitions(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["you moron 3", "fine weather", "you are trash and fine", None])], "doc_id long, text string")
    found = []
    for parts in (4, 51):
        docs, labels = tables(spark, parts)
        sample = sorted(map(tuple, labelled_sample(docs, labels, "toxic", F.lit(False), 100_000).collect()))
        toxic = {r.doc_id: r.score for r in X.fit_toxicity(docs, labels).with_toxicity(texts).collect()}
        quality = Q.fit_quality(docs, labels)
        found.append((sample, toxic, {k: np.round(v, 12).tolist() for k, v in quality.weights.items()}))
    assert found[0] == found[1] and len(found[0][0]) == len({t for _, t, _ in found[0][0]})


def test_columns_that_clash(spark):
    docs, labels = tables(spark, 2)
    rows = docs.limit(5).selectExpr("doc_id", "text", "1 AS score", "2 AS lang_pred", "3 AS rejected", "4 AS _score", "5 AS `a.b`", "6 AS _features")
    lang = L.fit_languages(docs.withColumn("lang", F.lit("en"))).with_language(rows)
    quality = Q.fit_quality(docs, labels).with_quality(rows)
    trees, share = (X.fit_toxicity(docs, x).with_toxicity(rows) for x in (labels, labels.limit(0)))
    for df, new in ((lang, 3), (quality, 1), (trees, 1), (share, 1)):
        assert df.columns[: len(rows.columns)] == rows.columns and len(set(df.columns)) == len(rows.columns) + new
        assert {tuple(r)[2:8] for r in df.select(*[F.col(f"`{c}`") for c in rows.columns]).collect()} == {(1, 2, 3, 4, 5, 6)}
    assert X.score_toxicity(rows, X.ToxicityModel({}, share=0.5)).columns == ["doc_id", "score", "predicted"]


def test_small_shares(spark):
    n = spark.range(200_000).where(below_share(F.xxhash64("id"), 0.01)).count()
    assert 1_700 < n < 2_300 and spark.range(9).where(below_share(F.xxhash64("id"), 1.0)).count() == 9
    assert spark.range(1000).where(below_share(F.xxhash64("id"), 1e-12)).count() == 0
