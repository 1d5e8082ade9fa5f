"""Phrases by sampled grams: the same hits as looking through every text, without reading them all."""

import random

import pytest

from quernstone.operators import grams
from quernstone.operators.phrases import first_phrases, first_texts, phrase_counts
from quernstone.plans import retrieval


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é一", "a"])
def test_like_all_texts(spark, alphabet):
    rng = random.Random(len(alphabet))
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    texts = [text(300) for _ in range(40)]
    texts += [texts[0] + texts[1], texts[2] * 2, "", None, "short"]
    needles = [t[a : a + n] for t in texts[:20] if t for a, n in ((0, 31), (5, 60), (3, 12), (0, 400))] + ["nothing of the kind in any of them at all", "x" * 31, "", "sho"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, hay string").repartition(3)
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    assert rows(grams.look_up(grams.gram_index(docs), asked)) == rows(phrase_counts(docs, asked))
    assert grams.look_up(grams.gram_index(docs), asked.limit(0)).count() == 0


def test_a_stretch_keeps_its_grams():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(31, 200)))
        part = text[(a := rng.randrange(len(text) - 30)) : a + rng.randrange(31, 90)]
        own = grams.kept_grams(part)
        assert len(own) and set(own) <= set(grams.kept_grams(text))


def test_few_texts_are_read(spark, data):
    index = retrieval.stored_grams(spark, data)
    items = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("text AS needle").limit(3)
    plan = grams.look_up(index, items)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [EqualTo(doc_id" in plan or "In(doc_id" in plan or "LocalTableScan" in plan


def test_first_matches(spark):
    rng = random.Random(3)
    names = [(n, p) for p, n in enumerate("ab abc bc c d ab dd".split())]
    paths = [(i, "".join(rng.choice("abcd/") for _ in range(rng.randrange(8)))) for i in range(60)] + [(60, None)]
    phrases = spark.createDataFrame([*names, ("", 9), (None, 8)], "needle string, place long")
    texts = spark.createDataFrame(paths, "doc_id long, hay string").repartition(3)
    held = [(i, p) for i, h in paths for n, p in names if n in (h or "")]
    for batch in (100, 2):
        assert rows(first_phrases(texts, phrases, batch=batch)) == sorted((i, min(p for j, p in held if j == i)) for i in {i for i, _ in held})
        assert rows(first_texts(texts.withColumnRenamed("doc_id", "at"), phrases, batch=batch)) == sorted((p, min(i for i, q in held if q == p)) for p in {p for _, p in held})
    assert first_phrases(texts, phrases.limit(0)).count() == 0
