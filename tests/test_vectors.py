"""Batches against vectors give what the postings give, and stored indexes follow their table."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import index, rank, vectors
from quernstone.plans import retrieval


def best(scores, k):
    return sorted(tuple(r) for r in rank.number(scores.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), "doc_id"]).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("cells, queries, pairs", [(8_000_000, 2_000, 500_000), (40, 3, 10), (1, 1, 1)])
def test_like_postings(spark, monkeypatch, cells, queries, pairs):
    for name, value in (("CELLS", cells), ("QUERIES", queries), ("PAIRS", pairs)):
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(2)
    words = ["the"] * 8 + [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [("same1", "w1 w2"), ("same2", "w1 w2"), ("none", None)], "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(q, [rng.choice([*words, "absent"]) for _ in range(rng.randrange(0, 6))]) for q in range(11)] + [(50, ["w1", "w2"]), (51, ["absent"]), (52, [])], "query_id long, tokens array<string>")
    made = index.build_index(docs).stored()
    found = vectors.document_vectors(made)
    assert best(vectors.best_documents(asked, found, 3), 3) == best(index.token_scores(asked, made), 3)
    key = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in df.collect())
    assert key(vectors.documents_with_all(asked, found)) == key(index.token_scores(asked, made, require_all=True))
    assert vectors.best_documents(asked.limit(0), found, 3).count() == 0


def test_only_the_best_leave_a_task(spark, data):
    found = vectors.best_documents(retrieval._items(spark, data), retrieval.stored_vectors(spark, data), 5)
    every = index.token_scores(retrieval._items(spark, data), retrieval.stored_index(spark, data))
    assert found.count() * 4 < every.count()


def test_stored_index_follows_its_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert retrieval.stored_index(spark, folder) is retrieval.stored_index(spark, folder)
    assert {r.term for r in retrieval.stored_index(spark, folder).terms.collect()} == {"one", "two"}
    spark.createDataFrame([(2, "three")], "doc_id long, text string").write.mode("append").parquet(f"{folder}/documents.parquet")
    assert {r.term for r in retrieval.stored_vectors(spark, folder).terms.collect()} == {"one", "two", "three"}
