"""The batch search that passes over the texts, against the index of the same documents."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import index, phrases, scan, search
from quernstone.plans import fixtures as X

WORDS = "the hely blend a1 x 2024 naïve K0 İst straße 机器学习 自然 学 ab-cd Über".split(" ")


def _docs(n):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 40]))) for _ in range(n)] + ["", "the hely", "THE HELY", "the hely", "机", "---", None]
    return [(f"d{i:03d}", f"c/{'ab'[i % 2]}{i % 7}/{i}", t, i) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("piece", "cells", "queries"), [(1 << 20, 4_000_000, 2_000), (60, 40, 2), (200, 4_000_000, 3)])
def test_like_the_index(spark, monkeypatch, piece, cells, queries):
    """The best of each entity within the k best groups has the index's scores, with one piece or many, bounds or none, and more queries than a pass has."""
    for name, value in (("PIECE", piece), ("CELLS", cells), ("QUERIES", queries)):
        monkeypatch.setattr(scan, name, value)
    docs = spark.createDataFrame(_docs(150), X.DOC)
    asked = spark.createDataFrame([(1, ["the", "hely"]), (2, ["机器", "学", "na", "ve"]), (3, ["k0", "i", "st", "none"]), (4, ["nothing"]), (5, ["2024", "the", "the"]), (6, [])], "query_id long, tokens array<string>")
    whole = index.token_scores(asked, index.build_index(docs))
    of = docs.select("doc_id", (F.col("ord") % 14).alias("entity"), (F.col("ord") % 7).alias("group"), "text")
    scored = whole.join(of.select("doc_id", "entity", "group"), "doc_id")
    best = {}
    for r in scored.collect():
        at = best.setdefault(r.query_id, {}).setdefault(r.group, {})
        at[r.entity] = min(at.get(r.entity, (9, "")), (-round(r.score, 9), r.doc_id))
    want = {(q, e, d, -s) for q, groups in best.items() for g in sorted(groups, key=lambda g: min(groups[g].values()))[:3] for e, (s, d) in groups[g].items() if s == min(groups[g].values())[0]}
    rows = scan.best_of_groups(asked, docs.select("text"), of, 3).join(of.select("doc_id", "group"), "doc_id").collect()
    found = {(r.query_id, r.entity, r.doc_id, round(r.score, 9)) for r in rows}
    assert want <= found
    assert found <= {(r.query_id, r.entity, r.doc_id, round(r.score, 9)) for r in scored.collect()}


def test_terms_beyond_what_tasks_are_sent(spark, monkeypatch):
    monkeypatch.setattr(scan, "TERMS", 3)
    docs = spark.createDataFrame(_docs(20), X.DOC)
    assert scan.best_of_groups(spark.createDataFrame([(1, ["the"])], "query_id long, tokens array<string>"), docs.select("text"), docs.select("doc_id", F.col("ord").alias("entity"), F.col("ord").alias("group"), "text"), 3) is None
    run = search.Search(docs, spark.createDataFrame([(1, "a1"), (2, "b2")], "ord long, name string").select("*", *[F.lit("").alias(c) for c in ("department", "career", "url", "research_direction", "personal_intro", "papers_text")]))
    assert run.run(spark.createDataFrame([(1, "hely")], X.QUERY), relax=False).count() > 0


def test_batch_without_index(spark, monkeypatch):
    """A batch of queries is answered without an index, in either mode; copies of a document leave a task once, and only what is ranked gets a snippet."""
    monkeypatch.setattr(search, "build_index", lambda docs: pytest.fail("an index was made"))
    docs = spark.createDataFrame([(f"d{i:04d}", f"c/{'ab'[i % 2]}/{i}", "the hely blend" if i % 4 else "the", i) for i in range(2000)], X.DOC).coalesce(1)
    entities = spark.createDataFrame([(1, "a/"), (2, "b/")], "ord long, name string").select("*", *[F.lit("").alias(c) for c in ("department", "career", "url", "research_direction", "personal_intro", "papers_text")])
    made = search.Search(docs, entities)
    queries = spark.createDataFrame([(1, "hely blend"), (2, "the")], X.QUERY)
    assert made.by_tokens(search.with_plans(queries), 3).count() < 20
    rows = made.run(queries, relax=False, top_k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.name, r.doc_id, r.snippet) for r in rows] == [(1, 1, "a/", "d0002", "the hely blend"), (1, 2, "b/", "d0001", "the hely blend"), (2, 1, "a/", "d0000", "the"), (2, 2, "b/", "d0001", "the hely blend")]


def test_first_phrases_beside_their_texts(spark):
    docs = spark.createDataFrame(_docs(30), X.DOC)
    names = spark.createDataFrame([("a0", 5), ("a2", 3), ("b1/", 9), ("/1", 4), ("", 1), ("none", 2)], "needle string, place long")
    want = {tuple(r) for r in phrases.first_phrases(docs.select("doc_id", F.col("path").alias("hay")), names).collect()}
    for batch in (100, 1):
        assert {tuple(r) for r in phrases.with_first_phrase(docs.select("doc_id", "path", "text"), "path", names, "entity", batch=batch).select("doc_id", "entity").collect()} == want


def test_texts_are_normalised_alike_beside_the_automaton(spark):
    """All white space and letters of any case, as text.normalize_text has them; and phrases are counted in texts as they are."""
    texts = ["".join(map(chr, range(a, a + 256))) for a in range(0, 0x1F000, 256) if not 0xD800 <= a < 0xE000] + ["A B 　c", "ÀÉ x", "ΑΣ Σ", "İK", "", "a \t\r\n\x0b\x0c b", "x​y᠎z "]
    first = len(texts) - 7
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.hay for r in rows.select("doc_id", T.normalize_text("text").alias("hay")).orderBy("doc_id").collect()] == list(map(phrases.normalized, texts))
    many = spark.createDataFrame([(f"w{i}",) for i in range(100)] + [("abc",), ("àéx",), ("none",)], "needle string")
    for wanted in (many, many.where("needle NOT LIKE 'w%'")):
        assert {tuple(r) for r in phrases.counts_in_texts(rows.where(f"doc_id >= {first}"), wanted).collect()} == {(first, "abc", 1), (first + 1, "àéx", 1)}


def test_heads_of_phrases(monkeypatch):
    """No text that holds a phrase of any length is left out, wherever it stands and however texts are cut; others mostly are."""
    rng = random.Random(5)
    for run in (1 << 18, 7):
        monkeypatch.setattr(phrases._Heads, "RUN", run)
        for sizes in ((8, 15, 16, 17, 40), (2, 9, 30)):
            needles = ["".join(rng.choices("abcdé学", k=rng.choice(sizes))) for _ in range(12)]
            heads = phrases._Heads(needles)
            for x in needles:
                for before, after in (("", ""), ("ab" * 9, ""), ("", "é" * 20), ("学c" * 5, "d")):
                    assert heads.may(before + x + after)
    heads = phrases._Heads(["phrase of words", "another phrase of words"])
    assert not any(map(heads.may, ["", "abc", "phrasing of words", "another phrasing of words", "of words and more"]))
