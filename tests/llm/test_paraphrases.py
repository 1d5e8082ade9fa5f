"""Paraphrases of benchmark items, and the bounds that decide which candidates are looked at."""

import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import decontamination as D
from quernstone.llm.common import table


def _paraphrase(item, share, corpus, rng):
    """The item with its last quarter kept, and so many of its other words replaced that the share of all is left."""
    words = item.split()
    free = list(range(len(words) - max(1, len(words) // 4)))
    for i in rng.sample(free, min(len(free), int(len(words) * (1 - share)))):
        words[i] = rng.choice(corpus)
    return words


def _is_paraphrase(item, words):
    """The operator's own thresholds, on words of which none is weighed."""
    a, b = (D.word_hashes(" ".join(x)).view(np.int64).tolist() for x in (item.split(), words))
    return len(a) <= D.PASSAGE and D.common_subsequence(a, b) >= D.PARAPHRASE * len(a)


def test_paraphrases_at_any_place_are_found(spark, data):
    rng = random.Random(5)
    items = {r.item_id: r.text for r in table(spark, data, "benchmark").collect()}
    docs = table(spark, data, "documents").select("doc_id", "text").where(F.col("text").isNotNull()).collect()
    corpus = [w for r in docs for w in r.text.split()]
    made, want = [(r.doc_id, r.text) for r in docs], set()
    for share in (0.5, 0.6, 0.7):
        for item, text in items.items():
            for _ in range(6):
                words = _paraphrase(text, share, corpus, rng)
                if not _is_paraphrase(text, words):
                    continue
                around = [rng.choice(corpus) for _ in range(400)]
                at = rng.randrange(400)
                want.add((1_000_000 + len(made), item))
                made.append((1_000_000 + len(made), " ".join(around[:at] + words + around[at:])))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    original = frame.where("doc_id < 1000000")
    index = D.LatentIndex(original, table(spark, data, "benchmark"))
    found = {(r.doc_id, r.item_id) for r in index.matches(frame).collect()}
    assert len(want) > 100 and not want - found
    assert not {i for i, _ in want} & {r.doc_id for r in index.keep_clean(frame).collect()}


def test_bounds_lose_nothing(monkeypatch):
    """What is found is what exact checks of every candidate find, whatever the lengths and however words repeat."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    for trial in range(6):
        words = [[rng.choice(vocabulary[: rng.choice((20, 300))]) for _ in range(rng.randrange(1, D.PASSAGE + 1))] for _ in range(40)]
        hashes = [D.word_hashes(" ".join(w)) for w in words]
        texts = [None, "", "w1"]
        for w in words * 3:
            kept = [x if rng.random() < rng.choice((0.5, 0.7, 0.9)) else rng.choice(vocabulary) for x in w]
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(60)) + kept + rng.choices(vocabulary, k=rng.randrange(60))))
        known = np.unique(np.concatenate(hashes))
        terms = np.unique(D.terms_of(known, known))
        weights, row_of = np.zeros(D.TERMS, np.float32), np.full(D.TERMS, -1, np.int32)
        weights[terms] = np.random.default_rng(trial).uniform(0.1, 3, len(terms))
        row_of[terms] = np.arange(len(terms))
        basis = np.eye(len(terms), dtype=np.float32)
        vectors = np.zeros((len(words), len(terms)), np.float32)
        for i, h in enumerate(hashes):
            at, x = D._weighed(D.terms_of(h, known), weights, row_of)
            vectors[i, at] = x
        lists = [h.view(np.int64).tolist() for h in hashes]
        telling = [set(x[-max(1, len(x) // 4) :] if i % 4 else x) for i, x in enumerate(lists)]
        index = {"items": list(range(40)), "words": lists, "telling": telling, "vectors": vectors, "basis": basis, "vocabulary": known, "weights": weights, "row_of": row_of, **D._bounds(lists, telling)}
        with monkeypatch.context() as m:
            m.setattr(D, "may_match", lambda flat, low, high, begin, k, index: np.ones(len(k), bool))
            want = D.search(texts, index)
        assert len(want) > 20 and sorted(D.search(texts, index)) == sorted(want)
        with monkeypatch.context() as m:
            m.setattr(D, "TILE", 1_000)
            again = D.search(texts, index)
        assert [x[:3] for x in sorted(again)] == [x[:3] for x in sorted(want)]


def test_ids_of_any_type(spark, data):
    items = table(spark, data, "benchmark").selectExpr("concat('item ', item_id) AS item_id", "text", "1 AS id", "2 AS at")
    docs = items.limit(5).selectExpr("concat('doc ', item_id) AS doc_id", "concat('before ', text, ' after') AS text", "3 AS id", "4 AS share")
    found = {(r.doc_id, r.item_id) for r in D.LatentIndex(docs, items).matches(docs).collect()}
    assert {(f"doc {r.item_id}", r.item_id) for r in items.limit(5).collect()} <= found
    assert D.LatentIndex(docs, items).keep_clean(docs).count() == 0
