"""What a Python worker holds at once, and what the pipeline's stages start on the executors."""

import tracemalloc

import numpy as np
from pyspark import SparkContext

import corpus_pipeline
from quernstone.llm import common, language_id
from quernstone.llm import decontamination as D


def peak_mb(work):
    work()  # what is kept for later calls isn't counted
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts_and_words():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 10)))) for _ in range(2_000)]
    return [" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(400)]


def index_of(texts, items):
    """An index of the first 40 words of some texts, in which every word is a term."""
    vocabulary = np.unique(np.concatenate(D.hashes_of(texts)))
    weights, row_of = np.zeros(D.TERMS, np.float32), np.full(D.TERMS, -1, np.int32)
    weights[: len(vocabulary)], row_of[: len(vocabulary)] = 1, np.arange(len(vocabulary))
    basis = np.random.default_rng(1).standard_normal((len(vocabulary), D.RANK)).astype(np.float32)
    words = [h[:40].view(np.int64).tolist() for h in D.hashes_of(texts[:items])]
    terms = [D._weighed(D.terms_of(np.array(w, np.int64).view(np.uint64), vocabulary), weights, row_of, whole=True) for w in words]
    vectors = np.stack([x @ basis[at] for at, x in terms])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    telling = [set(w[-10:]) for w in words]
    return {"words": words, "telling": telling, "vectors": vectors, "basis": basis, "vocabulary": vocabulary, "weights": weights, "row_of": row_of, **D._bounds(words, telling)}


def test_words_are_hashed_in_small_pieces(monkeypatch):
    texts = [t.encode() for t in texts_and_words()]
    assert peak_mb(lambda: common.hashed_words(texts)) < 16
    want = common.hashed_words(texts)
    monkeypatch.setattr(common, "PIECE", 5_000)
    common._powers.cache_clear()
    try:
        assert all(map(np.array_equal, common.hashed_words(texts), want))
    finally:
        common._powers.cache_clear()


def test_windows_are_folded_in_small_runs(monkeypatch):
    texts = texts_and_words()
    index = index_of(texts, 50)
    assert peak_mb(lambda: D.search(texts, index)) < 60
    want = D.search(texts, index)
    assert {(d, k) for d, k, *_ in want} >= {(i, i) for i in range(50)}
    for most in (1, 100, 10**9):
        monkeypatch.setattr(D, "FOLDED", most)
        assert D.search(texts, index) == want


def test_languages_start_no_rows_of_python(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *_, **__: 1 / 0)
    assert language_id.fit_languages(docs).languages == sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang is not None})


def test_small_batches(spark, data):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    for start, end in ((4_096, "1000"), (300, "300")):
        for key in keys:
            spark.conf.set(key, start)
        try:
            corpus_pipeline._small_batches(spark)
            assert [spark.conf.get(key) for key in keys] == [end, end]
        finally:
            for key in keys:
                spark.conf.unset(key)
