"""The pipeline's stages against the operators' own results on the same input."""

import corpus_pipeline
from quernstone.llm import decontamination, sentencepiece_codec
from quernstone.llm.common import stored


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stored(stage(spark, kept, data), "test")
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert kept.columns == docs.columns and after <= before and kept.count() == len(after), name
        assert len(after) > 0.7 * len(before), name
    assert not [r for r in kept.collect() if any(i in " ".join(r.text.split()).lower() for i in items)]
    assert decontamination.LatentIndex(docs, spark.read.parquet(f"{data}/benchmark.parquet")).matches(kept).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert {r.doc_id for r in last.collect()} == after
    import public_tokenizers

    want = sentencepiece_codec.piece_digests(kept, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_odd_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (None, "a text without an id", "en", "s", 20)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, data).count() <= rows.count()
