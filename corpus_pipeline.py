"""Preparing a corpus in five stages: toxic and unidentifiable documents go, of each group of near copies one document
stays, documents that hold benchmark items go, and what is left is encoded and decoded again.

Every stage is a function of (spark, docs, sf_dir) that works on all documents its predecessor kept; all but the last return
the columns of documents. SQL can't express a trained stage, so ORACLE_SQL is None.

Defined results
  null and empty texts have no letter, and go in the second stage; before it they are scored like any other text.
  null ids: their documents are in no training split, and each stays in the third stage. Of equal rows one stays there.
  a further column of any name stays up to the last stage. Very long texts are worked on whole.
  empty tables: no documents give no rows; without labels nothing is toxic, without a benchmark nothing goes for it, and
  without any language to learn every document goes in the second stage.
  ties: a score of exactly 0.5 is toxic; of near copies the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, jaccard_join, language_id, sentencepiece_codec, toxicity
from quernstone.llm.common import fresh, remainder, stored, table

ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches and those of the Parquet reader have 1,000 rows at most, unless the session asks for fewer: texts of 10,000 rows (4,096 in
    the reader), in the JVM and in Python at once, are what an executor's memory is short of. The settings hold on in the session."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > 1_000:
            spark.conf.set(key, 1_000)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    _small_batches(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out=remainder(F.col("id"), 5) == 0)
    (score,) = fresh(docs, "_score")
    return model.with_toxicity(docs, out=score).where(F.col(score) < 0.5).drop(score)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or are too far from every language."""
    _small_batches(spark)
    return language_id.keep_known(docs, language_id.fit_languages(docs.where(~language_id.held_out(F.col("doc_id")))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths or more of their five-word shingles, or are linked through others, the one with the least id stays."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or a paraphrase of one, go."""
    _small_batches(spark)
    return decontamination.LatentIndex(docs, table(spark, sf_dir, "benchmark")).keep_clean(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    import public_tokenizers

    _small_batches(spark)
    return sentencepiece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("language ID", drop_unidentified), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
