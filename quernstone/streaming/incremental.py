"""Documents that keep arriving: term counts, and the postings of the index, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.index import term_frequencies


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 1) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_postings(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's postings to a table of files, each batch to its own folder: one that is tried again after a failure
    replaces its own postings. Weights come from a batch job over the table, as document frequencies change with every batch."""

    def write(batch: DataFrame, number: int) -> None:
        term_frequencies(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_frequencies(documents: DataFrame) -> DataFrame:
    """The running count of documents for each term, as a stream in complete or update mode."""
    return term_frequencies(documents).groupBy("term").count()
