"""An inverted index as tables: postings(term, doc_id, tf, weight), terms(term, df, idf), norms(doc_id, norm).

Term frequencies are counted within each row, so the first shuffle is that of document frequencies, summed before it moves.
A stored index has its postings in order of terms, the longest lists cut over several files: a look-up reads the row groups
that its terms are in. A saved one is bucketed by term, for joins with many terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import term_counts, tokens
from quernstone.operators.tables import stored

#: Terms of a batch of queries up to which postings are filtered by a list of them; and rows of (term, idf) that are broadcast at most.
LISTED, BROADCAST_TERMS = 10_000, 1_000_000


def term_frequencies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.explode(term_counts(tokens(text_col))).alias("t"))
    return counted.select("doc_id", "t.term", "t.tf")


def inverse_document_frequencies(frequencies: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + n / (1 + df))."""
    return frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log1p(F.lit(max(documents, 1)) / (1 + F.col("df"))))


@dataclass
class Index:
    frequencies: DataFrame
    terms: DataFrame
    norms: DataFrame
    documents: int

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, weight)."""
        return weighted(self.frequencies, self.terms)

    def stored(self) -> Index:
        """The same tables, written to the shared folder: frequencies once, in order of terms, and what is made of them."""
        rows = stored(self.frequencies)
        ordered = stored(rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        terms = stored(inverse_document_frequencies(ordered, self.documents))
        return Index(ordered, terms, stored(document_norms(rows, terms)), self.documents)

    def save(self, prefix: str, buckets: int = 64) -> None:
        """Writes the tables prefix_frequencies, prefix_terms and prefix_norms, the first two bucketed by term."""
        for name, key in (("frequencies", "term"), ("terms", "term"), ("norms", "doc_id")):
            getattr(self, name).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")

    @staticmethod
    def load(spark: SparkSession, prefix: str) -> Index:
        """A saved index. Documents without any term aren't counted."""
        frequencies, terms, norms = (spark.table(f"{prefix}_{name}") for name in ("frequencies", "terms", "norms"))
        return Index(frequencies, terms, norms, norms.count())


def weighted(frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    return frequencies.join(terms.select("term", "idf"), "term").select("term", "doc_id", "tf", ((1 + F.log("tf")) * F.col("idf")).alias("weight"))


def document_norms(frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, norm). Up to BROADCAST_TERMS terms go to the frequencies, and then only sums move; beyond, both are shuffled by term."""
    known = terms.select("term", "idf")
    known = F.broadcast(known) if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else known
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return weighted(frequencies, known).groupBy("doc_id").agg(length.alias("norm")).withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    frequencies, n = term_frequencies(docs, id_col=id_col, text_col=text_col), docs.count()
    terms = inverse_document_frequencies(frequencies, n)
    norms = weighted(frequencies, terms).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return Index(frequencies, terms, norms.withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)), n)


def token_scores(queries: DataFrame, index: Index, *, require_all: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of a batch of queries (query_id, tokens): the sum of weights over the document's norm.

    require_all: only documents that have every term of the query. The terms of the batch, up to LISTED of them, filter the
    frequencies where they are read, before anything is joined."""
    wanted = queries.select("query_id", F.array_distinct("tokens").alias("tokens")).select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    names = [r["term"] for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
    rows, terms = index.frequencies, index.terms
    if len(names) <= LISTED:
        rows, terms = rows.where(F.col("term").isin(names)), F.broadcast(terms.where(F.col("term").isin(names)))
        wanted = F.broadcast(wanted.withColumn("n", F.col("n"))) if wanted.limit(LISTED * 10 + 1).count() <= LISTED * 10 else wanted
    found = weighted(rows, terms).join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("terms"), F.first("n").alias("n"))
    if require_all:
        found = found.where(F.col("terms") == F.col("n"))
    return found.join(index.norms, "doc_id", "left").select("query_id", "doc_id", (F.col("total") / F.coalesce("norm", F.lit(1.0))).alias("score"))
