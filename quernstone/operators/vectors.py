"""Batches of queries against the documents' vectors: one pass, in which only the best documents of each task move.

A posting's share is what it adds to a score: its weight over the document's norm. A vector row holds a document's term numbers and
shares as arrays. A batch of queries is a matrix of terms by queries of stated size, which goes to every task; a task multiplies runs of
documents with it, and passes on those that are among the k best that it has seen so far for a query. So the shuffle is of k rows for
each query and task, however many documents have a frequent word, where a join with the postings moves all of them.

Everything within SLACK of the k-th best is passed on, so that ties after rounding fall as they would without pruning. For one query of few
words the look-up in the postings (index.token_scores) reads less."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.index import Index, weighted
from quernstone.operators.rank import number_all
from quernstone.operators.tables import small, stored

#: Cells of the matrices in a task, queries of a pass and their pairs of query and term at most, and what scores may differ by.
CELLS, QUERIES, PAIRS, SLACK = 8_000_000, 2_000, 500_000, 1e-6


@dataclass
class Vectors:
    """rows(doc_id, ids, shares) and terms(term, id); ids ascend within a row."""

    rows: DataFrame
    terms: DataFrame


def document_vectors(index: Index) -> Vectors:
    """The vectors of an index's documents, stored; documents without any term have none."""
    terms = stored(number_all(index.terms.select("term"), ["term"], "id"))
    known = index.terms.select("term", "idf").join(terms, "term")
    postings = index.frequencies.join(small(known, 1_000_000), "term").select("doc_id", F.struct("id", ((1 + F.log("tf")) * F.col("idf")).alias("weight")).alias("x"))
    rows = postings.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x")).join(index.norms, "doc_id")
    return Vectors(stored(rows.select("doc_id", F.col("x.id").alias("ids"), F.transform("x.weight", lambda w: w / F.col("norm")).alias("shares"))), terms)


class _Best:
    """The k best scores of each query so far."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)

    def among(self, found: np.ndarray) -> np.ndarray:
        """Which of the documents (rows) may be among the best of the queries (columns), those that came before included."""
        k = self.scores.shape[1]
        together = np.concatenate([self.scores, found.T], axis=1)
        self.scores = np.partition(together, together.shape[1] - k, axis=1)[:, -k:]
        return (found > 0) & (found >= self.scores.min(axis=1) - SLACK)


def _pass(vectors: Vectors, pairs: list[tuple], k: int | None, query_kind: str) -> DataFrame:
    """(query_id, doc_id, score) for one batch of pairs (query_id, term id, terms of the query); k: None for all documents with every term."""
    queries = sorted({q for q, _, _ in pairs})
    ids = np.array(sorted({i for _, i, _ in pairs}), np.int64)
    at = {q: j for j, q in enumerate(queries)}
    n = np.zeros(len(queries), np.int64)
    places = np.array([(np.searchsorted(ids, i), at[q]) for q, i, _ in pairs]).reshape(-1, 2)
    for q, _, size in pairs:
        n[at[q]] = size
    shared = vectors.rows.sparkSession.sparkContext.broadcast((queries, ids, places, n))
    doc_kind = vectors.rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, places, n = shared.value
        asked = np.zeros((len(ids), len(queries)))
        asked[places[:, 0], places[:, 1]] = 1
        best = _Best(len(queries), k) if k else None
        run = max(1, CELLS // max(1, len(ids), len(queries)))
        for batch in batches:
            for a in range(0, batch.num_rows, run):
                part = batch.slice(a, run)
                rows = np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy()))
                terms, shares = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                slot = np.searchsorted(ids, terms)
                known = (slot < len(ids)) & (ids[np.minimum(slot, len(ids) - 1)] == terms)
                matrix = np.zeros((part.num_rows, len(ids)))
                matrix[rows[known], slot[known]] = shares[known]
                scores = matrix @ asked
                keep = best.among(scores) if best else ((matrix > 0) @ asked == n)
                doc, query = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array([queries[j] for j in query], pa.from_numpy_dtype(np.int64) if query_kind == "bigint" else None), part.column(0).take(pa.array(doc)), pa.array(scores[doc, query])], ["query_id", "doc_id", "score"])

    return vectors.rows.select("doc_id", "ids", "shares").mapInArrow(find, f"query_id {query_kind}, doc_id {doc_kind}, score double")


def _batches(queries: DataFrame, vectors: Vectors) -> Iterator[list[tuple]]:
    """Pairs (query_id, term id, terms of the query), PAIRS and QUERIES at most at a time, a query's own together. Terms that no document has don't come,
    but count. The batch of queries is what a session asks at once; it passes through the driver in parts of that size."""
    asked = queries.select("query_id", F.array_distinct("tokens").alias("tokens")).select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    held: list[tuple] = []
    seen = 0
    for row in asked.join(vectors.terms, "term").select("query_id", "id", "n").orderBy("query_id").toLocalIterator():
        if held and row["query_id"] != held[-1][0]:
            seen += 1
            if seen >= QUERIES or len(held) >= PAIRS:
                yield held
                held, seen = [], 0
        held.append(tuple(row))
    if held:
        yield held


def _found(queries: DataFrame, vectors: Vectors, k: int | None) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    passes = [_pass(vectors, pairs, k, kind) for pairs in _batches(queries, vectors)]
    empty = queries.select("query_id").limit(0).join(vectors.rows.select("doc_id").limit(0), F.lit(True)).withColumn("score", F.lit(0.0))
    return reduce(DataFrame.unionByName, passes) if passes else empty


def best_documents(queries: DataFrame, vectors: Vectors, k: int) -> DataFrame:
    """(query_id, doc_id, score) for queries(query_id, tokens): the k best documents of each are among the rows, with their whole scores."""
    return _found(queries, vectors, k)


def documents_with_all(queries: DataFrame, vectors: Vectors) -> DataFrame:
    """(query_id, doc_id, score) of every document that has all terms of a query."""
    return _found(queries, vectors, None)
