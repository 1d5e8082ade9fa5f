"""The best documents of each entity for a batch of queries, in two passes over the texts instead of an index that only one batch would read.

The first pass counts in how many documents each term is. The second one, which has these counts, gives a task all it needs: a document's
norm and its share of every query. Terms are 64-bit digests made of the texts' bytes, so both passes are arithmetic on arrays, and what is
sent to tasks are two numbers for each term of more than one document; any other term of a document is in that one alone.

A result has one document of an entity at most, so a task passes on, for each query, documents that are the best so far of their group of
entities, if the group is among the k best so far. Everything within SLACK of these bounds is passed on, so that ties after rounding fall as
they would without pruning; of equal scores of an entity the first document is enough."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.tables import stored

#: Bytes of text that are worked on at once, cells of bounds in a task, queries of a pass, what scores may differ by, and terms that tasks are sent.
PIECE, CELLS, QUERIES, SLACK, TERMS = 1 << 18, 4_000_000, 2_000, 1e-6, 8_000_000

_WORD = b"abcdefghijklmnopqrstuvwxyz0123456789"
_CODES = np.zeros(256, np.uint64)
_CODES[list(_WORD)] = np.random.default_rng(7).integers(1, 1 << 63, len(_WORD), np.uint64)
_CODES[list(_WORD[:26].upper())] = _CODES[list(_WORD[:26])]
_OTHER = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BLOCK = re.compile("[一-鿿]+")


def _mixed(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ (sums >> np.uint64(31))) * _MIX
    return (sums ^ (sums >> np.uint64(29))).view(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE))


def term_digest(term: str) -> int:
    """The digest of one token, Latin or CJK."""
    data = np.frombuffer(term.encode(), np.uint8)
    codes = _CODES[data] if data.size and data[0] < 128 else _OTHER[data]
    return int(_mixed(np.array([(codes * _powers(len(data))).sum()], np.uint64))[0])


def _blocks(text: str, known: dict[str, int]) -> list[int]:
    """Digests of the characters and overlapping pairs of the CJK blocks."""
    found = []
    for block in _BLOCK.findall(text):
        for x in [*block, *(block[i : i + 2] for i in range(len(block) - 1))]:
            if x not in known:
                known[x] = term_digest(x)
            found.append(known[x])
    return found


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, offsets, bytes) of runs of texts; a text is never cut."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        raw = part.tobytes()
        if b"\xc4\xb0" in raw or b"\xe2\x84\xaa" in raw:  # the two letters beyond ASCII whose lower case is a Latin letter
            texts = [raw[i:j].decode().lower().encode() for i, j in zip(at[:-1], at[1:], strict=True)]
            part, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        yield a, b - a, at, part
        a = b


def _counted(rows: int, at: np.ndarray, data: np.ndarray, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, tf) of the distinct tokens of each row: what text.tokens gives."""
    codes = _CODES[data]
    inside = codes != 0
    start = inside.copy()
    fresh = np.zeros(len(data), bool)
    fresh[at[:-1][at[:-1] < len(data)]] = True
    start[1:] &= ~inside[:-1] | fresh[1:]
    where, first = np.flatnonzero(inside), np.flatnonzero(start)
    if len(first):
        begins = np.flatnonzero(start[where])
        place = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
        digests = _mixed(np.add.reduceat(codes[where] * _powers(int(place.max()) + 1)[place], begins))
    else:
        digests = np.empty(0, np.int64)
    row = np.searchsorted(at, first, "right") - 1
    if ((data >= 0xE4) & (data <= 0xE9)).any():
        more = [_blocks(data[i:j].tobytes().decode(), known) for i, j in zip(at[:-1], at[1:], strict=True)]
        row = np.concatenate([row, np.repeat(np.arange(rows), list(map(len, more)))])
        digests = np.concatenate([digests, np.array([x for m in more for x in m], np.int64)])
    if rows <= 1 << 14:  # one key sorts faster; digests of a row whose first 50 bits agree are told apart below
        order = np.argsort((row.astype(np.uint64) << np.uint64(50)) | (digests.view(np.uint64) >> np.uint64(14)))
    else:
        order = np.lexsort((digests, row))
    row, digests = row[order], digests[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digests[1:] != digests[:-1])
    runs = np.flatnonzero(new)
    return row[runs], digests[runs], np.diff(np.append(runs, len(row)))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(digest, df) of the terms of texts(text); null is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [_counted(rows, at, data, known)[1] for _, rows, at, data in _pieces(batch.column(0))]
            digests, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(n)], ["digest", "n"])

    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "digest long, n long")
    return counted.groupBy("digest").agg(F.sum("n").alias("df"))


class _Bounds:
    """The best score of each group and query so far, and the k-th best group of each query."""

    def __init__(self, queries: int, k: int):
        self.k, self.at, self.seen = k, {}, 0
        self.best = np.full((16, queries), -np.inf)
        self.least = np.full(queries, -np.inf)

    def keep(self, groups: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Which scores (a row for each document, a column for each query) may be in a result, those that came before included."""
        own, back = np.unique(groups, return_inverse=True)
        order = np.argsort(back, kind="stable")
        best = np.maximum.reduceat(scores[order], np.searchsorted(back[order], np.arange(len(own))), axis=0)
        for g in own.tolist():
            if g not in self.at and (len(self.at) + 1) * scores.shape[1] <= CELLS:
                self.at[g] = len(self.at)
        while len(self.best) < len(self.at):
            self.best = np.concatenate([self.best, np.full_like(self.best, -np.inf)])
        place = np.array([self.at.get(g, -1) for g in own.tolist()])
        held = place >= 0
        best[held] = np.maximum(best[held], self.best[place[held]])
        self.best[place[held]] = best[held]
        n = len(self.at)
        if n >= self.k and (n * scores.shape[1] <= CELLS // 16 or self.seen % 64 == 0):  # an older bound is a lower one
            self.least = np.maximum(self.least, np.partition(self.best[:n], n - self.k, axis=0)[n - self.k])
        self.seen += 1
        return (scores > 0) & (scores >= best[back] - SLACK) & (scores >= self.least - SLACK)


def _pass(docs: DataFrame, asked: list[tuple[object, list[str]]], terms: tuple[np.ndarray, np.ndarray], documents: int, k: int, query_kind: str) -> DataFrame:
    names = sorted({t for _, tokens in asked for t in tokens})
    digests = np.array([term_digest(t) for t in names], np.int64)
    order = np.argsort(digests)
    slot = {names[i]: s for s, i in enumerate(order)}
    pairs = sorted((slot[t], q) for q, (_, tokens) in enumerate(asked) for t in set(tokens))
    ends = np.searchsorted([s for s, _ in pairs], np.arange(len(names) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(([q for q, _ in asked], digests[order], ends, np.array([q for _, q in pairs], np.int64), *terms))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "entity")}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, ends, of_slot, held, df = shared.value
        bounds, known = _Bounds(len(queries), k), {}
        kind = pa.int64() if query_kind == "bigint" else pa.int32() if query_kind == "int" else None
        for batch in batches:
            ids, entities, groups = (batch.column(i) for i in range(3))
            for a, rows, at, data in _pieces(batch.column(3)):
                row, digest, tf = _counted(rows, at, data, known)
                place = np.minimum(np.searchsorted(held, digest), max(len(held) - 1, 0))
                n = np.where(held[place] == digest, df[place], 1) if len(held) else np.ones(len(digest))
                weight = (1 + np.log(tf)) * np.log1p(documents / (1 + n))
                norm = np.sqrt(np.bincount(row, weight * weight, rows))
                slot = np.minimum(np.searchsorted(wanted, digest), len(wanted) - 1)
                met = wanted[slot] == digest
                row, slot, weight = row[met], slot[met], weight[met]
                times = ends[slot + 1] - ends[slot]
                total = int(times.sum())
                if not total:
                    continue
                query = of_slot[np.arange(total) + np.repeat(ends[slot] - np.cumsum(times) + times, times)]
                near = max(1, CELLS // len(queries))
                for low in range(0, rows, near):  # one run, but for very short texts or many queries
                    span = min(near, rows - low)
                    i, j = np.searchsorted(row, [low, low + span])
                    b, e = int(times[:i].sum()), int(times[:j].sum())
                    cells = np.repeat(row[i:j] - low, times[i:j]) * len(queries) + query[b:e]
                    scores = np.bincount(cells, np.repeat(weight[i:j], times[i:j]), span * len(queries)).reshape(span, len(queries))
                    scores /= np.where(norm[low : low + span] > 0, norm[low : low + span], 1)[:, None]
                    here = slice(a + low, a + low + span)
                    keep = np.nonzero(bounds.keep(groups[here.start : here.stop].to_numpy(), scores))
                    first: dict[tuple, tuple] = {}
                    for r, q, s in zip(*map(np.ndarray.tolist, keep), scores[keep].tolist(), strict=True):
                        key = (q, entities[here.start + r].as_py(), round(s, 9))
                        found = (ids[here.start + r].as_py(), here.start + r, s)
                        if key not in first or found < first[key]:
                            first[key] = found
                    if first:
                        taken = pa.array([r for _, r, _ in first.values()], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([queries[q] for q, _, _ in first], kind), ids.take(taken), entities.take(taken), pa.array([s for _, _, s in first.values()], pa.float64())], ["query_id", "doc_id", "entity", "score"])

    return docs.select("doc_id", "entity", "group", "text").mapInArrow(find, f"query_id {query_kind}, doc_id {kinds['doc_id']}, entity {kinds['entity']}, score double")


def best_of_groups(queries: DataFrame, texts: DataFrame, docs: DataFrame, k: int) -> DataFrame | None:
    """(query_id, doc_id, entity, score) for queries(query_id, tokens): of the k best groups of each query the best documents of their entities
    are among the rows.

    texts(text) are all documents, which the frequencies are of; docs(doc_id, entity, group, text) are those that can be found. The queries pass
    through the driver. None, if more than TERMS terms are in two documents or more: then an index has to be made."""
    frequencies = stored(document_frequencies(texts).where("df > 1"))
    if frequencies.limit(TERMS + 1).count() > TERMS:
        return None
    held = frequencies.select("digest", F.col("df").cast("int").alias("df")).toArrow()
    digest, df = held.column("digest").to_numpy(), held.column("df").to_numpy()
    order = np.argsort(digest)
    asked = [(r["query_id"], r["tokens"]) for r in queries.select("query_id", "tokens").where("size(tokens) > 0").orderBy("query_id").collect()]
    kind = queries.schema["query_id"].dataType.simpleString()
    n = max(texts.count(), 1)
    passes = [_pass(docs, asked[a : a + QUERIES], (digest[order], df[order]), n, k, kind) for a in range(0, len(asked), QUERIES)]
    if not passes:
        return queries.select("query_id").limit(0).join(docs.select("doc_id", "entity").limit(0), F.lit(True)).withColumn("score", F.lit(0.0))
    return reduce(DataFrame.unionByName, passes)
