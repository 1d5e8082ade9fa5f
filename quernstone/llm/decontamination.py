"""Benchmark decontamination by latent semantic retrieval.

The items of a benchmark are cut into passages, weighed by TF-IDF (with document frequencies over all documents) and brought
into a latent space by a distributed randomised SVD. Every document is swept in overlapping windows, which are folded
into that space; a window that is near a passage by cosine is a candidate. A candidate counts if the longest common
subsequence of the passage's words and the words around the window is long, or if it is half the passage and
the passage's answer is there too: then it is a paraphrase.

Defined results
  null or empty text, or one without words: never contaminated. Items of that kind match nothing.
  repeated documents: each has its own rows; repeated items: each is matched. A null id is kept as it is.
  an empty table on either side gives no matches. Columns besides ids and texts aren't read by matches; keep_clean
  keeps all of them.
  ties: of several windows for one item the one with the greater share, then the earlier one.
  ids may be of any type. Columns besides ids and texts may have any name.
  very long texts: whole; their words are held at once, and cosines TILE at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType

from quernstone.llm.common import append_columns, fresh, hashed_words, slices, stored, table

#: Terms, and rank of the latent space at most: they bound the basis that is broadcast to TERMS * RANK * 4 bytes = 64 MB. Terms are the
#: words of the benchmark; those of a benchmark with more words than TERMS share terms evenly. No other word of a document counts.
TERMS, RANK, POWER_STEPS = 1 << 16, 256, 3
#: Words of a window are two blocks; a longer item is cut into passages of PASSAGE words, one every half.
BLOCK, PASSAGE, PASSAGES_AT_ONCE = 16, 64, 20_000
#: Cosines that are computed at once: windows times passages. Words that are folded into the latent space at once (RANK * 8 bytes each), and
#: bytes of text that keep_clean looks at at once.
TILE, FOLDED, CLEANED = 4_000_000, 8_192, 250_000
#: A term in more than this share of the documents doesn't count, unless an item has no other.
COMMON = 0.1
#: A candidate's cosine: the only gate before the bounds of may_match, which lose nothing.
COSINE = 0.4
#: Shares of the passage in common: it's the same beyond one, a paraphrase beyond the other if so much of the answer is there.
SAME, PARAPHRASE, ANSWER = 0.7, 0.5, 0.75
#: Places of the bitmaps of may_match, and how many of them, and of an answer's words, are looked at at once.
PLACES, BITMAPS_AT_ONCE, ANSWER_WORDS = 4096, 512, 32
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def hashes_of(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text in lower case; ASCII signs count as spaces."""
    words, n = hashed_words([x.lower().encode("utf-8", "replace").translate(_SPACES) if x else b"" for x in texts])
    return np.split(words, np.cumsum(n)[:-1]) if len(n) else []


def word_hashes(text: str | None) -> np.ndarray:
    return hashes_of([text])[0]


def terms_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The term of each word, or -1; vocabulary: the sorted hashes of the benchmark's words."""
    likely = np.zeros(1 << 16, bool)
    likely[vocabulary >> np.uint64(48)] = True
    out = np.full(len(hashes), -1, np.int64)
    some = np.flatnonzero(likely[hashes >> np.uint64(48)])
    at = np.searchsorted(vocabulary, hashes[some])
    at[at == len(vocabulary)] = 0
    out[some] = np.where(vocabulary[at] == hashes[some], at % TERMS, -1)
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the bits of a number standing for the places of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def cut(hashes: np.ndarray, size: int = PASSAGE) -> list[tuple[int, np.ndarray]]:
    """(first word, words) of the passages of an item."""
    if not len(hashes):
        return []
    starts = range(0, max(1, len(hashes) - size // 2), size // 2) if len(hashes) > size else [0]
    return [(s, hashes[s : s + size]) for s in starts]


def passages(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, at, words, answer) of every item's passages; answer: the item's last words, a quarter of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(text)
                end = h[-max(1, len(h) // 4) :].view(np.int64).tolist() if len(h) else []
                rows += [{"item_id": item, "at": s, "words": w.view(np.int64).tolist(), "answer": end} for s, w in cut(h)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", batch.schema.types[0]), ("at", pa.int32()), ("words", pa.list_(pa.int64())), ("answer", pa.list_(pa.int64()))]))

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {items.schema[id_col].dataType.simpleString()}, at int, words array<long>, answer array<long>")


def _wide(rows: pa.RecordBatch, column: int) -> list[np.ndarray]:
    lists = rows.column(column)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy().view(np.uint64), ends[:-1]) if len(ends) else []


class LatentIndex:
    """The latent space of a benchmark: term weights, a basis, and its passages as a table."""

    def __init__(self, docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rank: int = RANK):
        self.spark = docs.sparkSession
        self.passages = stored(passages(items, item_id_col, item_text_col), "passages")
        self.size = self.passages.count()
        if self.size:
            self._weigh(docs.select(text_col))
            # without documents no term has a weight, and nothing can be found
            self.size = self.size if len(self.terms) else 0
        if self.size:
            self._decompose(min(rank, self.size))

    def _weigh(self, docs: DataFrame) -> None:
        """Sets the weight of every term of the passages: 0 for other terms."""
        words = self.passages.select(F.explode("words").alias("w")).distinct().toArrow()  # the benchmark's words
        self.vocabulary = np.sort(words["w"].to_numpy().view(np.uint64))
        if not len(self.vocabulary):
            self.terms = np.empty(0, np.int64)
            return
        shared = self.spark.sparkContext.broadcast(self.vocabulary)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(TERMS, np.int64), 0
            for batch in batches:
                n += batch.num_rows
                for _, _, texts in slices(batch.column(0)):
                    hashes = hashes_of(texts)
                    t = terms_of(np.concatenate(hashes), shared.value)
                    own = np.unique((np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) * TERMS + t)[t >= 0]) % TERMS
                    found += np.bincount(own, minlength=TERMS)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, found[at]])], ["t", "n"])

        seen = {r["t"]: r["n"] for r in docs.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # TERMS at most
        n, df = seen.pop(-1, 0), np.zeros(TERMS)
        df[list(seen)] = list(seen.values())
        used = np.arange(TERMS) < len(self.vocabulary)
        idf = np.where(used, np.log1p(n / (df + 1)), 0).astype(np.float32)
        common = df > COMMON * n
        marks = self.spark.sparkContext.broadcast((self.vocabulary, common))

        def dull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, common = marks.value
            for batch in batches:
                terms = [np.unique(terms_of(h, vocabulary)) for h in _wide(batch, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *[t for t in terms if common[t].all()]]))], ["t"])

        kept = self.passages.select("words").mapInArrow(dull, "t long").distinct()
        common[[r["t"] for r in kept.collect()]] = False  # TERMS at most
        self.weights = np.where(common, 0, idf).astype(np.float32)
        self.terms = np.flatnonzero(self.weights)
        self.row_of = np.full(TERMS, -1, np.int32)
        self.row_of[self.terms] = np.arange(len(self.terms))

    def _products(self, basis: np.ndarray) -> np.ndarray:
        """A' A basis, A being the matrix of the passages' weights, in one pass over them."""
        shared = self.spark.sparkContext.broadcast((basis, self.vocabulary, self.weights, self.row_of))
        width = basis.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            basis, vocabulary, weights, row_of = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for h in _wide(batch, 0):
                    rows, w = _weighed(terms_of(h, vocabulary), weights, row_of)
                    total[rows] += np.outer(w, w @ basis[rows])
            at = np.flatnonzero(total.any(axis=1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(at % 64), pa.array(at), lists], ["block", "row", "values"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            rows, at = np.unique(frame["row"], return_inverse=True)
            total = np.zeros((len(rows), width))
            np.add.at(total, at, np.stack(frame["values"]))
            return pd.DataFrame({"row": rows, "values": list(total)})

        parts = self.passages.select("words").mapInArrow(multiply, "block long, row long, values array<double>")
        out = np.zeros_like(basis)
        for r in parts.groupBy("block").applyInPandas(add, "row long, values array<double>").toLocalIterator():
            out[r["row"]] = r["values"]
        return out

    def _decompose(self, rank: int) -> None:
        """Randomised subspace iteration: the basis of the latent space is bounded by TERMS and rank."""
        basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(self.terms), min(rank, len(self.terms)))))[0]
        for _ in range(POWER_STEPS):
            image = self._products(basis)
            basis = np.linalg.qr(image)[0]
        values, turn = np.linalg.eigh(basis.T @ self._products(basis))
        order = np.argsort(-values)
        self.basis = np.ascontiguousarray((basis @ turn[:, order[values[order] > 1e-9]]), np.float32)

    def _blocks(self) -> Iterator[dict]:
        """The passages with their latent vectors, in blocks of about PASSAGES_AT_ONCE, which bounds what is broadcast."""
        parts = -(-self.size // PASSAGES_AT_ONCE)
        for k in range(parts):
            rows = self.passages.where(F.pmod(F.xxhash64("item_id", "at"), F.lit(parts)) == k).orderBy("item_id", "at").collect()
            vectors, words = np.zeros((len(rows), self.basis.shape[1]), np.float32), [r["words"] for r in rows]
            for i, w in enumerate(words):
                at, x = _weighed(terms_of(np.array(w, np.int64).view(np.uint64), self.vocabulary), self.weights, self.row_of, whole=True)
                vectors[i] = x @ self.basis[at]
            length = np.linalg.norm(vectors, axis=1)
            vectors /= np.maximum(length[:, None], 1e-12)
            telling = []
            for r in rows:
                t = terms_of(np.array(r["answer"], np.int64).view(np.uint64), self.vocabulary)
                telling.append({x for x, k in zip(r["answer"], t, strict=True) if k < 0 or self.weights[k] > 0} or set(r["answer"]))
            yield {"items": [r["item_id"] for r in rows], "words": words, "telling": telling, "vectors": vectors, "basis": self.basis, "vocabulary": self.vocabulary, "weights": self.weights, "row_of": self.row_of, **_bounds(words, telling)}

    def matches(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, item_id, at, cosine, common, share): each document's items, with the first word of the best window, its
        cosine, and the length and share of the common subsequence."""
        read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        ids, items = (df.schema[c].dataType for df, c in ((read, "id"), (self.passages, "item_id")))
        kind = f"id {ids.simpleString()}, item_id {items.simpleString()}, at int, cosine float, common int, share double"
        types = [*map(to_arrow_type, (ids, items)), pa.int32(), pa.float32(), pa.int32(), pa.float64()]
        out = self.spark.createDataFrame([], kind)
        for block in self._blocks() if self.size else ():
            shared = self.spark.sparkContext.broadcast(block)

            def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids = batch.column(0).to_pylist()
                    for a, _, texts in slices(batch.column(1), 1_000_000):
                        found = search(texts, shared.value)
                        rows = [(ids[a + d], shared.value["items"][k], *rest) for d, k, *rest in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], ["id", "item_id", "at", "cosine", "common", "share"])

            out = out.unionByName(read.mapInArrow(find, kind))
        best = F.max_by(F.struct("at", "cosine", "common", "share"), F.struct("share", -F.col("at")))
        return out.groupBy(F.col("id").alias(id_col), "item_id").agg(best.alias("best")).select(id_col, "item_id", "best.*")

    def keep_clean(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """The rows of docs without any item, in one pass without a shuffle for each block of passages."""
        for block in self._blocks() if self.size else ():
            shared = self.spark.sparkContext.broadcast(block)
            (mark,) = fresh(docs, "_leak")

            def leaks(texts: list[str | None], shared=shared) -> list[pa.Array]:
                out = np.zeros(len(texts), bool)
                out[[x[0] for x in search(texts, shared.value)]] = True
                return [pa.array(out)]

            docs = append_columns(docs, text_col, leaks, [(mark, BooleanType())], CLEANED).where(~F.col(mark)).drop(mark)
        return docs


def _weighed(terms: np.ndarray, weights: np.ndarray, row_of: np.ndarray, *, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the basis and TF-IDF weights of a passage's terms, of length 1 unless whole."""
    t, n = np.unique(terms, return_counts=True)
    keep = weights[t] > 0
    w = weights[t[keep]] * n[keep]
    return row_of[t[keep]], w if whole else w / max(float(np.linalg.norm(w)), 1e-12)


def _places(lists: list[list[int]], width: int) -> np.ndarray:
    """Places of the first words of each list in a bitmap; the place after the last, which is never set, fills up."""
    out = np.full((len(lists), width), PLACES, np.int32)
    for i, x in enumerate(lists):
        out[i, : len(x)] = [y & PLACES - 1 for y in x[:width]]
    return out


def _bounds(words: list[list[int]], telling: list[set[int]]) -> dict:
    """What may_match needs of the passages: lengths, numbers of telling words, and the places of both in a bitmap."""
    size, n = np.array([len(w) for w in words]), np.array([len(t) for t in telling])
    return {"size": size, "n_telling": n, "word_places": _places(words, max(size, default=0)), "telling_places": _places([sorted(t) for t in telling], ANSWER_WORDS)}


def may_match(flat: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, k: np.ndarray, index: dict) -> np.ndarray:
    """Which candidates can still match: passage k around the window that begins at a place of flat, in a text from low to high.

    The common subsequence has no more words than the passage has that occur around the window, and no more of the
    answer is there than occurs. Words are looked up in bitmaps of their hashes, and lengths are rounded up to blocks, so
    both counts can come out too large but never too small: what is left out fails the exact checks of search.
    """
    out = np.zeros(len(k), bool)
    size = index["size"][k]
    reach = -(-size // BLOCK) * BLOCK
    area, which = np.unique(begin * (PASSAGE + BLOCK) + reach, return_inverse=True)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(0, len(area) + BITMAPS_AT_ONCE, BITMAPS_AT_ONCE))
    for part in range(len(cuts) - 1):
        some = order[cuts[part] : cuts[part + 1]]
        row = which[some] - part * BITMAPS_AT_ONCE
        _, one = np.unique(row, return_index=True)
        one = some[one]
        a, b = np.maximum(low[one], begin[one] - reach[one]), np.minimum(high[one], begin[one] + 2 * BLOCK + reach[one])
        n = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        seen = np.zeros((len(one), PLACES + 1), bool)
        seen[np.repeat(np.arange(len(one)), n), (flat[at] & np.uint64(PLACES - 1)).astype(np.int64)] = True
        share = np.count_nonzero(seen[row[:, None], index["word_places"][k[some]]], axis=1) / size[some]
        fit = share >= PARAPHRASE
        some, row, share = some[fit], row[fit], share[fit]
        n = index["n_telling"][k[some]]
        answer = np.count_nonzero(seen[row[:, None], index["telling_places"][k[some]]], axis=1) + np.maximum(n - ANSWER_WORDS, 0)
        out[some] = (share >= SAME) | (answer >= ANSWER * n)
    return out


def search(texts: list[str | None], index: dict) -> list[tuple[int, int, int, float, int, float]]:
    """(text, passage, first word of the window, cosine, common words, share) of all passages found in the texts."""
    hashes = hashes_of(texts)
    length = np.array([len(h) for h in hashes])
    blocks = -(-length // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    start = np.r_[0, np.cumsum(length)]
    term = terms_of(flat, index["vocabulary"])
    row = np.where(term >= 0, index["row_of"][term], -1)
    hit = np.flatnonzero(row >= 0)
    if not len(hit):
        return []
    doc = np.searchsorted(start, hit, "right") - 1
    block = first[doc] + (hit - start[doc]) // BLOCK
    named, at = np.unique(block, return_index=True)
    weight = index["weights"][term[hit]]
    sums = np.empty((len(at), index["basis"].shape[1]), np.float32)
    ends = np.r_[at[1:], len(hit)]
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, at[a] + FOLDED, "right")))
        some = slice(at[a], ends[b - 1])
        sums[a:b] = np.add.reduceat(index["basis"][row[hit[some]]] * weight[some, None], at[a:b] - at[a], axis=0)
        a = b
    # a window is a block, and the next one if that is of the same text and has terms as well
    windows = sums
    follows = np.flatnonzero((np.diff(named) == 1) & (np.searchsorted(first, named[1:], "right") == np.searchsorted(first, named[:-1], "right")))
    windows[follows] += sums[follows + 1]
    norm = np.sqrt(np.einsum("ij,ij->i", windows, windows))
    some = np.flatnonzero(norm > 0)
    found = []
    step = max(1, TILE // max(len(some), 1))
    for first_passage in range(0, len(index["vectors"]), step):
        along = windows[some] @ index["vectors"][first_passage : first_passage + step].T
        w, k = np.nonzero(along >= COSINE * norm[some, None])
        found.append((w, k + first_passage, along[w, k]))
    w, k, along = map(np.concatenate, zip(*found, strict=True))
    best: dict[tuple[int, int], tuple[float, int, float, int]] = {}
    places = named[some[w]]
    d = np.searchsorted(first, places, "right") - 1
    left = may_match(flat, start[d], start[d + 1], start[d] + (places - first[d]) * BLOCK, k, index)
    w, k, places = w[left], k[left], places[left]
    cosine = along[left] / norm[some[w]]
    for i in np.lexsort((-cosine, places)):
        d = int(np.searchsorted(first, places[i], "right")) - 1
        pair, words = (d, int(k[i])), index["words"][k[i]]
        if pair in best and best[pair][0] == 1.0:
            continue
        begin = int(places[i] - first[d]) * BLOCK
        around = hashes[d][max(0, begin - len(words)) : begin + 2 * BLOCK + len(words)].view(np.int64).tolist()
        common = common_subsequence(words, around)
        share = common / len(words)
        if share < SAME:
            if share < PARAPHRASE:
                continue
            telling = index["telling"][k[i]]
            if len(telling & set(around)) < ANSWER * len(telling):
                continue
        if pair not in best or share > best[pair][0]:
            best[pair] = (share, common, float(cosine[i]), begin)
    return [(d, k, begin, cos, common, share) for (d, k), (share, common, cos, begin) in best.items()]


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, at, cosine, common, share) of the documents that hold an item of the benchmark."""
    docs = table(spark, sf_dir, "documents")
    return LatentIndex(docs, table(spark, sf_dir, "benchmark")).matches(docs)


QUERIES = {"op2_decontamination": op2_decontamination}
SQL: dict[str, str] = {}
