"""Removes every byte that lies in a string of `length` bytes that starts anywhere else as well.

Every start of such a string has an anchor: the gram of bytes in its window whose hash is least (the last one, of equal ones). Equal
windows have equal grams as anchors, so only texts around a gram that occurs twice are looked at; consecutive starts with one
anchor are one context, some 70 starts. Contexts are counted before texts move: where all contexts of a gram are the same, they
are repeated as a whole. Where they differ, one text of each kind of context is fetched, and the contexts of a gram meet in a task, which
builds the suffix array of a few million bytes of them in two stages: suffixes that are smaller than their successors are sorted
directly, the others follow by a scan of the buckets of first bytes, from the least to the greatest. Windows that share `length`
bytes with a neighbour in the array, by the common prefixes of adjacent suffixes, are repeated.

A gram with over CROWD kinds of contexts (a common line, with other text around it each time) isn't gathered in one task: each
start of its contexts gives a 128-bit digest of its window, and digests are counted.

Defined results
  null and empty texts: nothing to remove. Texts shorter than `length` lose nothing. Texts of any length are worked on in pieces that
  overlap by a window. Bytes are those of UTF-8; a removed run may cut a character. Equal rows are copies of each other. Rows are told
  apart by 128 bits of their id and text; ids may be of any type, null or repeated. Further columns stay out. An empty table
  gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import fresh, mixed, slices, stored, table
from quernstone.llm.ordering import small

LENGTH = 200
#: Kinds of contexts of one gram that are gathered in one task; about 300 bytes each.
CROWD = 4000
#: Bytes of contexts in one suffix array, at least, and starts of a text in one piece.
ARRAY, PIECE = 2_000_000, 500_000
_PLACE = (1 << 20) - 1  # places in a run of pieces, whose bytes are fewer
_BYTES = np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)
_RATIO = 0x9E3779B97F4A7C13


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PLACE + 1, np.uint64(pow(_RATIO, -1 if inverse else 1, 1 << 64)))])


def gram_of(length: int) -> int:
    """Bytes of a gram: long enough to be rare, short enough for few anchors."""
    return max(1, length * 8 // 25)


def anchors(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, first start, starts, hash of the anchor's gram, hash of the context) of every context of a run of pieces, each of
    `length` bytes at least, 1,048,575 bytes in all at most."""
    gram, flat = gram_of(length), np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(x) for x in pieces])
    ends = np.cumsum(lengths)
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[flat] * _powers(False)[: len(flat)], dtype=np.uint64)]
    hashed = mixed((total[gram:] - total[:-gram]) * _powers(True)[: len(flat) - gram + 1])
    width = length - gram + 1
    key = (hashed & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(hashed), dtype=np.uint64))
    rows = np.pad(key, (0, -len(key) % width), constant_values=~np.uint64(0)).reshape(-1, width)
    before, after = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: len(key) - width + 1], before[width - 1 : len(key)])
    chosen = (np.uint64(_PLACE) - (least & np.uint64(_PLACE))).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(chosen)) + length <= np.repeat(ends, lengths)[: len(chosen)])
    chosen = chosen[starts]
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    count = np.diff(np.r_[first, len(chosen)])
    start, anchor = starts[first], chosen[first]
    end = start + count + length - 1
    context = mixed((total[end] - total[start]) * _powers(True)[start]) ^ mixed(((anchor - start) << 20 | count).astype(np.uint64))
    piece = np.searchsorted(ends, start, "right")
    return piece, start - (ends - lengths)[piece], count, hashed[anchor].view(np.int64), context.view(np.int64)


def runs_of_pieces(texts: list[str | None], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Pieces of texts, and (text, offset) of each, a run at a time."""
    at, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        data = (text or "").encode()
        for a in range(0, len(data) - length + 1, PIECE):
            at.append((k, a))
            pieces.append(data[a : a + PIECE + length - 1])
            held += len(pieces[-1])
            if held >= PIECE:
                yield at, pieces
                at, pieces, held = [], [], 0
    if pieces:
        yield at, pieces


def suffix_array(data: bytes, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, the 8 bytes at each place as a number) of texts that are joined with a zero byte after each, at
    the places `ends`. Suffixes that agree in `depth` bytes are in any order. An end is less than every byte."""
    n = len(data)
    padded = np.frombuffer(data + bytes(depth + 8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + depth].copy().view(">u8").ravel().astype(np.uint64)
    symbols = padded[:n].astype(np.int16) + 1
    symbols[ends] = 0
    rises = np.diff(symbols, append=np.int16(300))
    turns = np.flatnonzero(rises)
    smaller = (rises > 0)[turns[np.searchsorted(turns, np.arange(n))]]  # than the successor: by the next place where symbols change
    # first stage: these are sorted by 8 bytes at a time, and what is alone in its class is done
    direct = np.flatnonzero(smaller & (symbols > 0))
    direct = direct[np.argsort(words[direct], kind="stable")]
    head = np.r_[True, np.diff(words[direct]) != 0] if len(direct) else np.empty(0, bool)
    for d in range(8, depth, 8):
        cls = np.cumsum(head)
        alone = head & np.r_[head[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at, c = direct[open_], cls[open_]
        w = words[at + d]
        order = np.lexsort((w, c))
        direct[open_] = at[order]
        w, c = w[order], c[order]
        head[open_] = np.r_[True, (np.diff(c) != 0) | (np.diff(w) != 0)]
    # second stage: a greater suffix comes in its bucket in the order of its successors
    bounds = np.searchsorted(symbols[direct], np.arange(258))
    follow: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        own = np.concatenate(follow[c]) if follow[c] else np.empty(0, np.int64)
        parts = [own]
        while len(own):  # runs of one symbol
            own = own[own > 0] - 1
            own = own[~smaller[own] & (symbols[own] == c)]
            parts.append(own)
        parts.append(direct[bounds[c] : bounds[c + 1]] if c else ends)
        bucket = np.concatenate(parts)
        follow[c] = []
        out.append(bucket)
        prev = bucket[bucket > 0] - 1
        prev = prev[~smaller[prev] & (symbols[prev] > c)]
        if len(prev):
            s = symbols[prev]
            order = np.argsort(s, kind="stable")
            prev, s = prev[order], s[order]
            cuts = np.flatnonzero(np.diff(s)) + 1
            for part in np.split(prev, cuts):
                follow[symbols[part[0]]].append(part)
    return np.concatenate(out), words


def repeated_starts(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text, whether each of its first `starts` windows is that of another start as well."""
    sizes = np.array([len(x) + 1 for x in texts])
    ends = np.cumsum(sizes) - 1
    array, words = suffix_array(b"\0".join([*texts, b""]), ends, length)
    wanted = np.zeros(int(sizes.sum()), bool)
    begin = ends + 1 - sizes
    for a, n in zip(begin, starts):
        wanted[a : a + n] = True
    array = array[wanted[array]]
    low, high = array[:-1], array[1:]
    common = np.arange(len(low))  # neighbours whose common prefix goes on
    for d in [*range(0, length - 8, 8), length - 8]:
        common = common[words[low[common] + d] == words[high[common] + d]]
    found = np.zeros(len(wanted), bool)
    found[low[common]] = found[high[common]] = True
    return [found[a : a + n] for a, n in zip(begin, starts)]


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes that the windows at ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = "array<struct<a:int,b:int>>"


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(r1, r2, spans) of the rows(r1, r2, text) that have windows of `length` bytes (8 or more) that start elsewhere as well: spans are runs of bytes
    that these cover, which may overlap."""
    if length < 8:
        raise ValueError("windows have 8 bytes or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            for a, _, texts in slices(batch.column(2)):
                for at, pieces in runs_of_pieces(texts, length):
                    piece, start, count, gram, context = anchors(pieces, length)
                    text, offset = np.array(at)[piece].T
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, context, keys[0][a + text], keys[1][a + text], (start + offset).astype(np.int32), count.astype(np.int32))], ["gram", "context", "r1", "r2", "start", "starts"])

    long_ones = rows.where(F.octet_length("text") >= length)
    contexts = stored(long_ones.select("r1", "r2", "text").mapInArrow(find, "gram long, context long, r1 long, r2 long, start int, starts int"), "contexts")
    again = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    again = stored(again.select("gram", (F.col("low") != F.col("high")).alias("differ")), "grams")  # else their partitions are the join's, and a hot gram's isn't split
    found = stored(contexts.join(again, "gram"), "repeated")
    whole = found.where("NOT differ").select("r1", "r2", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("starts") + length - 1).alias("b"))).alias("spans"))

    differ = found.where("differ")
    kinds = stored(differ.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "start", "starts")).alias("at")), "kinds")
    crowds = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > crowd).select("gram", F.lit(True).alias("crowded"))
    wanted = kinds.join(small(crowds), "gram", "left").select(F.col("at.r1").alias("r1"), F.col("at.r2").alias("r2"), F.struct("at.start", "at.starts", "gram", "context", "n", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("x"))
    fetched = long_ones.select("r1", "r2", "text").join(wanted.groupBy("r1", "r2").agg(F.collect_list("x").alias("xs")), ["r1", "r2"]).select("text", "xs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "n", "starts", "crowded", "piece"]
        for batch in batches:
            for a, b, texts in slices(batch.column(0)):
                out: list = []
                for text, xs in zip(texts, batch.column(1).slice(a, b - a).to_pylist()):
                    data = text.encode()
                    for x in xs:
                        piece = data[x["start"] : x["start"] + x["starts"] + length - 1]
                        if x["crowded"]:
                            piece = b"".join(xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(x["starts"]))
                        out.append((*[x[c] for c in names[:5]], piece))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names)

    pieces = stored(fetched.mapInArrow(cut, "gram long, context long, n long, starts int, crowded boolean, piece binary"), "pieces")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judged() -> pa.RecordBatch:
            marks = repeated_starts([x[4] for x in held], [x[3] for x in held], length)
            spans = [[(0, n + length - 1)] if k > 1 else covered(np.flatnonzero(m), length) for (_, _, k, n, _), m in zip(held, marks)]
            rows = [(g, c, [{"a": a, "b": b} for a, b in s]) for (g, c, *_), s in zip(held, spans) if s]
            columns = list(zip(*rows)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], ["gram", "context", "spans"])

        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        size = 0
        for _, group in groupby(rows, lambda row: row[0]):
            own = [next(same) for _, same in groupby(group, lambda row: row[1])]  # of equal rows each gave the same piece
            held += own
            size += sum(len(row[4]) for row in own)
            if size >= ARRAY:
                yield judged()
                held, size = [], 0
        if held:
            yield judged()

    sorted_ = pieces.where("NOT crowded").select("gram", "context", "n", "starts", "piece").repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(sort, f"gram long, context long, spans {_SPANS}")
    windows = pieces.where("crowded").dropDuplicates(["gram", "context"]).select("gram", "context", "n", F.posexplode(F.expr("transform(sequence(0, starts - 1), i -> substring(piece, i * 16 + 1, 16))")).alias("at", "digest"))
    often = windows.groupBy("digest").agg(F.sum("n").alias("k")).where("k > 1").select("digest")
    counted = windows.join(often, "digest").groupBy("gram", "context").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b"))).alias("spans"))
    judged = differ.join(sorted_.unionByName(counted), ["gram", "context"]).select("r1", "r2", F.expr("transform(spans, x -> struct(x.a + start AS a, x.b + start AS b))").alias("spans"))
    return whole.unionByName(judged).groupBy("r1", "r2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, removed, kept): the runs of bytes that go, as array<struct<a,b>>, and the bytes that stay, of every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = [F.col(id_col).cast("string"), F.col(text_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(*own).alias("r1"), F.xxhash64(F.lit(7), *own).alias("r2"))
    joined = rows.join(repeated_spans(rows, length, crowd), ["r1", "r2"], "left").select("id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                sizes, gone, kept = [], [], []
                for text, spans in zip(texts, batch.column(2).slice(a, b - a).to_pylist()):
                    data = text.encode()
                    runs = merged([(x["a"], x["b"]) for x in spans or []])
                    edges = [0, *[e for run in runs for e in run], len(data)]
                    sizes.append(len(data))
                    gone.append([{"a": x, "b": y} for x, y in runs])
                    kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(remove, f"id {kind}, n_bytes long, removed {_SPANS}, kept binary").withColumnRenamed("id", id_col)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
SQL = {
    "op12_suffix_dedup": """WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
s AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
m AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s)),
runs AS (SELECT r, span, min(i) AS a, max(i) + 199 AS z FROM m GROUP BY r, span),
kept AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS from_, a - 1 AS to_ FROM (SELECT r, a, z FROM runs UNION ALL SELECT r, octet_length(b) + 1, NULL FROM d)),
texts AS (SELECT d.r, string_agg(CASE WHEN to_ >= from_ THEN hex(b[from_:to_]) ELSE '' END, '' ORDER BY a) AS x FROM d JOIN kept USING (r) GROUP BY d.r)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(octet_length(b) - length(x) // 2 AS BIGINT) AS n_removed, (SELECT count(*) FROM runs WHERE runs.r = d.r) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN texts USING (r)"""
}
