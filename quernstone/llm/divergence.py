"""How far the sources of each language are apart in the words that they use, and which words set a source off.

Terms are counted inside every task, in a table of bounded size, before anything is shuffled. The terms that are in enough of a
language's documents are numbered, and each group's counts are packed into one row for every CHUNK consecutive terms. Groups are
cut into blocks of BLOCK, and the pairs of groups into tiles of two blocks; a packed row is sent to every tile that its block is
a side of. A task takes a tile over SPAN chunks, one chunk after the other, and adds up the submatrix of its pairs, so that it
never holds more than one chunk of two blocks. Terms that no group of the tile has in a chunk differ by the groups' floor alone,
and are counted, not visited. A tile of many chunks is dealt to several tasks, whose sums are added.

All arithmetic is in whole numbers: p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)) is divided out in three steps of 1,000, which
stay within 64 bits for counts up to 9 * 10^15.

Defined results
  null and empty text: a document without terms; null language or source: the same as an empty one. A group without terms has
  its floor in every kept term, and a language without kept terms has pairs of value 0 and no terms.
  ties: ranks go by value, then by item in UTF-8 order. Repeated rows count each time. Very long texts are cut at a byte that is
  in no term, 1,000,000 bytes at a time. Further columns don't count. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import slices, stored, table
from quernstone.llm.ordering import numbered, small

SCALE = 1_000_000_000
BLOCK, CHUNK, SPAN = 32, 8192, 8
#: Terms of a task that are counted before they are passed on; some 200 bytes each.
HELD = 500_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1_000_000
#: Bytes of terms stay, A-Z as a-z; what is between terms becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    data, a = text.translate(_TERMS), 0
    while len(data) - a > PIECE:
        b = data.find(b" ", a + PIECE)
        if b < 0:
            break
        yield data[a:b].split()
        a = b
    yield data[a:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text): occurrences of a term in a group, and documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in groups.items():
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), pa.array(list(n), pa.binary()).cast(pa.string())]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([documents[term] for term in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for batch in batches:
            for a, b, texts in slices(batch.column(2)):
                for lang, source, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), texts):
                    if not text:
                        continue
                    occurrences, documents = groups[lang, source]
                    before, seen = len(occurrences), set()
                    for terms in _pieces(text.encode()):
                        occurrences.update(terms)
                        seen.update(terms)
                    documents.update(seen)
                    held += len(occurrences) - before
                    if held > HELD:
                        yield from rows()
                        held = 0
        yield from rows()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, size: str) -> Column:
    """1 + floor(10^9 * (n + 2) / size) of two columns."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20,0)) * {SCALE}) DIV {size}")


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / size) without leaving 64 bits."""
    whole, rest = np.divmod(counts + 2, sizes)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, sizes)
        whole = whole * 1000 + more
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


class Audit:
    """Counts of every group's kept terms, stored once; pairs() and terms() read them.

    docs(lang, source, text); a term is kept in a language if `least` of its documents have it. `block`, `chunk` and `span` set how
    the work is dealt out, and change no result."""

    def __init__(self, docs: DataFrame, *, least: int = 10, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN):
        self.block, self.chunk, self.span = block, chunk, span
        docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counts = stored(term_counts(docs), "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
        kept = stored(numbered(kept, "lang", ["term"], "id", "v"), "kept")
        self.counts = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept_counts")
        sizes = kept.groupBy("lang").agg(F.first("v").alias("v"), F.sum("lang_n").alias("lang_size"))
        groups = numbered(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).drop("n"), "lang", ["source"], "gid", "groups")
        groups = groups.join(self.counts.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["v", "size", "lang_size"])
        self.groups = stored(groups.withColumns({"size": F.col("size") + 2 * F.col("v"), "lang_size": F.col("lang_size") + 2 * F.col("v")}), "groups")

    def packed(self) -> DataFrame:
        """(lang, gid, size, groups, chunk, width, ids, ns): a row for each group and chunk, with the places in it and the counts of the
        group's terms there; both are empty where it has none."""
        at = self.counts.join(small(self.groups.select("lang", "source", "gid")), ["lang", "source"]).select("lang", "gid", F.floor(F.col("id") / self.chunk).alias("chunk"), F.struct((F.col("id") % self.chunk).cast("int").alias("id"), "n").alias("x"))
        rows = at.groupBy("lang", "gid", "chunk").agg(F.sort_array(F.collect_list("x")).alias("x"))
        chunks = F.greatest(F.ceil(F.col("v") / self.chunk), F.lit(1))
        all_chunks = self.groups.select("lang", "gid", "size", "groups", "v", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        width = F.least(F.lit(self.chunk), F.col("v") - F.col("chunk") * self.chunk).cast("int")
        return all_chunks.join(rows, ["lang", "gid", "chunk"], "left").select("lang", "gid", "size", "groups", "chunk", width.alias("width"), F.coalesce("x.id", F.array().cast("array<int>")).alias("ids"), F.coalesce("x.n", F.array().cast("array<long>")).alias("ns"))

    def pair_sums(self) -> DataFrame:
        """(lang, a, b, value) of every pair of groups of a language, a < b by number."""
        block, mine = self.block, F.floor(F.col("gid") / self.block)
        tiles = self.packed().withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / block))))
        keys = ["lang", "row", "col", "range", "chunk"]
        tiles = tiles.select("lang", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), F.floor(F.col("chunk") / self.span).alias("range"), "chunk", "gid", "size", "width", "ids", "ns")
        dealt = tiles.repartition(*keys[:4]).sortWithinPartitions(*keys, "gid")

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                plain = [batch.column(k).to_pylist() for k in range(8)]
                for i, row in enumerate(zip(*plain)):
                    yield row, batch.column(8)[i].values.to_numpy(), batch.column(9)[i].values.to_numpy()

        def submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (lang, row, col, _), tile in groupby(rows_of(batches), lambda x: x[0][:4]):
                total = None
                for _, chunk in groupby(tile, lambda x: x[0][4]):
                    rows = list(chunk)
                    gids = np.array([x[0][5] for x in rows])
                    if not rows[0][0][7]:
                        found = np.zeros((len(rows), len(rows)), np.int64)
                    else:
                        found = chunk_gaps(np.array([x[0][6] for x in rows]), rows[0][0][7], [x[1] for x in rows], [x[2] for x in rows], gids // block == row, gids // block == col)
                    total = found if total is None else total + found
                a, b = np.nonzero((gids[:, None] < gids) & (gids[:, None] // block == row) & (gids // block == col))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(gids[a]), pa.array(gids[b]), pa.array(total[a, b])], ["lang", "a", "b", "value"])

        return dealt.mapInArrow(submatrices, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """(lang, source, part, item, value, rank): every other source of its language, by value."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other"))))
        both = self.pair_sums().select("lang", "value", ends.alias("x")).select("lang", "x.*", "value")
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "gid").orderBy(F.desc("value"), "other")))
        names = small(self.groups.select("lang", "gid", "source"))
        named = ranked.join(names, ["lang", "gid"]).join(names.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    def terms(self, most: int = 10) -> DataFrame:
        """(lang, source, part, item, value, rank): the terms that a group has oftener than its language, by value, `most` of each."""
        rows = self.counts.join(small(self.groups.select("lang", "source", "size", "lang_size")), ["lang", "source"])
        rows = rows.select("lang", "source", F.col("term").alias("item"), share("n", "size").alias("p"), share("lang_n", "lang_size").alias("q")).where("p > q")
        valued = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) DIV (p + q)").alias("value"))
        return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def chunk_gaps(sizes: np.ndarray, width: int, ids: list[np.ndarray], ns: list[np.ndarray], above: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Sums of gaps over a chunk of `width` terms for groups of the row block (above) and of the column block (left)."""
    columns = np.unique(np.concatenate(ids))
    counts = np.zeros((len(ids), len(columns)), np.int64)
    for k, (x, n) in enumerate(zip(ids, ns)):
        counts[k, np.searchsorted(columns, x)] = n
    p, floors = shares(counts, sizes[:, None]), shares(np.zeros(len(sizes), np.int64), sizes)
    out = gap(floors[:, None], floors) * (width - len(columns))
    for i in np.flatnonzero(above):
        js = np.flatnonzero(left & (np.arange(len(left)) > i))
        out[i, js] += gap(p[i], p[js]).sum(axis=1)
    return out


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = Audit(table(spark, sf_dir, "documents"))
    return audit.pairs().unionByName(audit.terms())


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.size + 2 * v.v))::HUGEINT AS p FROM g JOIN s USING (lang, source) JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT kept.lang, kept.term, (1 + 1000000000::HUGEINT * (kept.n + 2) // (z.size + 2 * v.v))::HUGEINT AS q FROM kept JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS size FROM kept GROUP BY lang) z USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT m.lang, m.source, o.source AS item, sum((m.p - o.p) * (m.p - o.p) // (m.p + o.p))::BIGINT AS value FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10"""
}
