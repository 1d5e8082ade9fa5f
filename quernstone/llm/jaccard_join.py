"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct word shingles as 64-bit hashes. Documents with equal sets are one class, and only
classes are compared. Two classes can be alike at a share t only if they share a token among the first
n - ceil(t * n) + 1 of either, under every global order of the tokens. Three orders are used: rarest first, and
two by hash. The first gives the candidates by an equi-join; they are joined with the prefixes under the other two, which have to
meet as well, and only then with the sets that are compared in full.

Rarest first needs document frequencies. Most tokens occur in one class alone, so classes are thinned out first: a class with
more such tokens than a partner could lack has no partner. The first thinning counts a fixed share of the
tokens (those with the least hashes, and all tokens of short sets), the second counts all tokens of what is left.

The links of a class need not be listed to know its component: each class is first compared with one pivot, the class that
leads most of its prefix tokens' posting lists, and then only classes that share a prefix token and aren't
connected yet are compared. So a group of many near copies costs as many comparisons as it has members. all_links
lists every link instead.

Defined results
  null or empty text, or one without words: an empty set, linked with nothing, its own component.
  fewer words than a shingle has: the whole sequence is the one shingle.
  repeated rows and equal texts: linked with each other. A null id: a row of its class like any other; the component is
  the smallest id that isn't null, or null where there is none.
  an empty table gives an empty result. Columns besides the id and the text aren't read, whatever their names.
  ids may be of any type that has an order; classes of ids that aren't whole numbers are told apart by 63 bits of their sets' hashes.
  very long texts: whole; a text's shingles are held at once (8 bytes each, a few times over).
  ties: sizes are compared in whole numbers, so 100 * intersection = percent * union is a link; of equally frequent tokens the lesser hash comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType

from quernstone.llm.common import PLAIN, append_columns, components, fresh, hashed_words, mixed, slices, stored, table

WORDS, PERCENT = 4, 85
#: Sets up to SHORT tokens have all their tokens counted in the first thinning, others those whose hash is below SHARE.
SHORT, SHARE = 64, 0.25
_MIX, _SEEDS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; A-Z count as a-z."""
    hashes, sizes = hashed_words([(x or "").encode("utf-8", "replace").translate(PLAIN) for x in texts])
    out = []
    for h in np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else ():
        k = min(words, len(h))
        x = np.full(len(h) - k + 1 if k else 0, np.uint64(k))
        for i in range(k):
            x = x * _MIX + h[i : len(h) - k + 1 + i]
        out.append(np.unique(mixed(x)))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64)))


def needed(n: Column, percent: int) -> Column:
    """How many tokens of a set of n a partner has at least."""
    return F.ceil(n * percent / 100).cast("int")


def sketches(docs: DataFrame, words: int, percent: int, share: float) -> DataFrame:
    """(id, n, digest, known, sure) for every row: set size, digest of the set, and the tokens of the first thinning, of
    which the first `sure` are told by every partner as well."""
    below, every = np.uint64(int(share * 2**64) - 1), SHORT * 100 // percent + 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                n, digest, known, sure = [], [], [], []
                for x in shingle_sets(texts, words):
                    low = int(np.searchsorted(x, below, "right"))
                    n.append(len(x))
                    digest.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    known.append(x if len(x) <= every else x[:low])
                    sure.append(len(x) if len(x) <= SHORT else low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), _lists(known), pa.array(sure, pa.int32())], ["id", "n", "digest", "known", "sure"])

    return docs.mapInArrow(sketch, f"id {docs.schema['id'].dataType.simpleString()}, n int, digest binary, known array<long>, sure int")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, digest, tokens) for (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                found = shingle_sets(texts, words)
                digest = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), digest, _lists(found)], ["id", "digest", "tokens"])

    return docs.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, tokens array<long>")


def _repeated(tokens: DataFrame) -> DataFrame:
    """(token, df) of the tokens that more than one class has; counted before they are shuffled, so no token is hot."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


def _candidates_with_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, rest, prefix) of the classes that keep enough shared tokens; rest: how many those are; prefix: the first of them, rarest first."""
    tokens = sets.select("key", F.explode("tokens").alias("token"))
    shared = tokens.join(_repeated(tokens), "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    n = F.col("n")
    alive = sets.select("key", "n").join(shared, "key").where(F.size("shared") >= needed(n, percent))
    # the tokens of one class alone come first in the order and take up the head of the prefix
    left = n - needed(n, percent) + 1 - (n - F.size("shared"))
    return alive.select("key", "n", F.size("shared").alias("rest"), F.transform(F.slice("shared", F.lit(1), left), lambda s: s["token"]).alias("prefix"))


def _heads(sets: DataFrame, percent: int) -> DataFrame:
    """(key, first, second): the prefixes of each class under the two hash orders, some n - ceil(t * n) + 1 tokens each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            tokens = np.split(batch.column(1).flatten().to_numpy().view(np.uint64), np.cumsum(n)[:-1]) if len(n) else []
            sides = []
            for seed in _SEEDS:
                order = [mixed(x ^ seed) for x in tokens]
                sides.append([np.sort(np.partition(m, p - 1)[:p]) if (p := len(m) - -(-percent * len(m) // 100) + 1) < len(m) else np.sort(m) for m in order])
            if len(n):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(_lists, sides)], ["key", "first", "second"])

    return sets.select("key", "tokens").mapInArrow(cut, "key long, first array<long>, second array<long>")


def _met(pairs: DataFrame, sets: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): the pairs whose prefixes under both hash orders meet and whose sets are alike. The prefixes alone, some 30 % of
    the sets at a share of 85 %, move for all pairs; whole sets move for those that are left."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size = [], [], []
            sides = [(c.value_lengths().to_numpy(zero_copy_only=False), c.flatten().to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            ends = [np.cumsum(n) for n, _ in sides]
            ka, kb = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(ka)):
                x, y = (v[e[i] - n[i] : e[i]] for (n, v), e in zip(sides, ends, strict=True))
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(ka[i])
                    b.append(kb[i])
                    size.append(both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int32())], ["a", "b", "shared"])

    head = lambda k: heads.select(F.col("key").alias(k), F.col("first").alias(f"first_{k}"), F.col("second").alias(f"second_{k}"))
    near = pairs.join(head("a"), "a").join(head("b"), "b").where(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("second_a", "second_b"))
    near = stored(near.select("a", "b"), "near")
    left, right = (sets.select(F.col("key").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "ab")
    full = near.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    return full.mapInArrow(compare, "a long, b long, shared int")


def _possible(n_a: Column, n_b: Column, rest_a: Column, rest_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be alike if they share no token before the places at which so many are left of them."""
    most = F.least(rest_a, rest_b)
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & (100 * most >= percent * (n_a + n_b - most))


def _bounded(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (some tens of MB), else as it is: then the join shuffles."""
    return F.broadcast(df) if rows <= most else df


class JaccardJoin:
    """The join of one table of documents with itself."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, share: float = SHARE):
        self.percent, self.words = percent, words
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.rows = stored(sketches(self.docs, words, percent, share), "sketches")
        # a class is named by its least id; where ids repeat with other texts, or are null, by a hash of its set
        classes = self.rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"))
        first = F.row_number().over(Window.partitionBy("least").orderBy("digest")) == 1
        hashed = -F.abs(F.xxhash64("digest")) - 1
        whole = isinstance(self.docs.schema["id"].dataType, IntegralType)
        key = F.when(F.col("least").isNotNull() & first, F.col("least").cast("long")).otherwise(hashed) if whole else hashed
        self.classes = stored(classes.select("digest", "least", "n", "size", key.alias("key")), "classes")
        self.sets = stored(self._thinned(), "sets")
        self.prefixes = stored(_candidates_with_prefixes(self.sets, percent), "prefixes")
        self.heads = stored(_heads(self.sets, percent), "heads")

    def _thinned(self) -> DataFrame:
        """(key, n, tokens) of the classes that the first thinning leaves."""
        named = self.classes.select("digest", F.col("least").alias("id"), "key")
        few = _bounded(named, named.count())
        one = self.rows.alias("r").join(few.alias("c"), F.expr("r.digest = c.digest AND r.id <=> c.id")).select("key", "n", "sure", "known")
        tokens = one.select("key", "sure", F.posexplode("known").alias("at", "token"))
        own = tokens.where("at < sure").select("key", "token").join(_repeated(tokens.select("token")), "token", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
        n = F.col("n")
        alive = one.select("key", "n", "sure").distinct().join(own, "key", "left").where(F.col("sure") - F.coalesce("shared", F.lit(0)) <= n - needed(n, self.percent))
        alive = stored(self.classes.select("digest", F.col("least").alias("id"), "key", "n").join(alive.select("key"), "key", "left_semi"), "alive")
        few = _bounded(alive, alive.count())
        texts = self.docs.alias("d").join(few.select("id").distinct().alias("a"), F.expr("d.id <=> a.id"), "left_semi")
        full = full_sets(texts, self.words)
        return full.alias("s").join(few.alias("a"), F.expr("s.digest = a.digest AND s.id <=> a.id")).select("a.key", "a.n", "s.tokens").dropDuplicates(["key"])

    def _index(self) -> DataFrame:
        """(token, key, n, rest) of every prefix token; rest: the tokens from this place on that others share."""
        placed = self.prefixes.select("key", "n", "rest", F.posexplode("prefix").alias("at", "token"))
        return placed.select("token", "key", "n", (F.col("rest") - F.col("at")).alias("rest"))

    def all_links(self) -> DataFrame:
        """(a, b, shared) for every two linked classes, a < b."""
        left, right = (self._index().select("token", F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("rest").alias(f"rest_{k}")) for k in "ab")
        possible = _possible(F.col("n_a"), F.col("n_b"), F.col("rest_a"), F.col("rest_b"), self.percent)
        pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & possible).select("a", "b").distinct()
        return _met(pairs, self.sets, self.heads, self.percent)

    def _pivot_pairs(self) -> DataFrame:
        index = self._index()
        pivots = index.groupBy("token").agg(F.min(F.struct("key", "n", "rest")).alias("p")).select("token", F.col("p.key").alias("pivot"), F.col("p.n").alias("m"), F.col("p.rest").alias("left"))
        possible = _possible(F.col("n"), F.col("m"), F.col("rest"), F.col("left"), self.percent)
        chosen = index.join(pivots, "token").where((F.col("pivot") != F.col("key")) & possible).groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("times"))
        return chosen.groupBy("key").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot")).select(F.col("key").alias("a"), F.col("pivot").alias("b"))

    def _cross_pairs(self, found: DataFrame) -> DataFrame:
        """Pairs that share a prefix token and that the components found so far keep apart. Whole groups are compared
        by their bounds first, and their members only where those allow a link."""
        index = stored(self._index().join(found.withColumnRenamed("node", "key"), "key", "left").select("token", F.coalesce("component", "key").alias("group"), "key", "n", "rest"), "index")
        groups = index.groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
        groups = groups.join(groups.groupBy("token").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("token"), "token", "left_semi")
        ga, gb = (groups.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("group", "low", "high", "rest")]) for k in "ab")
        c = {x: F.col(x) for x in ("low_a", "high_a", "rest_a", "low_b", "high_b", "rest_b", "n", "rest", "n_a", "rest_of_a")}
        two = ga.join(gb, "token").where((F.col("group_a") < F.col("group_b")) & self._bounds(c["low_a"], c["high_a"], c["rest_a"], c["low_b"], c["high_b"], c["rest_b"]))
        member = lambda k: index.select("token", F.col("group").alias(f"group_{k}"), F.col("key").alias(k), "n", "rest")
        half = two.join(member("a"), ["token", "group_a"]).where(self._bounds(c["n"], c["n"], c["rest"], c["low_b"], c["high_b"], c["rest_b"]))
        half = half.select("token", "group_b", "a", F.col("n").alias("n_a"), F.col("rest").alias("rest_of_a"))
        pairs = half.join(member("b"), ["token", "group_b"]).where(_possible(c["n_a"], c["n"], c["rest_of_a"], c["rest"], self.percent))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _bounds(self, low_a: Column, high_a: Column, rest_a: Column, low_b: Column, high_b: Column, rest_b: Column) -> Column:
        """_possible for some sizes within these ranges."""
        most = F.least(rest_a, rest_b)
        return (100 * high_a >= self.percent * low_b) & (100 * high_b >= self.percent * low_a) & (100 * most >= self.percent * (low_a + low_b - most))

    def components(self) -> DataFrame:
        """(id, n_shingles, component_id) for every row."""
        links = stored(_met(self._pivot_pairs(), self.sets, self.heads, self.percent).select("a", "b"), "links")
        found = components(links)
        cross = _met(self._cross_pairs(found), self.sets, self.heads, self.percent).select("a", "b")
        more = stored(cross, "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        named = self.classes.join(found.withColumnRenamed("node", "key"), "key", "left").select("digest", "least", F.coalesce("component", "key").alias("component"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select("digest", "component_id")
        out = self.rows.where("n > 0").join(named, "digest").select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        # rows without words have no digest, and would all meet on one key
        return out.unionByName(self.rows.where("n = 0").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id")))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs."""
    return JaccardJoin(docs, id_col=id_col, text_col=text_col, words=words, percent=percent).components().withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that aren't alike an earlier one's: of each component the row with the least id. Of several rows with that id
    and equal sets one stays, the first by a hash of all its columns. Rows with an empty set, or a null id, stay."""
    mark, digest, order, place = fresh(docs, "_component", "_digest", "_order", "_place")
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    found = found.select(F.col(id_col).alias(mark), "n_shingles", "component_id")
    heads = found.where((F.col(mark) == F.col("component_id")) & (F.col("n_shingles") > 0)).select(mark)
    empty = found.where("n_shingles = 0 OR component_id IS NULL").select(mark)
    keep = heads.unionByName(empty).distinct()
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep[mark]), "left_semi")
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias(mark)).where(F.col(mark) > 1).where(F.col(id_col).isNotNull()).isEmpty():
        return kept

    def digests(texts: list[str | None]) -> list[pa.Array]:
        sets = shingle_sets(texts, words)
        return [pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())]

    kept = append_columns(kept, text_col, digests, [(digest, BinaryType())]).withColumn(order, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    first = F.row_number().over(Window.partitionBy(id_col, digest).orderBy(order))
    return kept.withColumn(place, first).where((F.col(place) == 1) | F.col(digest).isNull() | F.col(id_col).isNull()).drop(digest, order, place)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s
  FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = s.doc_id), s.doc_id)) AS component_id FROM sets s
""",
}
