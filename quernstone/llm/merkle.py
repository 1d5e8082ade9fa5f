"""A Merkle manifest of a table: a digest for each row, a tree of digests for each group, and a proof for each row.

Parents are combined by key as their children come in: every task keeps partial parents, {place: digest} by (level, parent), and
a parent whose children are all there becomes a child of its own parent at once. How many children a parent waits for follows
from the size of the group alone (`fan`, or what is left at the end of a level). What a batch of rows can't complete is its
frontier, a few dozen nodes; frontiers are shuffled by stretches of leaves, each round 1,024 times as long, until every group
has its root. The children of a completed parent are the reverse links, which give each leaf its siblings up to the frontier; the
frontiers' own siblings are joined to it once. The groups' roots are the leaves of one more tree.

Defined results
  order: groups by name (null first, bytewise), leaves by id (null first). Rows of one id are in the order of their digests, so
  equal rows change nothing by changing places. A group of one row is its own root.
  null columns are `-` in a leaf; an empty text is `0:`. A null id is never tampered with. Further columns don't count.
  n_chars that can't be raised in 64 bits is raised as a decimal. An empty table gives no rows. Very long texts are only hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import remainder, stored, table
from quernstone.llm.ordering import numbered, small

#: Levels that a round of frontiers adds at most; the first one has twice as many.
STEP = 10


def hashed(*values: Column) -> Column:
    """H of the values: each `-` if null, else the length of its text in bytes, a colon, and the text."""
    written = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*written), 256)


@lru_cache(maxsize=4096)
def level_sizes(n: int, fan: int) -> tuple[int, ...]:
    """Nodes of each level of a tree over n leaves, up to its root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fan))
    return tuple(sizes)


class PartialParents:
    """Parents of one group that wait for children, and the links back from those that have them all."""

    def __init__(self, n: int, fan: int):
        self.sizes, self.fan = level_sizes(n, fan), fan
        self.waiting: dict[tuple[int, int], dict[int, bytes]] = {}
        self.complete: dict[tuple[int, int], tuple[bytes, list[bytes]]] = {}

    def offer(self, level: int, place: int, digest: bytes) -> None:
        """Takes a node, and goes on with each ancestor that is complete now."""
        while level < len(self.sizes) - 1:
            parent = place // self.fan
            met = self.waiting.setdefault((level, parent), {})
            met[place] = digest
            if len(met) < min(self.fan, self.sizes[level] - parent * self.fan):
                return
            children = [x for _, x in sorted(self.waiting.pop((level, parent)).items())]
            digest = parent_of(children)
            self.complete[level, parent] = digest, children
            level, place = level + 1, parent

    def path(self, level: int, place: int, digest: bytes) -> tuple[int, int, bytes, bytes]:
        """(level, place, digest) of the highest ancestor that is known, and the siblings on the way to it."""
        siblings: list[bytes] = []
        while found := self.complete.get((level, place // self.fan)):
            digest, children = found
            siblings += children[: place % self.fan] + children[place % self.fan + 1 :]
            level, place = level + 1, place // self.fan
        return level, place, digest, b"".join(siblings)


def parent_of(children: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in children).encode()).digest()


_UP = "up_level int, up_place long, up_digest binary, path binary"


def combined(nodes: DataFrame, fan: int, other: str) -> DataFrame:
    """nodes(grp, total, level, place, digest, and `other` columns, as DDL) with the highest ancestor that their own batch of rows
    completes, and the siblings on the way: one pass, in which batches need no order."""
    kept = [f.split(" ")[0] for f in other.split(", ") if f]
    names = ["grp", "total", "level", "place", "digest", *kept]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(k).to_pylist() for k in range(5)]))
            trees = {(g, n): PartialParents(n, fan) for g, n in {r[:2] for r in rows}}
            for g, n, *node in rows:
                trees[g, n].offer(*node)
            up = [trees[g, n].path(*node) for g, n, *node in rows]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*up) if up else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "up_level", "up_place", "up_digest", "path"])

    return nodes.select(*names).mapInArrow(combine, "grp string, total long, level int, place long, digest binary, " + (other + ", " if other else "") + _UP)


def frontier(nodes: DataFrame) -> DataFrame:
    """The highest known ancestors, each once."""
    return nodes.groupBy("grp", "total", F.col("up_level").alias("level"), F.col("up_place").alias("place"), F.col("up_digest").alias("digest")).agg(F.count(F.lit(1)).alias("below")).drop("below")


def paths_to_roots(leaves: DataFrame, fan: int = 2, other: str = "") -> DataFrame:
    """(grp, total, place, digest, other, root, path): path holds the siblings of each leaf, from its own run up to the root.

    leaves(grp, total, place, digest, other): places from 0 to total - 1 of each group, each once."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    height = len(level_sizes(most, fan)) - 1
    low = stored(combined(leaves.withColumn("level", F.lit(0)), fan, other), "nodes")
    rounds, reach = [], 0
    while not rounds or reach < height:
        reach = min(height, reach + (STEP if rounds else 2 * STEP))
        nodes = frontier(rounds[-1] if rounds else low)

        def combine(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            columns = [c.to_pylist() for c in group.select(["level", "place", "digest"]).columns]
            tree = PartialParents(group.column("total")[0].as_py(), fan)
            for node in zip(*columns):
                tree.offer(*node)
            up = list(zip(*[tree.path(*node) for node in zip(*columns)]))
            for name, values, kind in zip(("up_level", "up_place", "up_digest", "path"), up, (pa.int32(), pa.int64(), pa.binary(), pa.binary())):
                group = group.append_column(name, pa.array(list(values), kind))
            return group.drop_columns("stretch")

        # a stretch is as long as fan ** reach leaves: of a node of level k it is place // fan ** (reach - k)
        stretch = reduce(lambda c, k: F.when(F.col("level") == k, F.floor(F.col("place") / fan ** max(0, reach - k))).otherwise(c), range(height + 1), F.col("place"))
        rounds.append(stored(nodes.withColumn("stretch", stretch).groupBy("grp", "stretch").applyInArrow(combine, "grp string, total long, level int, place long, digest binary, " + _UP), "frontier"))
    above = rounds[-1].select("grp", "level", "place", F.col("up_digest").alias("root"), F.col("path").alias("above"))
    for lower in rounds[-2::-1]:
        on = above.select("grp", F.col("level").alias("up_level"), F.col("place").alias("up_place"), "root", "above")
        above = lower.join(on, ["grp", "up_level", "up_place"]).select("grp", "level", "place", "root", F.concat("path", "above").alias("above"))
    on = above.select("grp", F.col("level").alias("up_level"), F.col("place").alias("up_place"), "root", "above")
    kept = [f.split(" ")[0] for f in other.split(", ") if f]
    return low.join(on, ["grp", "up_level", "up_place"]).select("grp", "total", "place", "digest", *kept, "root", F.concat("path", "above").alias("path"))


def folded(path: bytes, place: int, total: int, digest: bytes, fan: int) -> tuple[bytes, int]:
    """The root that a leaf and its siblings give, and how many bytes of the path it took."""
    used = 0
    for size in level_sizes(total, fan)[:-1]:
        first = place // fan * fan
        count = min(fan, size - first) - 1
        run = [path[used + 32 * k : used + 32 * (k + 1)] for k in range(count)]
        run.insert(place - first, digest)
        digest, place, used = parent_of(run), place // fan, used + 32 * count
    return digest, used


def manifest(rows: DataFrame, leaf: Column, group: Column, claimed: Column | None = None, *, id_col: str = "doc_id", fan: int = 2) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: digests in hex. leaf, claimed: a row's digest in
    hex, as it was and as it is shown to be now (the same, if not given); folded_root is what the latter and the siblings give."""
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # null before all others
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    leaves = rows.select(named.alias("grp"), F.col(id_col).alias("id"), F.unhex(leaf).alias("digest"), F.unhex(leaf if claimed is None else claimed).alias("claimed"))
    leaves = numbered(stored(leaves, "leaves"), "grp", ["id", "digest"], "place", "total")
    trees = stored(paths_to_roots(leaves, fan, f"id {kind}, claimed binary"), "trees")
    roots = numbered(trees.groupBy("grp").agg(F.first("root").alias("digest")).select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", ["name"], "place", "total")
    top = paths_to_roots(roots.withColumnRenamed("all", "grp"), fan, "name string").select(F.col("name").alias("grp"), F.col("place").alias("grp_place"), F.col("total").alias("grps"), F.col("root").alias("top"), F.col("path").alias("grp_path"))
    out = trees.join(small(stored(top, "roots")), "grp").select("id", "digest", "claimed", "place", "total", "root", "path", "grp_place", "grps", "top", "grp_path")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, ends = [], []
            for claimed, place, total, path, grp_place, grps, grp_path in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 6, 7, 8, 10)]):
                proofs.append(sha256((path + grp_path).hex().encode()).hexdigest())
                ends.append(folded(grp_path, grp_place, grps, folded(path, place, total, claimed, fan)[0], fan)[0])
            hexes = [pa.array([x.hex() for x in batch.column(k).to_pylist()], pa.string()) for k in (1, 5, 9)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *hexes, pa.array(proofs, pa.string()), pa.array([x.hex() for x in ends], pa.string())], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    proved = out.mapInArrow(prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proved.withColumn("verified", F.col("root") == F.col("folded_root")).withColumnRenamed("id", id_col)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raised = F.when(remainder(F.col("doc_id"), 7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    leaf, claimed = (hashed(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), raised))
    return manifest(docs, leaf, F.col("lang"), claimed)


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
SQL = {
    "op13_merkle_manifest": """WITH RECURSIVE
bytes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT documents.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, bytes),
h AS (SELECT doc_id, lang, list_transform([n_chars, CASE WHEN hit THEN n_chars + 1 ELSE n_chars END], lambda n: sha256(
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || coalesce(strlen(text) || ':' || text, '-'))) AS two FROM d),
leaves AS MATERIALIZED (SELECT doc_id, lang, two[1] AS leaf, two[2] AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, two[1]) - 1 AS pos FROM h),
tree AS (SELECT lang, 0 AS lv, pos, leaf AS dig, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, any_value(lv) + 1, pos // 2, sha256(string_agg(dig, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY lang, pos // 2),
subs AS (SELECT lang, dig AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
tops AS (SELECT 0 AS lv, pos, subroot AS dig, (SELECT count(*) FROM subs) AS n FROM subs
  UNION ALL SELECT any_value(lv) + 1, pos // 2, sha256(string_agg(dig, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY pos // 2),
nodes AS (SELECT lang, lv, pos, dig, n FROM tree WHERE n > 1 UNION ALL SELECT s.lang, 1000 + t.lv, t.pos, t.dig, t.n FROM subs s, tops t WHERE t.n > 1),
steps AS (SELECT DISTINCT lang, lv FROM nodes),
ways AS (SELECT l.lang, l.pos, l.claimed, list({'sib': b.dig, 'r': ((CASE WHEN p.lv < 1000 THEN l.pos ELSE s.pos END >> (p.lv % 1000)) & 1) = 1} ORDER BY p.lv) FILTER (WHERE p.lv IS NOT NULL) AS way
  FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN steps p ON p.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lv = p.lv AND b.pos = xor(CASE WHEN p.lv < 1000 THEN l.pos ELSE s.pos END >> (p.lv % 1000), 1) GROUP BY ALL),
folds AS (SELECT lang, pos, sha256(coalesce(list_aggregate(list_transform(way, lambda w: coalesce(w.sib, '')), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_concat([{'sib': claimed, 'r': false}], coalesce(way, [])), lambda c, w: {'sib': sha256(CASE WHEN w.sib IS NULL THEN c.sib WHEN w.r THEN w.sib || c.sib ELSE c.sib || w.sib END), 'r': false}).sib AS folded_root FROM ways)
SELECT l.doc_id, l.leaf, s.subroot, t.dig AS root, f.proof_sha256, f.folded_root, f.folded_root = t.dig AS verified
FROM leaves l JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang, tops t WHERE t.n = 1"""
}
