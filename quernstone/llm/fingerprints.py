"""Order MinHash fingerprints, in DataFrame operations alone.

A text's k-mers are runs of three words. Each occurrence of a k-mer is numbered from 0, in text order, and the k-mer is hashed with
its number, so the occurrences of one k-mer are as many members of the set, in places of the order that have nothing to do with
each other. The leading bits of those hashes deal the members into 64 bins, each with an order of its own; in each bin the two
least members are selected, put back into text order, and their tuple is hashed. A bin's hash thus changes both when a minimal
k-mer is edited and when two of them change places. Likeness is the share of bins, of those that either text fills, with equal hashes.

Defined results
  null text: as empty. A text without words has the empty fingerprint; two of them are alike (1), one and another text
  are not (0). Texts of fewer than three words have one k-mer of all their words.
  equal texts have equal fingerprints; so have texts that differ in white space only.
  very long texts: whole. Places beyond 8,388,607 words count as one place, and the order of k-mers there isn't seen.
  repeated ids: ordered by text, and each row has the following row as its next document; rows that share an id are put in order
  by one task. Null ids come last. fingerprint_texts takes ids of any type; compare_with_next, which goes by their order, whole numbers.
  ties: members of one hash (40 bits) are in text order. An empty table gives an empty result; the columns besides the id and
  the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quernstone.llm.common import stored, table

PLACE_BITS, HASH_BITS, BIN_BITS = 23, 40, 6
_PLACES, _HASHES = (1 << PLACE_BITS) - 1, (1 << HASH_BITS) - 1
_BIN_SHIFT = PLACE_BITS + HASH_BITS - BIN_BITS


def _bin(x: Column) -> Column:
    return F.shiftright(x, _BIN_SHIFT)


def with_signature(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the column out: an array with bin * 2^32 + hash for each bin that has k-mers, in bin order."""
    words = F.transform(F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", words)
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1)))
    place = lambda i: F.least(i, F.lit(_PLACES)).cast("long")
    df = df.withColumn("_k", F.sort_array(F.transform(heads, lambda x, i: F.shiftleft(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(_HASHES)), PLACE_BITS).bitwiseOR(place(i))))).drop("_w")
    # sorted by hash and place, so the occurrences of a k-mer are a run in text order
    n = F.size("_k")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    other = lambda i: F.shiftright(F.get("_k", i), PLACE_BITS) != F.shiftright(F.get("_k", i - 1), PLACE_BITS)
    df = df.withColumn("_r", F.filter(places, lambda i: (i == 0) | other(i)))
    member = lambda x, number: F.shiftleft(F.xxhash64(F.shiftright(x, PLACE_BITS), number).bitwiseAND(F.lit(_HASHES)), PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit(_PLACES)))
    run = lambda start, k: F.transform(F.slice("_k", start + 1, F.coalesce(F.get("_r", k + 1), n) - start), member)
    df = df.withColumn("_k", F.sort_array(F.flatten(F.transform("_r", run)))).drop("_r")
    df = df.withColumn("_s", F.filter("_k", lambda x, i: (i < 2) | (_bin(F.get("_k", i - 2)) != _bin(x)))).drop("_k")

    def tuple_hash(x: Column, i: Column) -> Column:
        y = F.get("_s", i + 1)
        hx, hy = F.shiftright(x, PLACE_BITS), F.shiftright(y, PLACE_BITS)
        px, py = x.bitwiseAND(F.lit(_PLACES)), y.bitwiseAND(F.lit(_PLACES))
        both = F.when(px <= py, F.xxhash64(hx, hy)).otherwise(F.xxhash64(hy, hx))
        h = F.when(y.isNotNull() & (_bin(y) == _bin(x)), both).otherwise(F.xxhash64(hx))
        value = F.shiftleft(_bin(x), 32).bitwiseOR(h.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when((i == 0) | (_bin(F.get("_s", i - 1)) != _bin(x)), value)

    return df.withColumn(out, F.filter(F.transform("_s", tuple_hash), lambda v: v.isNotNull())).drop("_s")


def likeness(a: Column, b: Column) -> Column:
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda v: F.shiftright(v, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def fingerprint_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return with_signature(read, "text", "sig").select(F.col("id").alias(id_col), as_text(F.col("sig")).alias("fingerprint"))


#: Stretches that ids are cut into by one list of cuts, and parts that each of them is cut into at each further level.
STRETCHES, FAN = 4096, 64


def _stretch(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the id, found by way of every so many of them."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    up_to = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("id")))
    numbers = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs]).cast("array<long>")
    k = up_to(numbers([g[0] for g in groups[1:]]))
    return (k * step + up_to(F.get(F.array(*map(numbers, groups)), k))).cast("long")


def _with_bucket(read: DataFrame, rows_per_bucket: int) -> DataFrame:
    """read with the column bucket: numbers stretches of the ids in ascending order, with about rows_per_bucket rows each, cut by rank
    however the ids are spread. Beyond STRETCHES of them, each is cut again into FAN parts at most, and so on."""
    total = max(1, -(-read.count() // rows_per_bucket))
    first = min(total, STRETCHES)
    cuts = read.agg(F.percentile_approx("id", [k / first for k in range(1, first)], 50_000)).first()[0] if first > 1 else None
    out, left = read.withColumn("bucket", _stretch(cuts) if cuts else F.lit(0).cast("long")), -(-total // first)
    while left > 1:
        fan = min(left, FAN)
        # a row of FAN numbers for each stretch
        parts = stored(out.groupBy("bucket").agg(F.percentile_approx("id", [k / fan for k in range(1, fan)], 10_000).alias("cuts")), "cuts")
        inner = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("id"))), F.lit(0))
        out, left = out.join(F.broadcast(parts), "bucket").withColumn("bucket", F.col("bucket") * fan + inner).drop("cuts"), -(-left // fan)
    return out.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("bucket")))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2_000) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and the likeness to it and to the next document.

    Texts move once, by stretches of the ids; a stretch is in order by itself, and the first row of each stretch is handed
    to the stretch before it. So no task sees more than a stretch, at any size.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be a whole number, as the next document goes by its order")
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = _with_bucket(read, rows_per_bucket)
    # first texts of the stretches: a row for each, ordered among themselves without their texts
    firsts = stored(dealt.groupBy("bucket").agg(F.max("id").alias("first_id")), "stretches")
    around = Window.orderBy(F.desc("bucket"))
    highest = F.max("bucket").over(Window.partitionBy())
    links = firsts.select("bucket", F.coalesce(F.lead("bucket").over(around), highest).alias("next_bucket"))
    # a stretch's first id may be repeated: its least text comes first
    heads = dealt.groupBy("bucket").agg(F.min_by("text", F.struct(-F.col("id"), "text")).alias("head"))
    heads = links.join(heads.withColumnRenamed("bucket", "next_bucket"), "next_bucket").select("bucket", "head")
    heads = with_signature(heads, "head", "head_sig")

    order = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), "text")
    df = dealt.join(heads, "bucket").withColumn("next", F.coalesce(F.lead("text").over(order), "head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).drop("next", "head")
    df = with_signature(with_signature(df, "text", "sig"), "edited", "edited_sig")
    df = df.withColumn("next_sig", F.coalesce(F.lead("sig").over(order), "head_sig"))
    return df.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
SQL: dict[str, str] = {}
