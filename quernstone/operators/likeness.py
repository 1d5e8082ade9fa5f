"""Pairs of texts of which one has a stretch like the other, found by the characters that they have to share.

The likeness (functions.fuzzy) is 2 * matched / (length of the shorter text + length of the stretch), and matched characters are a
common subsequence, so they can't exceed what the two multisets of characters have in common. For a likeness of r or more, at least
least_shared(n, r) of the n characters of the shorter text are in the stretch. Characters are numbered by occurrence (the second e of a
text is another token than the first), which turns multisets into sets, and texts are cut into overlapping stretches, each twice as
long as the texts of a class of lengths. Then the usual argument for prefixes of sets holds: of the n tokens of the shorter text any
n - least + 1 have one in the stretch, so only the rarest of them are looked up. Pairs that meet are kept if their token sets
have enough in common, and only these are scored. Equal texts are worked on once."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.fuzzy import likeness
from quernstone.operators.tables import small, stored


def least_shared(n: int, threshold: int) -> int:
    """Characters of a text of n that a stretch has to have for a likeness of `threshold` or more in 100, rounded. A stretch that the other
    text's end cuts to w characters needs r * (n + w) / 2 matches, and can't have more than w."""
    r = (threshold - 0.5) / 100
    return max(1, math.ceil(n * r / (2 - r) - 1e-9))


def _numbered_characters(text: Column | str) -> Column:
    """The characters of a text, each with the number of its occurrence."""

    def tokens(text: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for c in text:
            seen[c] += 1
            out.append(f"{c}{seen[c]}")
        return out

    def numbered(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return F.pandas_udf(numbered, "array<string>")(text)


def _least(n: Column, threshold: int) -> Column:
    r = (threshold - 0.5) / 100
    return F.greatest(F.lit(1), F.ceil(n * r / (2 - r) - 1e-9)).cast("int")


def _meeting(shorts: DataFrame, longs: DataFrame, threshold: int, *, equal: bool) -> DataFrame:
    """(short, long) of distinct texts (id, text, n) that may be alike, where short is not the longer one (`equal`: they may be of one length)."""
    cls = F.floor(F.log2("n")).cast("int")
    shorts = stored(shorts.select("id", "n", cls.alias("cls"), _least(F.col("n"), threshold).alias("least"), _numbered_characters("text").alias("tokens")))
    classes = sorted(r["cls"] for r in shorts.select("cls").distinct().collect())  # one for each power of two
    if not classes:
        return shorts.select(F.col("id").alias("short"), F.col("id").alias("long")).limit(0)
    of_class = longs.withColumn("cls", F.explode(F.array(*map(F.lit, classes)))).where("n >= shiftleft(1, cls)")
    cut = of_class.withColumn("wide", F.expr("shiftleft(2, cls)"))  # more than a short text of the class has
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("wide")).cast("int"))))
    stretches = stored(cut.select("id", "n", "cls", "at", _numbered_characters(F.expr("substring(text, at * wide + 1, 2 * wide)")).alias("tokens")))
    postings = stretches.select("id", "n", "cls", "at", F.explode("tokens").alias("token"))
    rarity = stored(postings.groupBy("cls", "token").agg(F.count(F.lit(1)).alias("df")))
    asked = shorts.select("id", "n", "cls", "least", F.explode("tokens").alias("token")).join(small(rarity, 200_000), ["cls", "token"], "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "token"))
    prefix = asked.withColumn("place", place).where("place <= n - least + 1 AND df IS NOT NULL").select(F.col("id").alias("short"), F.col("n").alias("short_n"), "cls", "token")
    met = postings.join(small(prefix, 200_000), ["cls", "token"]).where("n >= short_n" if equal else "n > short_n").select("short", F.col("id").alias("long"), "cls", "at").distinct()
    sides = met.join(small(shorts.select(F.col("id").alias("short"), "least", F.col("tokens").alias("own"))), "short").join(stretches.select(F.col("id").alias("long"), "cls", "at", "tokens"), ["long", "cls", "at"])
    return sides.where("size(array_intersect(own, tokens)) >= least").select("short", "long").distinct()


def alike(lefts: DataFrame, rights: DataFrame, threshold: int) -> DataFrame:
    """(a, b, score) of every distinct text a of lefts(text) and b of rights(text) whose likeness is `threshold` (1 to 100) or more.

    Null and empty texts are like nothing; a threshold below 1 counts as 1, as texts that share no character aren't alike."""
    threshold = max(1, threshold)
    a, b = (stored(side.select("text").where("text <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "text", F.length("text").alias("n"))) for side in (lefts, rights))
    pairs = _meeting(a, b, threshold, equal=True).select(F.col("short").alias("i"), F.col("long").alias("j"))
    pairs = pairs.unionByName(_meeting(b, a, threshold, equal=False).select(F.col("long").alias("i"), F.col("short").alias("j")))
    texts = pairs.join(a.select(F.col("id").alias("i"), F.col("text").alias("a")), "i").join(b.select(F.col("id").alias("j"), F.col("text").alias("b")), "j")
    # scores are made once, before the filter, which would ask for them a second time
    return stored(texts.select("a", "b", likeness("a", "b", threshold).alias("score"))).where(F.col("score") >= threshold)
