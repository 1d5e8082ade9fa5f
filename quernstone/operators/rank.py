"""De-duplication, total orders, top-k, caps and first-per-key, as windows that Spark limits before it shuffles.

Ties always end with an id, so every result is the same on any number of partitions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import strip
from quernstone.operators.tables import checkpointed


def hit_order() -> list[Column]:
    return [F.desc("score"), *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "department", "url", "doc_id")]]


def number(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """df with a row number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def number_all(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with a number from 1 over all rows in a total order: rows are dealt out by ranges of the order and numbered within
    each, and what comes before a range is added from one count for each of them."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([p for p, _ in counts], accumulate([n for _, n in counts], initial=0), strict=False))
    offsets = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map().cast("map<bigint,int>")
    return placed.withColumn(name, (F.col("_id") - F.shiftleft(part, 33) + F.element_at(offsets, part) + 1).cast("long")).drop("_id")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first rows of each key. The number is a literal, so every task keeps that many before the shuffle."""
    return number(df, keys, order, "_n").where(F.col("_n") <= most).drop("_n")


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], cap: int) -> DataFrame:
    """At most cap rows of each group, the earliest; 0: all."""
    return df if cap <= 0 else first_per_key(df, group, order, cap)


def dedupe_and_rank(hits: DataFrame, top_k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best hit for each name (without spaces) and department (trimmed), ranked; at most top_k for each query. Scores are rounded to nine
    places before they are compared: sums of the same weights in another order are ties, which names and ids decide."""
    keyed = hits.withColumn("score", F.round("score", 9)).withColumn("_name", F.replace(F.coalesce("name", F.lit("")), F.lit(" "), F.lit(""))).withColumn("_dept", strip("department"))
    best = first_per_key(keyed, [*by, "_name", "_dept"], hit_order()).drop("_name", "_dept")
    return number(best, by, hit_order()).where(F.col("rank") <= top_k)


def result_order(mode: str) -> list:
    """Orders of ranked results; ties stay in rank order."""
    return {"score": [F.desc("score")], "name": ["name", F.desc("score")], "department": ["department", "name", F.desc("score")]}[mode]


def sort_results(results: DataFrame, mode: str = "score") -> DataFrame:
    """Ranked results in another order: by score, name, or department."""
    return results.orderBy("query_id", *result_order(mode), "rank")
