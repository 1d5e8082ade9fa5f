"""Evaluation of search: hits among the first results, the rank of what is expected, and their means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.search import FUZZY, Search


def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each case (query_id, query, expected, note): top1, topk_names, hit_at_1, hit_at_k, expected_rank (0: none), result_count."""
    joined = cases.join(results.select("query_id", "rank", "name"), "query_id", "left")
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "name")))), lambda s: s["name"])
    top1 = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("name"))), F.lit(""))
    found = joined.groupBy(*cases.columns).agg(top1.alias("top1"), F.array_join(names, "|").alias("topk_names"), F.coalesce(F.min(F.when(F.col("name") == F.col("expected"), F.col("rank"))), F.lit(0)).alias("expected_rank"), F.count("rank").alias("result_count"))
    return found.withColumn("hit_at_1", (F.col("top1") == F.col("expected")).cast("int")).withColumn("hit_at_k", (F.col("expected_rank") > 0).cast("int"))


def summarize(detail: DataFrame) -> DataFrame:
    """Per mode: cases, hits, and rates to four places; the mean of latency_ms too where there is that column."""
    rates = [x for k in ("1", "k") for x in (F.sum(f"hit_at_{k}").alias(f"hit_at_{k}_count"), F.round(F.avg(f"hit_at_{k}"), 4).alias(f"hit_at_{k}_rate"))]
    if "latency_ms" in detail.columns:
        rates.append(F.round(F.avg(F.round("latency_ms", 2)), 2).alias("avg_latency_ms"))
    return detail.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), *rates)


def evaluate_modes(search: Search, cases: DataFrame, top_k: int = 5, *, fuzzy: bool = True) -> DataFrame:
    """Details of two modes: baseline (no relaxing) and optimized (relaxing and, with fuzzy, likeness)."""
    queries = cases.select("query_id", F.col("query").alias("raw"))
    modes = {"baseline": {"relax": False, "fuzzy": False}, "optimized": {"relax": True, "fuzzy": fuzzy}}
    known: dict[int, DataFrame] = {}  # the stages that both modes have are run once: those of the baseline, which has more queries left
    return reduce(DataFrame.unionByName, [evaluate(cases, search.ranked(queries, top_k=top_k, known=known, **o)).withColumn("mode", F.lit(m)) for m, o in modes.items()])


def sweep(search: Search, cases: DataFrame, thresholds: Sequence[int], top_k: int = 10) -> DataFrame:
    """(threshold, cases, hit_at_1_count, hit_at_k_count): the optimized mode at any number of thresholds of likeness.

    Texts are scored once, at the least threshold. Results of the stage by likeness are in order of their scores, so a greater
    threshold keeps a first part of them, and the rank of what is expected stays what it is up to its own score."""
    results = search.run(cases.select("query_id", F.col("query").alias("raw")), top_k=top_k, threshold=min(thresholds)).select("query_id", "stage", "rank", "name", "score")
    found = cases.join(results.withColumnRenamed("name", "expected"), ["query_id", "expected"]).groupBy("query_id").agg(F.min("rank").alias("rank"), F.max(F.when(F.col("stage") == FUZZY, F.col("score")).otherwise(101)).alias("up_to"))
    asked = cases.select("query_id", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).join(found, "query_id", "left")
    holds = F.col("up_to") >= F.col("threshold")
    return asked.groupBy("threshold").agg(F.count(F.lit(1)).alias("cases"), *[F.sum(F.when(holds & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_at_{n}_count") for n, k in (("1", 1), ("k", top_k))])
