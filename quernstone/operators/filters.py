"""Filters over ranked results, applied after top-k: a result that goes isn't replaced by the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.fuzzy import likeness
from quernstone.functions.query import text_matches
from quernstone.functions.text import col
from quernstone.operators.rank import sort_results
from quernstone.operators.search import Search


def text_filter(value: Column | str, needle: str, *, fuzzy: bool = False, threshold: int = 70) -> Column:
    """A text that the needle matches as a query, contains, or (fuzzy) is like; a blank needle matches everything."""
    if not needle.strip():
        return F.lit(True)
    hit = text_matches(value, F.lit(needle)) | F.contains(F.lower(col(value)), F.lit(needle.lower()))
    return hit | (likeness(F.lit(needle), col(value)) >= threshold) if fuzzy else hit


def filter_results(results: DataFrame, *, name: str = "", research: str = "", paper: str = "", fuzzy: bool = False, threshold: int = 70) -> DataFrame:
    """Results whose name contains name (spaces apart), and whose research and papers match; blank conditions are left out."""
    out = results
    if name.strip():
        out = out.where(F.contains(F.expr("replace(name, ' ', '')"), F.lit(name.replace(" ", ""))))
    for column, needle in (("research", research), ("papers", paper)):
        if needle.strip():
            out = out.where(text_filter(column, needle, fuzzy=fuzzy, threshold=threshold))
    return out


def new_names(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of other whose name baseline doesn't have for that query."""
    return other.join(baseline.select("query_id", "name").distinct(), ["query_id", "name"], "left_anti")


def compare(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, baseline, other, new): how many results each has, and how many names are new in other."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    joined = count(baseline, "baseline").join(count(other, "other"), "query_id", "full").join(count(new_names(baseline, other), "new"), "query_id", "left")
    return joined.fillna(0, ["baseline", "other", "new"])


def query_text(free: Column | str, research: Column | str, paper: Column | str, name: Column | str) -> Column:
    """What a form with these fields asks for: the free text, else research and paper, else the name."""
    both = F.trim(F.concat_ws(" ", F.nullif(F.trim(col(research)), F.lit("")), F.nullif(F.trim(col(paper)), F.lit(""))))
    return F.coalesce(F.nullif(F.trim(col(free)), F.lit("")), F.nullif(both, F.lit("")), F.trim(col(name)))


def clamp(k: int, threshold: int) -> tuple[int, int]:
    """The number of results between 3 and 20, the threshold between 0 and 100."""
    return min(20, max(3, k)), min(100, max(0, threshold))


def form_search(search: Search, *, free: str = "", research: str = "", paper: str = "", name: str = "", k: int = 8, threshold: int = 70, fuzzy: bool = True, order: str = "score") -> DataFrame:
    """What a search form shows: the query that its fields amount to, its results filtered by the other fields, and sorted."""
    k, threshold = clamp(k, threshold)
    spark = search.docs.sparkSession
    asked = spark.range(1).select(F.lit(1).alias("query_id"), query_text(F.lit(free), F.lit(research), F.lit(paper), F.lit(name)).alias("raw"))
    found = search.run(asked, top_k=k, fuzzy=fuzzy, threshold=threshold)
    texts = search.entities.select("name", "department", F.concat_ws(" ", col("research_direction"), col("personal_intro")).alias("own"), col("papers_text").alias("listed"))
    bodies = search.docs.select("doc_id", col("text").alias("body"))
    full = found.join(texts, ["name", "department"], "left").join(bodies, "doc_id", "left").withColumn("research", F.concat_ws(" ", "own", "body")).withColumn("papers", F.concat_ws(" ", "listed", "body"))
    kept = filter_results(full, name=name, research=research, paper=paper, fuzzy=fuzzy, threshold=threshold)
    return sort_results(kept, order).select(*found.columns)
