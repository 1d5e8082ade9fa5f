"""Reports on record tables: how many have each field, which lack some, and counts by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(column: str):
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def coverage(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, filled, total, coverage): the last as text, such as 3/4 (75.0%)."""
    sums = records.agg(F.count(F.lit(1)).alias("total"), *[F.sum(_has(f).cast("long")).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(0)).alias("filled")) for f in fields]))
    n = F.greatest("total", F.lit(1))
    return sums.select("total", rows.alias("r")).select("r.field", "r.filled", "total", F.format_string("%d/%d (%.1f%%)", "r.filled", n, F.round(100 * F.col("r.filled") / n, 1)).alias("coverage"))


def incomplete(records: DataFrame, fields: Sequence[str], keep: Sequence[str], samples: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Records that lack a field, with the names of those they lack; samples: only so many, the first in order."""
    lacking = F.filter(F.array(*[F.when(~_has(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    found = records.select(*keep, lacking.alias("missing")).where(F.size("missing") > 0)
    return found if samples is None else found.orderBy(*(order or keep)).limit(samples)


def count_by(records: DataFrame, column: str, unknown: str = "未知") -> DataFrame:
    return records.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def completeness(groups: DataFrame, rows: DataFrame, key: str, official: str) -> DataFrame:
    """(key, official, listed, flag): OK for each group that has as many rows as its official count, else 不足."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    df = groups.select(key, F.coalesce(F.col(official), F.lit(0)).cast("long").alias("official")).join(n, key, "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    return df.withColumn("flag", F.when(F.col("listed") >= F.col("official"), "OK").otherwise("不足"))


def progress(records: DataFrame, done: Column, failed: Column) -> DataFrame:
    """(total, done, failed, left): where a batch stands, and what a run that resumes it has to do. done counts before failed; null is false."""
    is_done, is_failed = F.coalesce(done, F.lit(False)), F.coalesce(failed, F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return records.agg(F.count(F.lit(1)).alias("total"), count(is_done).alias("done"), count(~is_done & is_failed).alias("failed"), count(~is_done & ~is_failed).alias("left"))
