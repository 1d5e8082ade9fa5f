"""Merging of record tables: upserts, resumed work, rosters put back in order, and unions whose first source wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.rank import cap_per_group, first_per_key, number_all


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys of both; where both have one, the new row."""
    o, n = old.withColumn("_o", F.lit(1)).alias("o"), new.withColumn("_n", F.lit(1)).alias("n")
    pick = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c == key else F.when(F.col("_n") == 1, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*pick)


def to_do(roster: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to be worked on, rows done already)."""
    keys = done.select(key).distinct()
    return roster.join(keys, key, "left_anti"), roster.join(keys, key, "left_semi")


def in_roster_order(roster: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records in the order of the roster (key, ord), with a number place; those that the roster lacks come last, by key."""
    joined = records.join(roster.groupBy(key).agg(F.min("ord").alias("_ord")), key, "left")
    n = roster.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    known = joined.where("_ord IS NOT NULL").withColumn("place", F.col("_ord").cast("long"))
    extra = number_all(joined.where("_ord IS NULL"), [key], "place").withColumn("place", F.col("place") + F.lit(n).cast("long"))
    return known.unionByName(extra).drop("_ord")


def union_first_wins(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[Column | str], group: Sequence[str] = (), cap: int = 0) -> DataFrame:
    """The union of several lists; of a key's rows that of the first list, then the first in order; at most cap for each group."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    one = first_per_key(reduce(DataFrame.unionByName, tagged), key, ["_source", *order])
    return (cap_per_group(one, group, ["_source", *order], cap) if group else one).drop("_source")


def with_seeds(df: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """df and the seeds whose key it lacks."""
    return df.unionByName(seeds.join(df.select(key).distinct(), key, "left_anti"))


def pick_by_name(df: DataFrame, names: Sequence[str], column: str) -> DataFrame:
    """The rows of these names; raises ValueError if one of them has none."""
    wanted = F.broadcast(df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string"))  # as many as are named
    missing = [r[0] for r in wanted.join(df, column, "left_anti").collect()]
    if missing:
        raise ValueError(f"no rows for {', '.join(missing)}")
    return df.join(wanted, column, "left_semi")


def target_rows(rows: DataFrame, groups: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """The rows whose group is among the groups (key) and whose required fields aren't blank."""
    kept = rows.join(groups.select(key).distinct(), key, "left_semi")
    for field in required:
        kept = kept.where(F.trim(F.coalesce(F.col(field), F.lit(""))) != "")
    return kept


def collect_roster(channels: Sequence[DataFrame], groups: DataFrame, seeds: DataFrame, *, group: str, key: str, name: str, order: Sequence[Column | str], cap: int = 0) -> DataFrame:
    """The rosters of several channels, of which the first wins, as one: rows of the wanted groups that have a key and a name, one for each
    key of a group, at most cap for each group (0: all), and the seeds of those groups that are missing, whatever the cap."""
    listed = [target_rows(c, groups, group, [key, name]) for c in channels]
    rows = union_first_wins(listed, [group, key], order, [group], cap) if cap else union_first_wins(listed, [group, key], order)
    wanted = target_rows(seeds, groups, group, [key])
    return rows.unionByName(wanted.join(rows.select(group, key), [group, key], "left_anti"))
