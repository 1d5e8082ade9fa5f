"""URL filters as a sort-merge range join, in DataFrame operations alone.

A host is turned round label by label (``www.example.org`` -> ``org.example.www``), so that a host and its
subdomains share a prefix, and a path prefix appended to a zone's key spans one interval of keys. Each url
is dealt to its zones (its host and the parents of it that have rules) and swept there in key order along
with the zone's rules. The sweep carries the stack of nested rules that the last rule opened; the rules of
the stack that still cover the url's path are the active ones, and the deepest wins.

Defined results
  null url, or one without ``://``: empty host and path, no rule, the default verdict.
  several rules that fit: the longest rule string; of equal length the longer host.
  a rule listed twice: once with either verdict is one rule, and block outranks allow.
  repeated page rows: one result row for each; an empty table gives an empty result; ids may be of any type; further columns of
  the input are not read, whatever their names. Very long urls: whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import ASCII_UPPER, stored, table

RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
DEFAULT_VERDICT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, ASCII_UPPER, ASCII_UPPER.lower())


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def zones_of(host: Column) -> Column:
    """The reversed keys of a host and of every parent of it."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    df = spark.createDataFrame(rules, "rule string, verdict string")
    host = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    return df.select("rule", "verdict", F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()).alias("host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("prefix"))


def _stacked(rules: DataFrame) -> DataFrame:
    """One row for each rule: zone, prefix, and the stack of the zone's rules whose prefix starts this one."""
    one = rules.where(F.col("rule").isNotNull()).groupBy(reversed_host(F.col("host")).alias("zone"), "prefix").agg(F.max(F.struct("verdict", "rule", F.length("rule").alias("size"), F.length("host").alias("host_size"))).alias("own"))
    heads = one.select("zone", "prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))).alias("head"))
    outer = one.select("zone", F.col("prefix").alias("head"), F.struct(F.length("prefix").alias("depth"), F.col("prefix").alias("head"), "own").alias("entry"))
    return heads.join(outer, ["zone", "head"]).groupBy("zone", "prefix").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, rows_per_zone: int = 1_000, broadcast_zones: int = 50_000) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    rows_per_zone: a zone with more urls than this (and than 1/1000 of all) is swept in so many salted parts,
    each with the zone's own rules. Such zones number at most 1000 times the labels of a host, which bounds
    the table of salts that is broadcast. broadcast_zones: the zones of the rules are broadcast up to this
    number and joined by a shuffle beyond it.
    """
    read = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    stacks = stored(_stacked(rules), "stacks")
    zones = stacks.select("zone").distinct()
    targets = read.where(F.col("host") != "").select("host", "path").distinct()
    levels = targets.select("host", "path", F.explode(zones_of(F.col("host"))).alias("zone"))
    levels = levels.join(F.broadcast(zones) if zones.count() <= broadcast_zones else zones, "zone", "left_semi")

    per_zone = levels.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    per_zone = stored(per_zone, "zones")
    total = per_zone.agg(F.sum("n")).first()[0] or 0
    most = max(rows_per_zone, total // 1000)
    hot = per_zone.where(F.col("n") > most).select("zone", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    opened = stacks.join(F.broadcast(hot), "zone", "left").select("zone", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("prefix").alias("key"), F.lit(0).alias("is_url"), F.lit(None).cast("string").alias("host"), "stack")
    dealt = levels.join(F.broadcast(hot), "zone", "left").select("zone", F.pmod(F.xxhash64("host", "path"), parts.cast("bigint")).cast("int").alias("part"), F.col("path").alias("key"), F.lit(1).alias("is_url"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("zone", "part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opened.unionByName(dealt).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    active = F.filter("open", lambda e: F.col("key").startswith(e["head"]))
    deepest = F.element_at(active, -1)["own"]
    found = swept.where(F.size(active) > 0).select("host", F.col("key").alias("path"), deepest.alias("own"))
    best = found.groupBy("host", "path").agg(F.max(F.struct("own.size", "own.host_size", "own.rule", "own.verdict")).alias("best"))
    out = read.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = {
    "op9_url_filters": r"""
WITH read AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rhost, prefix, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (
  SELECT r.*, (SELECT max(struct_pack(n := length(rule), h := length(rhost), rule := rule, verdict := verdict)) FROM rules
    WHERE (r.host = rhost OR ends_with(r.host, '.' || rhost)) AND starts_with(r.path, prefix)) AS best
  FROM read r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fit
""",
}
QUERIES = {"op9_url_filters": op9_url_filters}
