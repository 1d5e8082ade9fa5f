"""Widening of queries: the phrases and terms that a raw query stands for, as column expressions.

The dictionaries are literal arrays, folded into the plan, so a batch of queries of any size is widened in one pass."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.dictionaries import ABBREVIATIONS, PHRASES
from quernstone.functions.text import col, distinct_by, field_prefix, let, normalize_query, normalize_text, relax_terms, strip, strip_navigation


def _literal(rows: list[dict], schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


def phrase_aliases(query: Column) -> Column:
    """Equivalents of all phrases whose pattern the query has, in the order of the dictionary."""
    rules = _literal([{"p": p, "a": a} for p, a in PHRASES], "array<struct<p:string,a:array<string>>>")
    return F.flatten(F.transform(F.filter(rules, lambda r: F.regexp_like(F.lower(query), r["p"])), lambda r: r["a"]))


def abbreviation_aliases(query: Column) -> Column:
    """Equivalents of the words that are abbreviations, in the order of the words. Words may have digits (5g)."""
    table = F.map_from_entries(_literal([{"k": k, "v": v} for k, v in ABBREVIATIONS], "array<struct<k:string,v:array<string>>>"))
    words = F.regexp_extract_all(query, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.flatten(F.filter(F.transform(words, lambda w: F.get(F.array(F.try_element_at(table, F.lower(w))), F.lit(0))), lambda a: a.isNotNull()))


def query_plan(query: Column | str) -> Column:
    """struct<original, phrases, tokens> of a query without its field prefix."""

    def phrases(original: Column) -> Column:
        own = F.filter(F.array(strip_navigation(original), original), lambda x: x.isNotNull())
        found = F.concat(phrase_aliases(original), abbreviation_aliases(original), own)
        return F.when(original == "", F.array().cast("array<string>")).otherwise(distinct_by(found, normalize_text))

    def plan(original: Column) -> Column:
        terms = lambda p: distinct_by(F.flatten(F.transform(p, relax_terms)), normalize_text)
        return let(phrases(original), lambda p: F.struct(original.alias("original"), p.alias("phrases"), terms(p).alias("tokens")))

    return let(normalize_query(query), plan)


def planned(raw: Column | str) -> Column:
    """struct<query, field, original, phrases, tokens> of a raw query."""

    def scoped(s: Column) -> Column:
        parts = lambda p: F.struct(s["query"].alias("query"), s["field"].alias("field"), p["original"].alias("original"), p["phrases"].alias("phrases"), p["tokens"].alias("tokens"))
        return let(query_plan(s["query"]), parts)

    return let(field_prefix(strip(raw)), scoped)


def text_matches(text: Column | str, raw: Column | str, plan: Column | None = None) -> Column:
    """Whether a text has one of the query's phrases, or of its terms of two characters or more; an empty query matches all.
    plan: the query's plan, if it is there already."""

    def hit(hay: Column) -> Column:
        some = lambda p: F.exists(p["phrases"], lambda x: F.contains(hay, F.lower(x))) | F.exists(p["tokens"], lambda t: (F.length(t) >= 2) & F.contains(hay, F.lower(t)))
        return F.when(hay == "", F.lit(False)).otherwise(let(planned(raw) if plan is None else plan, some))

    return F.when(strip(raw) == "", F.lit(True)).otherwise(let(F.lower(col(text)), hit))


def query_terms(raw: Column | str) -> Column:
    return let(planned(raw), lambda p: F.array_distinct(F.concat(p["phrases"], p["tokens"])))


def matched_keywords(raw: Column | str, *fields: Column | str, most: int = 5) -> Column:
    """The query's terms that the fields have, longest first, without those inside a longer one."""
    hay = normalize_text(F.concat_ws(" ", *map(col, fields)))

    def longest(hits: Column) -> Column:
        ranked = F.array_sort(F.transform(hits, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
        return let(ranked, lambda r: F.filter(F.transform(r, lambda s: s["t"]), lambda t: ~F.exists(r, lambda y: (y["t"] != t) & F.contains(y["t"], t))))

    return F.slice(let(let(hay, lambda h: F.filter(query_terms(raw), lambda t: F.contains(h, normalize_text(t)))), longest), 1, most)
