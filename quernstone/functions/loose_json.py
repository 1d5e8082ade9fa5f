"""Reading of JSON that comes wrapped, broken or in another notation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.papers import PAPER_LINKS, display_title, paper_label, paper_noise, rank_hint
from quernstone.functions.text import col, distinct_by, let, squeeze, strip

PAPER = "struct<title:string,venue:string,year:string,ccf_rank:string>"
EXTRACTION = "struct<research_direction:string,personal_intro:string,keywords:array<string>,papers:array<string>>"


def unfenced(x: Column | str) -> Column:
    """Without the code fence that may stand around it."""
    return strip(F.regexp_replace(strip(x), r"(?im)^```(?:json)?\s*|\s*```$", ""))


def parse_object(x: Column | str, schema: str) -> Column:
    """The object in a text: all of it, or from its first opening to its last closing brace; null if neither can be read."""

    def read(s: Column) -> Column:
        return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & F.startswith(t, F.lit("{")), F.from_json(t, schema)) for t in (s, F.regexp_extract(s, r"(?s)(\{.*\})", 1))])

    return let(unfenced(x), read)


def parse_papers(x: Column | str) -> Column:
    """array<paper> of a list of papers, or of an object's field papers; null if there is neither."""

    def read(s: Column) -> Column:
        listed = F.when(F.try_parse_json(s).isNotNull() & F.startswith(s, F.lit("[")), F.from_json(s, f"array<{PAPER}>"))
        part = F.regexp_extract(s, r"(?s)(\{.*\}|\[.*\])", 1)
        return F.coalesce(listed, parse_object(s, f"struct<papers:array<{PAPER}>>")["papers"], F.when(F.startswith(part, F.lit("[")) & F.try_parse_json(part).isNotNull(), F.from_json(part, f"array<{PAPER}>")))

    return let(unfenced(x), read)


def parse_literal(x: Column | str) -> Column:
    """A paper from one line in the notation of a dictionary literal: single quotes, None; null if it's none."""
    s = strip(x)
    plain = F.regexp_replace(F.regexp_replace(s, r":\s*None\b", ": null"), r":\s*(True|False)\b", ": \"$1\"")
    read = F.from_json(plain, PAPER, {"allowSingleQuotes": "true", "allowNumericLeadingZeros": "true", "mode": "PERMISSIVE"})
    return F.when(F.startswith(s, F.lit("{")) & F.contains(s, F.lit("venue")), read)


def paper_item(row: Column) -> Column:
    """A displayed paper of a raw one: the venue for a missing title, digits of the year, a rank by hints if it has none; null without either."""

    def item(p: Column) -> Column:
        named = F.when(p["title"] != "", p["title"]).when(p["venue"] == "", F.lit(None)).when(p["year"] == "", p["venue"]).otherwise(F.concat(p["venue"], F.lit(" ("), p["year"], F.lit(")")))
        rank = F.when(p["rank"].isin("A", "B", "C"), p["rank"]).otherwise(rank_hint(p["venue"], named))
        return F.when(named.isNotNull(), F.struct(named.alias("title"), p["venue"].alias("venue"), p["year"].alias("year"), rank.alias("ccf_rank")))

    parts = F.struct(squeeze(row["title"]).alias("title"), squeeze(row["venue"]).alias("venue"), F.substring(F.regexp_replace(col(row["year"]), r"\D", ""), 1, 4).alias("year"), F.upper(strip(row["ccf_rank"])).alias("rank"))
    return let(parts, item)


def coerce_paper(x: Column) -> Column:
    """A paper from a text: a literal, or the text as a title if it's no label; null otherwise."""
    s = strip(x)
    titled = F.when((F.length(s) >= 6) & ~paper_label(s), F.struct(s.alias("title"), F.lit("").alias("venue"), F.lit("").alias("year"), F.lit("").alias("ccf_rank")))
    return F.coalesce(parse_literal(s), titled)


def clean_structs(papers: Column, most: int = 12) -> Column:
    """Normalised papers: titles cleaned or taken from the venue, four-digit years, ranks A to C, noise and repeats left out."""

    def normal(p: Column) -> Column:
        venue, year, rank = F.substring(squeeze(p["venue"]), 1, 80), F.regexp_extract(col(p["year"]), r"(20\d{2}|19\d{2})", 1), F.upper(strip(p["ccf_rank"]))
        return F.struct(display_title(p["title"], venue, year).alias("title"), venue.alias("venue"), year.alias("year"), F.when(rank.isin("A", "B", "C"), rank).otherwise("").alias("ccf_rank"))

    ok = lambda p: (F.length(p["title"]) >= 4) & ~paper_label(p["title"]) & ~p["title"].rlike(PAPER_LINKS) & ~paper_noise(p["title"], strict=True)
    kept = F.filter(F.transform(F.filter(papers, lambda p: p.isNotNull()), normal), ok)
    return F.slice(distinct_by(kept, lambda p: F.lower(F.concat_ws("|", p["title"], p["venue"], p["year"]))), 1, most)


