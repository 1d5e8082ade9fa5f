"""Repair of records: extracted values merged in, fields cleaned, papers and research recovered from a record's own texts.

A record has name, department, career, research_direction, personal_intro, papers_text, full_text, keywords, papers_struct
and sections. Each step is a projection, done once for each kind of record where it takes long; columns named *_rule keep what a field was before its first change."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import loose_json as J
from quernstone.functions import papers as P
from quernstone.functions import text as T
from quernstone.operators.tables import small, stored

PAPERS = f"array<{J.PAPER}>"
RECORD = f"url string, name string, department string, career string, research_direction string, personal_intro string, papers_text string, full_text string, keywords array<string>, papers_struct {PAPERS}, sections map<string,string>"
TRACKED = ["research_direction", "personal_intro", "papers_text"]


def corpus_text(keywords: Column | None = None) -> Column:
    """The labelled lines of a record that are indexed."""
    line = lambda label, c: F.when(T.col(c) != "", F.concat(F.lit(label), T.col(c)))
    words = F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0, F.concat(F.lit("关键词:"), F.array_join(keywords, "、"))) if keywords is not None else F.lit(None)
    heads = [F.concat(F.lit(label), T.col(c)) for label, c in (("姓名:", "name"), ("学院:", "department"), ("职称:", "career"))]
    return F.substring(F.concat_ws("\n", *heads, line("研究方向:", "research_direction"), words, line("个人简介:", "personal_intro"), line("论文:", "papers_text")), 1, 15000)


def rebuild_corpus(records: DataFrame) -> DataFrame:
    return records.withColumn("corpus_text", corpus_text(F.col("keywords")))


def source_text(most: int = 12000) -> Column:
    """The text that an extraction works on: full text, else corpus text, else the sections, masked."""
    joined = F.array_join(F.map_values("sections"), "\n")
    return F.substring(T.mask_private(F.coalesce(F.nullif("full_text", F.lit("")), F.nullif("corpus_text", F.lit("")), joined, F.lit(""))), 1, most)


def titles(structs: Column) -> Column:
    return F.substring(F.array_join(F.filter(F.transform(structs, lambda p: p["title"]), lambda t: t != ""), "\n"), 1, 5000)


def sanitize_papers_field(records: DataFrame) -> DataFrame:
    """Leading labels go; a field that is a profile or has no credible title is replaced by titles from the full text, or blank."""
    stripped = P.without_leading_labels("papers_text")
    df = records.withColumn("_p", F.when(P.profile_block(stripped), F.lit("")).otherwise(stripped))
    df = df.withColumn("_bad", (F.col("_p") == "") | P.placeholder_papers("_p"))
    recovered = F.when(F.col("_bad"), F.substring(F.array_join(P.papers_after_markers("full_text"), "\n"), 1, 5000))
    df = df.withColumn("papers_text", F.when(F.col("_bad"), recovered).otherwise(F.col("_p")))
    return df.withColumn("papers_struct", F.when(F.col("_bad") & ((F.col("papers_text") != "") | (F.col("_p") != "")), F.lit(None).cast(PAPERS)).otherwise(F.col("papers_struct"))).drop("_p", "_bad")


def sanitize_papers(records: DataFrame) -> DataFrame:
    """Structured papers without noise, else clean lines, else titles from the full text, else none."""
    name, research = T.col("name"), T.col("research_direction")

    def checked(row: Column) -> Column:
        title, venue = T.strip(row["title"]), T.strip(row["venue"])
        shown = F.when(title != "", title).otherwise(venue)
        by_venue = (venue != "") & ~P.paper_noise(venue, name, research, strict=True)
        named = F.when((title == "") | P.paper_title(title, name, research), row["title"]).when(by_venue, venue)
        return F.when((shown != "") & ~P.paper_noise(shown, name, research, strict=True) & ((title == "") | named.isNotNull()), F.struct(named.alias("title"), row["venue"].alias("venue"), row["year"].alias("year"), row["ccf_rank"].alias("ccf_rank")))

    kept = F.filter(F.transform(F.coalesce("papers_struct", F.array().cast(PAPERS)), checked), lambda p: p.isNotNull())
    title = lambda t: ~P.paper_noise(t, name, research, strict=True) & P.paper_title(t, name, research)
    lines = F.array_distinct(F.filter(F.transform(P.lines_of("papers_text"), lambda s: P.clean_title(s)), lambda t: (t != "") & title(t)))
    df = records.withColumn("_kept", kept).withColumn("_lines", lines)
    had = (T.strip("papers_text") != "") | (F.size(F.coalesce("papers_struct", F.array().cast(PAPERS))) > 0)
    recovered = F.when(had, F.slice(F.filter(P.papers_after_markers("full_text"), lambda t: P.paper_title(t, name, research)), 1, 12)).otherwise(F.array().cast("array<string>"))
    text = F.when(F.size("_kept") > 0, titles(F.col("_kept"))).when(F.size("_lines") > 0, F.substring(F.array_join(F.slice("_lines", 1, 12), "\n"), 1, 5000)).otherwise(F.substring(F.array_join(recovered, "\n"), 1, 5000))
    return df.withColumn("papers_text", text).withColumn("papers_struct", F.when(F.size("_kept") > 0, F.slice("_kept", 1, 12))).drop("_kept", "_lines")


def clean_research(records: DataFrame) -> DataFrame:
    """The research field as clean topics; if none is left, those that the introduction names."""
    own = P.research_topics("research_direction", 120, "name", "department", ("http://", "https://", "dblp.", "google scholar"))
    said = P.research_topics(P.research_from_intro("personal_intro"), 120, "name", "department")
    return records.withColumn("research_direction", own).withColumn("research_direction", F.when(F.col("research_direction") == "", said).otherwise(F.col("research_direction")))


def sanitize(records: DataFrame) -> DataFrame:
    """Research, then papers, then the corpus text."""
    return rebuild_corpus(sanitize_papers(sanitize_papers_field(clean_research(records))))


def with_provenance(records: DataFrame) -> DataFrame:
    """Fields as they were before their first change, kept as *_rule where there is no such value yet."""
    return reduce(lambda df, c: df.withColumn(f"{c}_rule", F.coalesce(f"{c}_rule", c) if f"{c}_rule" in df.columns else F.col(c)), TRACKED, records)


def apply_extraction(records: DataFrame, extracted: DataFrame, key: str = "url") -> DataFrame:
    """Merges extracted values (key, content: an object as text): a value that isn't empty replaces the field, an empty one leaves it."""
    data = extracted.select(key, J.parse_object("content", J.EXTRACTION).alias("_x"))
    df = with_provenance(records).join(data, key, "left")
    research = F.substring(P.research_topics(F.col("_x.research_direction"), 120, "name", "department"), 1, 200)
    structs = J.clean_structs(F.transform(F.coalesce("_x.papers", F.array().cast("array<string>")), J.coerce_paper))
    words = P.normal_list(F.coalesce("_x.keywords", F.array().cast("array<string>")), 10)
    prefer = lambda new, old: F.when(new != "", new).otherwise(F.col(old))
    df = df.withColumn("_s", structs).withColumn("_w", words).withColumn("_r", research)
    df = df.withColumn("research_direction", prefer(F.col("_r"), "research_direction")).withColumn("personal_intro", prefer(F.substring(T.squeeze("_x.personal_intro"), 1, 600), "personal_intro"))
    df = df.withColumn("papers_text", F.when(F.size("_s") > 0, titles(F.col("_s"))).otherwise(F.col("papers_text"))).withColumn("papers_struct", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("papers_struct")))
    df = df.withColumn("keywords", F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.col("keywords"))).withColumn("llm_extracted", F.col("_x").isNotNull())
    return sanitize(df.drop("_x", "_s", "_w", "_r"))


def repair_literals(records: DataFrame) -> DataFrame:
    """Papers that were written as dictionary literals, line by line, as structures again."""
    found = J.clean_structs(F.transform(P.lines_of("papers_text"), J.coerce_paper))
    df = records.withColumn("_s", F.when(T.col("papers_text").rlike("['\"]title['\"]:"), found))
    some = F.coalesce(F.size("_s"), F.lit(0)) > 0
    return df.withColumn("papers_struct", F.when(some, F.col("_s")).otherwise(F.col("papers_struct"))).withColumn("papers_text", F.when(some, titles(F.col("_s"))).otherwise(F.col("papers_text"))).drop("_s")


def backfill_research(records: DataFrame) -> DataFrame:
    """An empty research field from the introduction; research_from_intro tells where that was done."""
    df = records.withColumn("_said", F.when(T.col("research_direction") == "", P.research_from_intro("personal_intro")).otherwise(""))
    df = df.withColumn("research_from_intro", F.col("_said") != "")
    return df.withColumn("research_direction", F.when(F.col("research_from_intro"), F.col("_said")).otherwise(F.col("research_direction"))).drop("_said")


def apply_screening(records: DataFrame, screened: DataFrame, key: str = "url", version: int = 1) -> DataFrame:
    """Replaces the papers of screened records (key, content: papers as text) by those that were confirmed; none means blank."""
    df = records.join(screened.select(key, J.parse_papers("content").alias("_x")), key, "left")
    ok = F.filter(J.clean_structs(F.coalesce("_x", F.array().cast(PAPERS))), lambda p: ~P.paper_noise(p["title"], T.col("name"), T.col("research_direction"), strict=True))
    df = df.withColumn("_done", F.col("_x").isNotNull()).withColumn("_s", ok)
    df = df.withColumn("papers_text", F.when(F.col("_done"), titles(F.col("_s"))).otherwise(F.col("papers_text")))
    df = df.withColumn("papers_struct", F.when(F.col("_done"), F.when(F.size("_s") > 0, F.col("_s"))).otherwise(F.col("papers_struct")))
    return rebuild_corpus(df.withColumn("papers_screened", F.col("_done")).withColumn("papers_screen_version", F.when(F.col("_done"), F.lit(version))).drop("_x", "_s", "_done"))


def candidates(records: DataFrame, *, names: list[str] | None = None, suspicious: bool = False, done: str | None = None, force: bool = False, limit: int = 0) -> DataFrame:
    """The records to extract or screen: by name, or suspicious, or all; without those done unless forced; limit: only so many, by url."""
    out = records
    if names:
        out = out.where(F.col("name").isin(*names))
    if suspicious:
        out = out.where(P.suspicious_papers("papers_text", "name", "research_direction"))
    if done and not force:
        out = out.where(~F.coalesce(F.col(done), F.lit(False)))
    return out.orderBy("url").limit(limit) if limit else out


def call_model(records: DataFrame, ask: Callable[[str], str], key: str = "url", tries: int = 3) -> DataFrame:
    """(key, content): what an external model says about each record's text. ask is called inside tasks; an error is tried again, then null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "content": [_answer(ask, x, tries) for x in frame["text"]]})

    return records.select(key, source_text().alias("text")).mapInPandas(run, f"{key} string, content string")


def _answer(ask: Callable[[str], str], text: str, tries: int) -> str | None:
    for _ in range(tries):
        try:
            return ask(text)
        except (OSError, ValueError):
            continue
    return None


def fix_research(records: DataFrame) -> DataFrame:
    """A clean and valid research field, else one from the record's texts, which then is its section too."""
    own = P.research_topics("research_direction", 120)
    df = records.withColumn("_own", own).withColumn("_own", F.when(P.valid_research(F.col("_own")), F.col("_own")).otherwise(""))
    section, intro = (F.try_element_at("sections", F.lit(k)) for k in ("research", "intro"))
    found = F.when(F.col("_own") == "", P.research_from_text(section, F.coalesce(intro, "personal_intro"), F.coalesce(F.nullif("full_text", F.lit("")), "corpus_text" if "corpus_text" in records.columns else F.lit("")))).otherwise("")
    df = df.withColumn("_found", found).withColumn("_found", F.when(P.valid_research(F.col("_found")), F.col("_found")).otherwise(""))
    df = df.withColumn("research_direction", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_found")))
    lacks = (F.col("_found") != "") & (F.coalesce(F.try_element_at("sections", F.lit("research")), F.lit("")) == "")
    return df.withColumn("sections", F.when(lacks, with_entry("research", F.col("_found"))).otherwise(F.col("sections"))).drop("_own", "_found")


def with_entry(field: str, value: Column) -> Column:
    """The sections with one entry replaced."""
    others = F.map_filter(F.coalesce("sections", F.create_map().cast("map<string,string>")), lambda k, _: k != field)
    return F.map_concat(others, F.create_map(F.lit(field), value))


def fix_papers(records: DataFrame) -> DataFrame:
    """The titles of the record's best source: of its paper fields, sections and full text, ordered by how much they look like papers,
    the one that gives most titles. Titles that repeat the research field, or aren't English titles of some length, go."""
    sources = [F.col("papers_text_rule") if "papers_text_rule" in records.columns else F.lit(""), F.try_element_at("sections", F.lit("papers")), F.try_element_at("sections", F.lit("publications")), F.col("papers_text"), F.col("full_text")]

    def tried(source: Column, n: Column) -> Column:
        return T.let(P.papers_of_block(source), lambda found: F.struct(F.size(found).alias("titles"), P.source_score(source, found).alias("score"), (-n).alias("n"), found.alias("found"), source.alias("source")))

    filled = F.filter(F.transform(F.array(*[T.col(s) for s in sources]), lambda s, n: F.struct(s.alias("source"), n.alias("n"))), lambda s: s["source"] != "")
    best = F.array_max(F.filter(F.transform(filled, lambda s: tried(s["source"], s["n"])), lambda t: (t["score"] > 0) & (t["titles"] > 0)))
    df = records.withColumn("_best", best).withColumn("_valid", F.filter("_best.found", lambda t: P.valid_title(t, F.col("_best.source"))))
    same = lambda t: P.comparable(t)
    clash = F.exists("_valid", lambda t: (F.length(t) >= 6) & (F.contains(P.comparable(T.col("research_direction")), same(t)) | ((T.col("research_direction") != "") & F.contains(same(t), P.comparable(T.col("research_direction"))))))
    strong = F.filter("_valid", lambda t: t.rlike("[A-Za-z]{4,}") & (F.length(F.regexp_replace(t, "[^ ]", "")) >= 2) & (F.length(t) >= 18))
    none = F.array().cast("array<string>")
    df = df.withColumn("_t", F.coalesce(F.when(clash, none).otherwise(F.slice(strong, 1, 12)), none))
    text = F.substring(F.array_join("_t", "\n"), 1, 5000)
    df = df.withColumn("papers_struct", F.when(F.size("_t") > 0, F.transform("_t", lambda t: P.paper_meta(t, F.col("_best.source"))))).withColumn("papers_text", text)
    return df.withColumn("sections", with_entry("papers", F.col("papers_text"))).drop("_best", "_valid", "_t")


def once_per_kind(records: DataFrame, inputs: Sequence[str], outputs: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """records with the outputs that work makes of the inputs, row by row. Rows whose inputs are the same are worked on once, and the work is dealt
    evenly, however few files or tasks the records come in."""
    spark = records.sparkSession
    digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    keyed = records.withColumn("_kind", digest)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = keyed.select("_kind", *inputs).dropDuplicates(["_kind"]).repartition(tasks)
    made = stored(work(kinds).select("_kind", *outputs))
    return keyed.drop(*outputs).join(small(made), "_kind").select(*records.columns)


def batch_fix(records: DataFrame) -> DataFrame:
    """Research and papers fixed, the corpus text made anew."""
    inputs = ["research_direction", "personal_intro", "papers_text", "full_text", "sections", *[c for c in ("papers_text_rule", "corpus_text") if c in records.columns]]
    fixed = once_per_kind(records, inputs, ["research_direction", "papers_text", "papers_struct", "sections"], lambda kinds: fix_papers(fix_research(kinds)))
    return rebuild_corpus(fixed)
