"""The rows that a reader sees: fields masked, cleaned and shortened, topics and papers listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import loose_json as J
from quernstone.functions import papers as P
from quernstone.functions import text as T
from quernstone.functions.query import matched_keywords

PAPERS = f"array<{J.PAPER}>"


def paper_items(structs: Column, fallback: Column | str, name: Column | str, research: Column | str, most: int = 12) -> Column:
    """The papers of the structured list (its first rows), without noise; if none is left, those of the lines of a text."""
    listed = F.filter(F.transform(F.slice(F.coalesce(structs, F.array().cast(PAPERS)), 1, most), J.paper_item), lambda p: p.isNotNull() & ~P.paper_noise(p["title"], T.col(name), T.col(research)))

    def of_line(line: Column) -> Column:
        title = T.squeeze(line)
        plain = F.when(P.displayable_paper(title, T.col(name), T.col(research)), F.struct(title.alias("title"), F.lit("").alias("venue"), F.lit("").alias("year"), P.rank_hint(F.lit(""), title).alias("ccf_rank")))
        return F.coalesce(J.paper_item(J.parse_literal(line)), plain)

    lines = F.slice(F.filter(F.transform(F.split(T.col(fallback), "[\r\n]+"), of_line), lambda p: p.isNotNull()), 1, most)
    return T.let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(lines))


def build_display(results: DataFrame, entities: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each result (query_id, rank, score, name, department, url, snippet) with what is shown of its entity."""
    shown = results.join(entities.drop("url"), ["name", "department"]).join(queries.select("query_id", "raw"), "query_id")
    kept = lambda c: F.when(T.looks_incomplete(c), F.lit("")).otherwise(F.col(c))
    research = T.mask_private(P.research_topics(T.clean_field(kept("research_direction"), 500, True), 140, "name", "department"))
    df = shown.withColumn("research", research).withColumn("intro", T.mask_private(T.clean_field(T.trim_footer(kept("personal_intro")), 200)))
    df = df.withColumn("papers", T.mask_private(T.clean_field(T.trim_footer(kept("papers_text")), 200))).withColumn("snippet", T.mask_private(T.clean_snippet("snippet")))
    visible = T.normalize_text(F.concat_ws(" ", "research", "intro", "papers"))
    structs = F.col("papers_struct") if "papers_struct" in entities.columns else F.lit(None).cast(PAPERS)
    return df.select(
        "query_id", "rank", "name", "department", "career", "research", "intro", "papers",
        F.when(F.contains(visible, T.normalize_text("snippet")), F.lit("")).otherwise(F.col("snippet")).alias("snippet"), "url", "score",
        matched_keywords("raw", "name", "department", "research_direction", "papers_text", "personal_intro").alias("keywords"),
        P.research_tags("research", 8, "name", "department").alias("research_tags"),
        paper_items(structs, T.mask_private(T.trim_footer("papers_text")), "name", "research_direction").alias("paper_items"),
    )


def as_text(view: DataFrame, papers: int = 8) -> DataFrame:
    """(query_id, rank, text): each displayed row as lines of text."""
    optional = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def paper(p: Column, i: Column) -> Column:
        meta = F.concat_ws(" · ", F.nullif(p["venue"], F.lit("")), F.nullif(p["year"], F.lit("")))
        badge = F.when(p["ccf_rank"] != "", F.concat(F.lit("[CCF-"), p["ccf_rank"], F.lit("] "))).otherwise("")
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), badge, p["title"], F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""))

    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws("  |  ", "name", "department", F.nullif("career", F.lit(""))))
    listed = F.when(F.size("paper_items") > 0, F.concat(F.lit("论文/成果:\n"), F.array_join(F.transform(F.slice("paper_items", 1, papers), paper), "\n"))).otherwise(optional("论文/成果: ", F.col("papers")))
    lines = F.concat_ws("\n", head, optional("研究方向: ", F.col("research")), optional("简介: ", F.col("intro")), listed, optional("片段: ", F.col("snippet")), optional("命中关键词: ", F.array_join("keywords", " / ")), optional("主页: ", F.col("url")))
    return view.select("query_id", "rank", lines.alias("text"))
