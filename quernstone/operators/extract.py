"""Sections and records of web pages.

The markup is walked by the standard library's parser inside tasks, to lines with what is needed of their elements; sections are cut
from those lines by windows and array expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import papers as P
from quernstone.functions import text as T

# Headings of each field, in order; headings that end a section; titles to skip; hints at subpages.
SECTIONS = [
    ("research", ["研究领域", "研究方向", "研究兴趣", "主要研究方向", "研究概况", "research interests", "research interest", "research areas", "research area", "research"]),
    ("intro", ["个人简介", "个人简历", "简介", "简历", "个人概况", "个人介绍", "biography", "bio", "about me", "about", "profile"]),
    ("papers", ["论文", "科研成果", "代表性论文", "论文成果", "发表论文", "学术成果", "会议论文", "期刊论文", "学术论文", "代表性成果", "代表论文", "主要论文", "著作", "专利", "publications", "publication", "selected publications", "papers", "paper"]),
    ("projects", ["科研项目", "主持项目", "承担项目", "科研课题", "projects", "grants"]),
    ("courses", ["开授课程", "教学", "课程", "teaching", "courses"]),
    ("edu", ["教育经历", "教育背景", "education"]),
    ("work", ["工作经历", "工作背景", "experience"]),
    ("honor", ["荣誉及奖励", "获奖", "荣誉奖励", "honors", "awards"]),
]
STOP_HEADINGS = ["社会兼职", "社会职务", "研究生", "报考咨询", "招生信息", "最新消息", "最新动态", "最新", "相关链接", "校训", "相关教师", "个人资料", "联系方式", "项目", "报考", "what's new", "news", "contact", "links", "teaching", "honors", "awards", "projects", "students", "service"]
SKIPPED_TITLES = ["相关教师", "个人资料", "访问", "导航"]
SUBPAGES = [("research", ["research", "研究", "科研"]), ("papers", ["publication", "papers", "paper", "论文", "成果"]), ("intro", ["biography", "about", "简介", "个人", "主页", "home"])]
# Markers of the older layout; a line that begins with one of the first four is a marker too.
MARKERS, MARKER_PREFIXES, BEFORE_MARKERS = ["研究领域", "研究兴趣", "个人简介", "研究方向", "开授课程", "科研项目", "论文", "科研成果", "教育经历", "工作经历"], 4, "_header"
_SILENT, _VOID = {"script", "style", "noscript"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def canonical_field(title: Column) -> Column:
    """The field whose headings a title begins with, in the order of SECTIONS; else null."""

    def field(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, heads in reversed(SECTIONS):
            out = F.when((t != "") & F.exists(F.array(*map(F.lit, heads)), lambda h: F.startswith(t, h)), F.lit(name)).otherwise(out)
        return out

    return T.let(F.lower(T.strip(F.regexp_replace(T.strip(title), "[：:]+$", ""))), field)


def stop_heading(line: Column) -> Column:
    return F.lower(T.strip(F.regexp_replace(T.strip(line), "[：:]+$", ""))).isin(*STOP_HEADINGS)


class _Page(HTMLParser):
    """Collects a page's title, text, links, and boxes (title, body) of the module layout."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, set[str]]] = []
        self.title, self.text, self.links, self.boxes = [], [], [], []
        self.anchor: dict | None = None

    def _classes(self) -> list[set[str]]:
        return [c for _, c in self.path]

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        if tag == "div" and classes & {"post", "mbox"} and not any(c & {"post", "mbox"} for c in self._classes()):
            self.boxes.append({"kind": 3 * ({"post", "mbox"} <= classes) or 2 * ("post" in classes) or 1, "title": [], "body": [], "all": []})
        if tag == "a" and dict(attrs).get("href"):
            self.anchor = {"href": dict(attrs)["href"].strip(), "text": []}
        self.path.append((tag, classes))

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor:
            self.links.append((self.anchor["href"], " ".join(self.anchor["text"])))
            self.anchor = None
        if any(t == tag for t, _ in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        line = data.strip()
        tags = {t for t, _ in self.path}
        if not line or tags & _SILENT:
            return
        if "title" in tags:
            self.title.append(line)
            return
        self.text.append(line)
        if self.anchor is not None:
            self.anchor["text"].append(line)
        inside = set().union(*self._classes()) if self.path else set()
        if self.boxes and inside & {"post", "mbox"}:
            box = self.boxes[-1]
            box["all"].append(line)
            if "tit" in inside or "tt" in inside or (not box["title"] and tags & {"h2", "h3", "h4"}):
                box["title"].append(line)
            elif "con" in inside:
                box["body"].append(line)


PAGE = "title string, text string, links array<struct<href:string,text:string>>, boxes array<struct<kind:int,title:string,body:string>>"


def _walk(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    boxes = [{"kind": b["kind"], "title": " ".join(b["title"]), "body": "\n".join(b["body"] or b["all"])} for b in page.boxes]
    return {"title": " ".join(page.title), "text": "\n".join(page.text), "links": [{"href": h, "text": t} for h, t in page.links], "boxes": boxes}


def walked(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, title, text, links, boxes) of every page; a null page is an empty one."""
    read = pages.select(id_col, F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([_walk(x) for x in frame["html"]], columns=["title", "text", "links", "boxes"])
            yield pd.concat([frame[[id_col, "url"]].reset_index(drop=True), found], axis=1)

    return read.mapInPandas(run, f"{id_col} {read.schema[id_col].dataType.simpleString()}, url string, {PAGE}")


def box_sections(boxes: Column) -> Column:
    """map<field, text> of a page's boxes: of the best kind of layout that it has, the first box of each field with a body."""
    best = F.filter(boxes, lambda b: b["kind"] == F.array_max(F.transform(boxes, lambda x: x["kind"])))
    named = F.transform(best, lambda b: F.struct(canonical_field(b["title"]).alias("field"), T.clean_page_lines(F.regexp_replace(F.concat(F.lit("\n"), b["body"]), F.concat(F.lit("\n\\Q"), b["title"], F.lit("\\E[：:]?(?=\n|$)")), "\n")).alias("body"), b["title"].alias("title")))
    kept = F.filter(named, lambda s: s["field"].isNotNull() & ~s["title"].isin(*SKIPPED_TITLES) & ~T.looks_incomplete(s["body"], T.PAGE_INCOMPLETE))
    return F.map_from_entries(F.transform(T.distinct_by(kept, lambda s: s["field"]), lambda s: F.struct(s["field"], s["body"])))


def flat_sections(lines: DataFrame, key: str, *, order: str = "at", line: str = "line") -> DataFrame:
    """(key, field, body) of lines (key, at, line): a heading of a field opens a section, which runs to the next heading or stop heading.

    Lines are numbered by the headings before them, so a page's sections fall out of one window over it."""
    short = F.length(T.strip(line)) <= 24
    marked = lines.withColumn("_field", F.when(short & (T.strip(line) != ""), canonical_field(F.col(line)))).withColumn("_stop", short & stop_heading(F.col(line)))
    marked = marked.withColumn("_head", F.col("_field").isNotNull() | F.col("_stop"))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("_section", F.sum(F.col("_head").cast("int")).over(so_far))
    heads = F.last(F.when(F.col("_head"), F.struct(F.col("_field").alias("f"))), ignorenulls=True).over(so_far)
    body = numbered.withColumn("field", heads["f"]).where("field IS NOT NULL AND NOT _head")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n")
    found = body.groupBy(key, "field").agg(T.clean_page_lines(joined).alias("body"))
    return found.where(~T.looks_incomplete("body", T.PAGE_INCOMPLETE))


def marker_sections(lines: DataFrame, key: str, *, order: str = "at", line: str = "line") -> DataFrame:
    """(key, name, body) of lines (key, at, line): the lines after each marker, under the marker's whole line, and those before the first
    under BEFORE_MARKERS. Of sections of one name the last that has lines counts."""
    text = F.col(line)
    head = text.isin(*MARKERS) | F.exists(F.array(*map(F.lit, MARKERS[:MARKER_PREFIXES])), lambda m: F.startswith(text, m))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_head", head).withColumn("_section", F.sum(F.col("_head").cast("int")).over(so_far))
    marked = marked.withColumn("name", F.coalesce(F.last(F.when(F.col("_head"), text), ignorenulls=True).over(so_far), F.lit(BEFORE_MARKERS)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n")
    bodies = marked.where(~F.col("_head")).groupBy(key, "name", "_section").agg(T.strip(joined).alias("body"))
    return bodies.groupBy(key, "name").agg(F.max_by("body", "_section").alias("body"))


def link_samples(links: Column, most: int = 40) -> Column:
    """The first distinct texts of a page's links that have 5 to 99 characters."""
    texts = F.filter(F.transform(links, lambda x: T.strip(x["text"])), lambda t: (F.length(t) > 4) & (F.length(t) < 100))
    return F.slice(F.array_distinct(texts), 1, most)


def page_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, body): the sections of the boxes, and those of the flat text for pages that lack a main field."""
    boxed = pages.select(key, F.explode(box_sections(F.col("boxes"))).alias("field", "body"))
    full = boxed.where(F.col("field").isin("research", "intro", "papers")).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    lines = pages.join(full.select(key), key, "left_anti").select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    flat = flat_sections(lines, key)
    return boxed.unionByName(flat.join(boxed.select(key, "field"), [key, "field"], "left_anti"))


def subpage_links(pages: DataFrame, hosts: list[str], key: str = "page_id") -> DataFrame:
    """(key, field, link): for each hint the first link of a page to another allowed page of its host."""
    links = pages.select(key, "url", F.posexplode("links").alias("at", "l")).select(key, "url", "at", "l.*").where("href <> ''").where(~F.col("href").rlike(r"^(javascript:|#|mailto:|tel:)"))

    def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", h) for b, h in zip(base, href, strict=True)])

    join = F.pandas_udf(absolute, "string")
    links = links.withColumn("link", T.normalize_url(join("url", "href"))).withColumn("low", F.lower(F.concat_ws(" ", "text", "href")))
    host = lambda c: F.regexp_extract(F.lower(F.col(c)), "^[a-z]+://([^/?#]*)", 1)
    links = links.where((host("link") == host("url")) & (F.col("link") != T.normalize_url("url")) & T.allowed_url("link", hosts))
    hints = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, h)).alias("hints")) for f, h in SUBPAGES])
    hit = links.select(key, "at", "link", F.explode(F.filter(hints, lambda s: F.exists(s["hints"], lambda h: F.contains(F.col("low"), h)))).alias("s"))
    return hit.groupBy(key, F.col("s.field").alias("field")).agg(F.min_by("link", "at").alias("link"))


def finalize(sections: Column, name: Column | str, title: Column | str, department: Column | str, career: Column | str, full_text: Column | str) -> Column:
    """struct of a record's fields from its sections: masked, cut to their sizes, blank if incomplete, research taken from the introduction if missing."""
    part = lambda field, most: T.let(F.substring(T.mask_private(F.coalesce(F.try_element_at(sections, F.lit(field)), F.lit(""))), 1, most), lambda x: F.when(T.looks_incomplete(x, T.PAGE_INCOMPLETE), F.lit("")).otherwise(x))

    def record(p: Column) -> Column:
        research = F.when((p["research"] == "") & (p["intro"] != ""), P.research_from_intro(p["intro"])).otherwise(p["research"])
        named = F.coalesce(F.nullif(T.strip(name), F.lit("")), T.col(title))

        def whole(r: Column) -> Column:
            line = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
            corpus = F.substring(F.concat_ws("\n", F.concat(F.lit("姓名:"), named), F.concat(F.lit("学院:"), T.col(department)), F.concat(F.lit("职称:"), T.col(career)), line("研究方向:", r), line("个人简介:", p["intro"]), line("论文:", p["papers"])), 1, 15000)
            return F.struct(named.alias("name"), r.alias("research_direction"), p["intro"].alias("personal_intro"), p["papers"].alias("papers_text"), corpus.alias("corpus_text"), F.substring(T.mask_private(full_text), 1, 20000).alias("full_text"))

        return T.let(research, whole)

    return T.let(F.struct(part("research", 600).alias("research"), part("intro", 3000).alias("intro"), part("papers", 5000).alias("papers")), record)


def _with_subpages(pages: DataFrame, key: str, hosts: list[str]) -> DataFrame:
    """(key, sections, full_text) of pages and their subpages: a field that the page lacks is that of its first subpage, in the order of SUBPAGES,
    that has it; a subpage without its own field gives all it has, and its whole text for that field if nothing else does."""
    own = page_sections(pages, key)
    text = pages.select(F.col(key).alias("_sub"), T.normalize_url("url").alias("link"), T.clean_page_lines("text").alias("main")).where("link <> ''").dropDuplicates(["link"])
    names = [name for name, _ in SUBPAGES]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("field")).cast("int")
    links = subpage_links(pages, hosts, key).withColumn("place", place).groupBy(key, "link").agg(F.min_by("field", "place").alias("canon"), F.min("place").alias("place"))
    # fields that are no core field are looked up only where the page has none
    links = links.join(own.where("field = 'intro'").select(key, F.col("field").alias("canon")), [key, "canon"], "left_anti")
    found = links.join(text, "link").where(F.col("_sub") != F.col(key))
    theirs = found.select(key, "_sub", "canon", "place").join(own.select(F.col(key).alias("_sub"), "field", "body"), "_sub")
    has = theirs.where("field = canon").select(key, "_sub").distinct().withColumn("has", F.lit(True))
    theirs = theirs.join(has, [key, "_sub"], "left").where(F.col("has").isNull() | (F.col("field") == F.col("canon")))
    whole = found.where(F.length("main") > 30).select(key, F.col("canon").alias("field"), F.col("main").alias("body"), (F.col("place") + 0.5).alias("rank"))
    every = own.withColumn("rank", F.lit(0.0)).unionByName(theirs.select(key, "field", "body", F.col("place").cast("double").alias("rank"))).unionByName(whole)
    first = every.groupBy(key, "field").agg(F.min_by("body", "rank").alias("body"))
    sections = first.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "body")))).alias("sections"))
    parts = pages.select(key, F.lit(0).alias("place"), T.clean_page_lines("text").alias("main")).unionByName(found.select(key, "place", "main")).where("main <> ''")
    texts = parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "main"))), lambda p: p["main"]), "\n").alias("full_text"))
    return pages.select(key).join(sections, key, "left").join(texts, key, "left").withColumn("full_text", F.coalesce("full_text", F.lit("")))


def page_records(pages: DataFrame, key: str = "page_id", hosts: list[str] | None = None) -> DataFrame:
    """A record for each walked page, of its sections alone, or, with hosts, of those of the subpages on its own host too."""
    if hosts is None:
        found = page_sections(pages, key).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "body")))).alias("sections"))
        df = pages.select(key, "url", "title", T.clean_page_lines("text").alias("full_text")).join(found, key, "left")
    else:
        df = pages.select(key, "url", "title").join(_with_subpages(pages, key, hosts), key)
    df = df.withColumn("sections", F.coalesce("sections", F.create_map().cast("map<string,string>")))
    return df.select(key, "url", "title", "sections", finalize(F.col("sections"), F.lit(""), "title", F.lit(""), F.lit(""), "full_text").alias("r")).select(key, "url", "title", "sections", "r.*")
