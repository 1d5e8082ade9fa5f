"""Normalising, tokenising and cleaning of text, as column expressions.

White space is Unicode white space throughout ((?U) in patterns), and lower case stands for case folding.
Every function takes a column or its name and gives '' (or an empty array) for null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"


def col(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x computed once: as a variable it isn't written out at each of its uses."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def squeeze(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(x), r"(?U)\s+", " "))


def strip(x: Column | str, also: str = "") -> Column:
    """Without white space, or the characters of also, at either end."""
    inside = r"\s" if not also else "[" + "".join(f"\\u{ord(c):04x}" for c in also) + "]"
    return F.regexp_replace(col(x), f"(?U)^{inside}+|{inside}+$", "")


def normalize_text(x: Column | str) -> Column:
    """Without white space, in lower case: the form in which phrases are compared."""
    return F.lower(F.regexp_replace(col(x), r"(?U)\s+", ""))


def normalize_query(x: Column | str) -> Column:
    """Hyphens, underscores and slashes as spaces, then squeezed."""
    return squeeze(F.regexp_replace(strip(x), "[-_/]+", " "))


def _blocks(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"[{CJK}]+"), F.lit(0))


def _latin(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(x: Column | str) -> Column:
    """Latin and digit runs in lower case, then each CJK block's characters and overlapping pairs; repeats are kept."""

    def grams(block: Column) -> Column:
        chars = F.filter(F.split(block, ""), lambda c: c != "")
        pairs = F.when(F.length(block) > 1, F.transform(F.sequence(F.lit(1), F.length(block) - 1), lambda i: F.substring(block, i, F.lit(2))))
        return F.concat(chars, F.coalesce(pairs, F.array().cast("array<string>")))

    return let(col(x), lambda x: F.concat(_latin(x), F.flatten(F.transform(_blocks(x), grams))))


def relax_terms(x: Column | str) -> Column:
    """Distinct Latin runs and CJK pieces: blocks up to two characters whole, others cut in pairs without overlap."""

    def pieces(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(block), F.lit(2)), lambda i: F.substring(block, i, F.lit(2)))

    return let(col(x), lambda x: F.array_distinct(F.concat(_latin(x), F.flatten(F.transform(_blocks(x), pieces)))))


def term_counts(token_array: Column) -> Column:
    """array<struct<term, tf>> of an array of tokens, counted within the row: sorted, and cut where the term changes."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).alias("tf"))))

    return let(F.sort_array(token_array), runs)


# Prefixes that scope a query to a field.
FIELD_PREFIXES = [("姓名:", "name"), ("name:", "name"), ("论文:", "papers"), ("paper:", "papers"), ("研究方向:", "research"), ("research:", "research")]
# Words at the end of a query that don't change what it is about.
NAVIGATION_SUFFIXES = ["方向", "研究", "领域", "相关", "方面", "技术", "应用", "研究方向", "研究领域", "相关领域", "相关技术", "技术方向", "应用方向"]


def field_prefix(x: Column | str) -> Column:
    """struct<query, field>: what follows a field's prefix (of any case), and the field or null."""

    def parts(x: Column) -> Column:
        length, field = F.lit(0), F.lit(None).cast("string")
        for prefix, name in reversed(FIELD_PREFIXES):
            hit = F.startswith(F.lower(x), F.lit(prefix.lower()))
            length, field = F.when(hit, len(prefix)).otherwise(length), F.when(hit, F.lit(name)).otherwise(field)
        rest = let(length, lambda n: F.when(n > 0, strip(F.substring(x, n + 1, F.length(x)))).otherwise(x))
        return F.struct(rest.alias("query"), field.alias("field"))

    return let(col(x), parts)


def strip_navigation(x: Column | str) -> Column:
    """What stands before the longest navigation suffix, if at least two characters do; else null."""
    ends = F.array(*map(F.lit, sorted(NAVIGATION_SUFFIXES, key=len, reverse=True)))

    def cores(x: Column) -> Column:
        fit = F.filter(ends, lambda s: F.endswith(x, s) & (F.length(x) > F.length(s) + 1))
        return F.filter(F.transform(fit, lambda s: strip(F.substring(x, F.lit(1), F.length(x) - F.length(s)))), lambda c: F.length(c) >= 2)

    return F.get(let(col(x), cores), F.lit(0))


# Lines of page templates that carry nothing.
NAVIGATION_LINES = ["教师个人主页", "English", "返回首页", "欢迎登录", "导航", "个人资料", "个人概况", "研究领域", "研究方向", "开授课程", "科研项目", "论文", "科研成果", "荣誉及奖励", "招生信息", "相关教师", "最新更新", "教育经历", "工作经历", "社会职务", "个人简介", "访问", "科学研究", "基本信息", "联系方式", "教学", "课程", "科研团队"]
PAGE_NAVIGATION_LINES = ["教师个人主页", "English", "返回首页", "欢迎登录", "导航", "个人资料", "个人概况", "研究领域", "研究方向", "研究兴趣", "开授课程", "论文", "科研项目", "科研成果", "荣誉及奖励", "招生信息", "相关教师", "最新更新", "教育经历", "工作经历", "社会职务", "个人简介", "访问", "科学研究", "基本信息", "联系方式", "教学", "课程", "科研团队", "首页", "主页", "科研", "项目", "荣誉", "成果", "语言切换"]
HEADER_LINES = ["姓名:", "页面标题:"]


def without_front_matter(x: Column | str) -> Column:
    """What follows the first line of three or more hyphens, or all of it."""
    return F.element_at(F.split(col(x), "\n-{3,}\n", 2), -1)


def collapse_repeats(lines: Column) -> Column:
    """Without the elements that equal the one before."""
    return F.filter(lines, lambda s, i: (i == 0) | (s != F.coalesce(F.get(lines, i - 1), F.lit(""))))


def _kept_lines(text: Column, trim, drop: Sequence[str], headers: Sequence[str] = ()) -> Column:
    def keep(s: Column) -> Column:
        ok = (s != "") & ~s.isin(*drop) & ~s.rlike(r"^\d{1,6}$") & ~((F.length(s) <= 12) & s.rlike("[：:]$"))
        for header in headers:
            ok = ok & ~F.startswith(s, F.lit(header))
        return ok

    return let(F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), trim), keep), collapse_repeats)


def clean_corpus_text(x: Column | str) -> Column:
    """Without front matter, navigation, header, counter and label-only lines, and lines that repeat the one before."""
    return F.array_join(_kept_lines(without_front_matter(x), lambda s: strip(s), NAVIGATION_LINES, HEADER_LINES), "\n")


def clean_page_lines(x: Column | str, drop: Sequence[str] = ()) -> Column:
    """The same for the text of a page, whose blanks are squeezed; drop: further lines to leave out."""
    return F.array_join(_kept_lines(col(x), lambda s: strip(F.regexp_replace(s, "[ 　\t ]+", " ")), [*PAGE_NAVIGATION_LINES, *drop]), "\n")


# Where a field's own content ends; labels in front of it; where a page's footer begins.
BOILERPLATE = ["基本信息", "社会职务", "联系方式", "科学研究", "科研团队", "研究项目", "主要项目", "国家级科研项目", "最近更新", "论文发表", "代表性论文", "近五年", "课题组", "教学", "主持", "招生信息", "荣誉及奖励", "开授课程", "版权所有", "技术支持", "Copyright", "职称：", "-----"]
SECTION_LABELS = ["研究领域:", "研究方向:", "个人简介:", "简介:", "论文:", "论文/成果:"]
FOOTERS = ["版权所有", "技术支持", "Copyright", "招生信息", "荣誉及奖励", "开授课程"]
FIELD_ENDS, SNIPPET_ENDS = " 、；;,，.-", " -—、；;，,.·|"


def cut_at(x: Column | str, markers: Sequence[str]) -> Column:
    """What stands before the first marker that isn't at the very start."""
    words = F.array(*map(F.lit, markers))

    def head(x: Column) -> Column:
        cut = F.array_min(F.filter(F.transform(words, lambda m: F.instr(x, m)), lambda at: at > 1))
        return F.substring(x, F.lit(1), F.coalesce(cut, F.length(x) + 1) - 1)

    return let(col(x), head)


def trim_footer(x: Column | str) -> Column:
    return cut_at(x, FOOTERS)


def shorten(x: Column, most: int) -> Column:
    """The first characters and an ellipsis, if there are more."""
    return let(x, lambda x: F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(x))


def clean_field(x: Column | str, most: int = 180, cut_boilerplate: bool = False) -> Column:
    x = cut_at(x, BOILERPLATE) if cut_boilerplate else col(x)
    return shorten(strip(F.regexp_replace(x, r"(?U)\s+", " "), FIELD_ENDS), most)


def strip_section_label(x: Column | str) -> Column:
    labels = F.array(*map(F.lit, SECTION_LABELS))

    def rest(x: Column) -> Column:
        label = F.get(F.filter(labels, lambda m: F.startswith(x, m)), F.lit(0))
        return let(F.length(label), lambda n: F.when(n.isNull(), x).otherwise(strip(F.substring(x, n + 1, F.length(x)))))

    return let(col(x), rest)


def clean_snippet(x: Column | str) -> Column:
    """Without label and boilerplate; '' if fewer than four word characters are left."""
    text = strip(cut_at(strip_section_label(squeeze(x)), BOILERPLATE), SNIPPET_ENDS)
    return let(text, lambda t: F.when(F.length(F.regexp_replace(t, r"(?U)[\s\W]+", "")) < 4, F.lit("")).otherwise(t))


E_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![\d#-])(?:1[3-9]\d{9}|0\d{2,3}[-\s]?\d{7,8}|\d{3,4}[-\s]\d{7,8})(?!\d)"


def mask_emails(x: Column | str) -> Column:
    return F.regexp_replace(col(x), E_MAIL, "***@***")


def mask_private(x: Column | str) -> Column:
    """E-mail addresses and phone numbers masked; grant codes and ranges of years stay."""
    return F.regexp_replace(mask_emails(x), PHONE, "***")


# Labels that are no content by themselves.
INCOMPLETE, PAGE_INCOMPLETE = ["研究方向", "研究领域", "研究兴趣", "简介", "个人简介"], ["研究方向", "研究领域", "研究兴趣", "简介", "个人简介", "论文", "科研成果"]


def looks_incomplete(x: Column | str, labels: Sequence[str] = INCOMPLETE) -> Column:
    """Empty, ending in a colon, a bare label, or shorter than two characters."""
    core = lambda s: strip(F.regexp_replace(s, "[：: 。.]+$", ""))
    return let(strip(x), lambda s: (s == "") | s.rlike("[：:]$") | let(core(s), lambda c: c.isin(*labels) | (F.length(c) < 2)))


def normalize_url(x: Column | str, base: str = "") -> Column:
    """Without query, fragment and trailing slashes, in lower case; // means https, / the base."""
    s = strip(x)
    s = F.when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s)).when(F.startswith(s, F.lit("/")), F.concat(F.lit(base), s)).otherwise(s)
    return F.lower(F.regexp_replace(F.regexp_replace(s, "(?s)[?#].*$", ""), "/+$", ""))


def allowed_url(x: Column | str, hosts: Sequence[str]) -> Column:
    """A host that contains one of hosts, and a path that ends in .htm or .html or is a slug."""
    s = F.lower(col(x))
    host, path = (F.regexp_extract(s, "^[a-z]+://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    named = F.lit(False)
    for h in hosts:
        named = named | F.contains(host, F.lit(h))
    return named & (path.rlike(r"\.html?$") | path.rlike(r"^/[\w-]+/?$"))


def slug(x: Column | str, most: int = 80) -> Column:
    """A file name from a url's path: other characters than word characters as underscores."""
    path = F.regexp_extract(col(x), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"(?U)[^\w]+", "_"), 1, most)


def file_name(number: Column, name: Column | str, department: Column | str) -> Column:
    """0001_name_department.txt with characters that file names can't have as underscores."""
    joined = F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("_"), col(name), F.lit("_"), F.substring(col(department), 1, 8), F.lit(".txt"))
    return F.regexp_replace(joined, r'[/<>:"|?*\\]', "_")


def snippet(text: Column | str, terms: Column, around: int = 40, most: int = 120) -> Column:
    """The surroundings of the first of the terms, in their order, that the text contains; else its beginning."""

    def near(text: Column) -> Column:
        places = F.filter(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.instr(text, t)), lambda p: p > 0)

        def cut(at: Column) -> Column:
            start = F.greatest(at - 1 - around, F.lit(0))
            return F.when(at.isNull(), F.substring(text, 1, most)).otherwise(F.substring(text, start + 1, at - 1 + around - start))

        return F.substring(strip(F.regexp_replace(let(F.get(places, F.lit(0)), cut), "\n", " ")), 1, most)

    return let(col(text), near)


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle occurs in text, without overlap."""
    return F.when(F.length(needle) > 0, (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).otherwise(F.lit(0)).cast("int")


def distinct_by(items: Column, key) -> Column:
    """The first element for each key that isn't empty, in order."""

    def firsts(items: Column) -> Column:
        return let(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)))

    return let(items, firsts)
