"""What is a paper title, a research topic, or noise, in the fields of a profile: column expressions over text and arrays.

Conditions are sets of patterns; where an earlier one decides before a later one, a CASE has them in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import col, cut_at, distinct_by, let, looks_incomplete, squeeze, strip

# Hints at a venue's rank, as parts of the lower-case venue and title; A before B before C.
RANK_HINTS = [
    ("A", ["sigir", "acl", "kdd", "icde", "infocom", "cvpr", "iccv", "eccv", "neurips", "nips", "icml", "aaai", "ijcai", "usenix atc", "sosp", "osdi", "nsdi", "ccs", "usenix security", "oakland", "sp ", "ieee tdsc", "ieee tifs", "tkde", "tocs", "tpds", "tods", "软件学报", "计算机学报"]),
    ("B", ["www", "emnlp", "coling", "cikm", "icdm", "wsdm", "recsys", "mm ", "icassp", "icse", "fse", "ase", "icnp", "imc", "sigmod", "vldb", "pods", "iclr", "naacl", "tkde", "tmm", "tcsvt"]),
    ("C", ["icann", "iconip", "pakdd", "dasfaa", "trustcom", "icpads", "hpca", "micro", "isca"]),
]
# Patterns of research topics that are titles, projects, institutions or degrees instead.
TOPIC_META = r"(?i)(教授|副教授|讲师|助教|https?://|dblp\.)"
TOPIC_SKIP = r"(?i)(国家级|省部级|科研项目|主持人|合作者|NSFC|国家自然科学基金|重大研究计划|培育项目|课题|获批|立项|特聘|人才引进)"
TOPIC_NOISE = r"(?i)^(.*大学|.*学院|硕士研究生?|博士研究生?|.*硕士学位|.*博士学位|讲师|副教授|教授|助教|硕导|博导|硕士|博士|个人信息|成果奖励|教学招生|荣誉奖励|科研成果)$"
TOPIC_SITE = r"(大学|版权|技术支持|信箱|招生|Copyright)"
# Labels and hints that stand where papers should.
PAPER_LABELS = ["专利", "软件著作", "著作", "专利软件著作", "专利、软件著作", "软件著作专利", "科研项目", "研究项目", "待更新", "暂无", "无"]
SHOWN_LABELS = ["专利", "软件著作", "著作", "专利、软件著作", "待更新", "暂无", "无"]
PLACEHOLDERS, SHOWN_PLACEHOLDERS = ["待更新", "请见", "标签页", "没有维护", "旧版", "了解更多", "点击查看"], ["待更新", "请见", "标签页", "没有维护", "旧版"]
PAPER_LINKS = r"(?i)(没有维护|可能掺杂|请白天访问|vpn访问|个人主页|google\s*scholar|dblp|citations|semanticscholar|orcid|researchgate|@|更多|查看|主页|链接)"
SHOWN_PROFILE = r"(?i)(人才引进|特聘教授|博士生导师|实验室|主任|电话[:：]|@|特聘)"
PROFILE = r"(?i)(人才引进|特聘教授|博士生导师|硕导|博导|实验室|主任|电话[:：]|计算机科学与技术学院|软件学院|@|特聘|欢迎|访问)"
STRONG_PAPER = r"(?i)(Proceedings|Journal|Transactions|Conference|IEEE|ACM|SIG|ICDE|ACL|KDD|TKDE|EMNLP|COLING|NeurIPS|CVPR|arxiv|doi:)"
# Patterns of lines that are grants, courses, awards, services or statistics.
PAPER_NOISE = [
    r"(?i)(国家自然|自然科学基金|基金项目|面上项目|重点项目|子项目|产学研|科技支撑|科技计划|项目负责人|排名第二|招生要求|培养方向|优势条件|科研补助|青年基金|精品.*课程|操作系统原理|Linux操作系统|工程经济与|程序设计|课程实践|科技进步|二等奖|三等奖|优秀奖|指导学生|创新项目|审稿人|审稿编辑|Reviewer|Area Chair|TPC member|编委|副主编|SCI/EI收录|余篇|发明专利|授权专利|教材|学术著作|自然科学研究项目|目前主要研究方向|主要讲授的课程|Frontiers in Communication|Electronic Letters)",
    r"概论|分析与设计|测试与质量|需求工程|蓝桥杯|招生信息|优秀指导教师|发邮件时|学生具体情况|联系方式如下|本组招生|协助学生|攻读博士|不打扰学生",
    r"国际学术刊物|国际学术会议包括|包括ACM TKDD",
    r"^(?:IEEE\s*|ACM\s*)?[A-Z][A-Za-z.]{1,10}(?:\s*[,，、]\s*(?:IEEE\s*|ACM\s*)?[A-Z][A-Za-z.]{1,10})+$",
    r"的审稿人|余篇|收录论文|发表论文\d|论文\d+余",
    r"(20\d{2}\.\d{2}-20\d{2}|计\d{2}计算机|,\d{4}/\d{2},)",
    r"^(\(?\d*\)?:?\s*\d{5,8}\s*\(\d{4}\)|\d{5,8}\s*\(\d{4}\))$",
]
STRICT_NOISE = [r"(?i)(研究生称号|课程设计|指导.*获得|Program Committee|软件著作|获得教育部|主持开发|横向项目|科研鉴定|专利授权|云计算的租户|Microwave and Optical)", "研究,\\s*国家|研究，国家|方法研究,-20", "|^·"]
JOURNAL_START = r"(?i)^(?:Frontiers|Journal of|IEEE|ACM|Proceedings|Trans\.|Comput\.)"
ENDS = " 、；;，,.-"


def _contains_any(x: Column, hints: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(x, h))


def rank_hint(venue: Column | str, title: Column | str) -> Column:
    """A, B, C or '' by parts of the lower-case venue and title."""

    def rank(x: Column) -> Column:
        out = F.lit("")
        for name, hints in reversed(RANK_HINTS):
            out = F.when(_contains_any(x, hints), F.lit(name)).otherwise(out)
        return out

    return let(F.lower(F.concat(col(venue), F.lit(" "), col(title))), rank)


def comparable(x: Column) -> Column:
    """Without white space, commas as enumeration commas."""
    return F.regexp_replace(F.translate(x, "，,", "、、"), r"(?U)\s+", "")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def paper_noise(title: Column | str, name: Column | str = "", research: Column | str = "", *, strict: bool = False) -> Column:
    """Whether a line of a paper list is no paper. strict: more patterns, and journal lines only with few words."""
    name, research = (F.lit("") if x == "" else col(x) for x in (name, research)) if isinstance(name, str) and isinstance(research, str) else (col(name), col(research))

    def tags(x: Column) -> Column:
        return F.transform(F.filter(F.split(x, "[、，,;；]+"), lambda p: F.trim(p) != ""), comparable)

    def overlap(t: Column) -> Column:
        known = let(tags(research), lambda rd: let(tags(t), lambda own: (F.size(own) >= 2) & (F.size(F.filter(own, lambda p: F.array_contains(rd, p))) >= F.greatest(F.lit(2), F.floor(F.size(own) * 0.75)))))
        return F.when(research == "", F.lit(False)).otherwise(F.contains(comparable(research), comparable(t)) | known)

    def noise(t: Column) -> Column:
        out = t == ""
        for pattern in [*PAPER_NOISE, *(STRICT_NOISE if strict else [])]:
            out = out | t.rlike(pattern)
        out = out | (t.rlike(r"^[一-鿿、，；;：:\s]{4,45}研究$") & ~t.rlike("[A-Za-z]{4,}"))
        out = out | ((name != "") & F.contains(t, name) & t.rlike(r"基金|项目|,20\d{2}"))
        journal = t.rlike(JOURNAL_START) & ~F.contains(t, F.lit(":")) & (F.length(t) < 80)
        return out | overlap(t) | (journal & (_spaces(t) <= 6) if strict else journal)

    return let(squeeze(title), noise)


def displayable_paper(title: Column | str, name: Column | str = "", research: Column | str = "") -> Column:
    def shown(s: Column, raw: Column) -> Column:
        latin = raw.rlike("[A-Za-z]{4,}")
        return (
            F.when((s == "") | s.isin(*SHOWN_LABELS), F.lit(False)).when(paper_noise(raw, name, research), F.lit(False)).when(raw.rlike(SHOWN_PROFILE), F.lit(False)).when((F.length(s) < 8) & ~s.rlike("[A-Za-z]{4,}"), F.lit(False))
            .when(raw.rlike(r":\s*[A-Z][a-z]{4,}"), F.length(raw) >= 30).when(latin, (_spaces(raw) >= 2) & (F.length(raw) >= 20)).otherwise(~_contains_any(s, SHOWN_PLACEHOLDERS))
        )

    return let(col(title), lambda raw: let(strip(F.regexp_replace(raw, r"(?U)\s+", ""), ENDS), lambda s: shown(s, raw)))


def paper_label(text: Column | str) -> Column:
    """A bare label, a short text without a Latin word, or a placeholder."""
    return let(strip(F.regexp_replace(col(text), r"(?U)\s+", ""), ENDS), lambda s: (s == "") | s.isin(*PAPER_LABELS) | ((F.length(s) < 8) & ~s.rlike("[A-Za-z]{4,}")) | _contains_any(s, PLACEHOLDERS))


def clean_title(x: Column | str) -> Column:
    """Without leading numbering such as 3、 (2) [C48], and signs at the ends."""
    return strip(F.regexp_replace(squeeze(x), r"^[\(\[（【]?\s*[A-Za-z]?\d{1,3}\s*[\)\]）】]?\s*[、.、:：]?\s*", ""), ENDS)


def paper_title(title: Column | str, name: Column | str = "", research: Column | str = "") -> Column:
    """Whether a text looks like the title of a paper."""

    def like(t: Column) -> Column:
        no = (t == "") | paper_label(t) | t.rlike(PAPER_LINKS) | paper_noise(t, name, research, strict=True) | t.rlike(PROFILE) | t.rlike(r"(?i)\[at\]|@|\.edu|电话|地址|办公室|信箱")
        no = no | F.trim(t).rlike(r"^[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}$") | t.rlike("(教授|学院|实验室|主任|访问|人次|引用数|Google)")
        return F.when(no, F.lit(False)).when(t.rlike(r":\s*[A-Z][a-z]{4,}"), F.length(t) >= 30).when(t.rlike(STRONG_PAPER), F.lit(True)).when(t.rlike("[A-Za-z]{4,}"), (F.length(t) >= 20) & (_spaces(t) >= 2)).otherwise(F.length(t) >= 12)

    return let(col(title), like)


def lines_of(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(x), "[\r\n]+"), lambda s: strip(s)), lambda s: s != "")


def clean_papers(items: Column, most: int = 20) -> Column:
    """Distinct cleaned titles of six characters or more that are no labels, links or notes."""
    kept = F.filter(F.transform(items, lambda x: clean_title(x)), lambda s: (F.length(s) >= 6) & ~paper_label(s) & ~s.rlike(r"(?i)^(http://|https://|www\.)") & ~s.rlike(PAPER_LINKS))
    return F.slice(F.array_distinct(kept), 1, most)


def normal_list(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: strip(squeeze(x), ENDS)), lambda s: s != "")), 1, most)


def without_leading_labels(x: Column | str) -> Column:
    """The lines from the first one on that is no label."""

    def rest(lines: Column) -> Column:
        first = F.array_min(F.filter(F.transform(lines, lambda s, i: F.when(~paper_label(clean_title(s)), i)), lambda i: i.isNotNull()))
        return F.when(first.isNull(), F.lit("")).otherwise(F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n"))

    return let(lines_of(x), rest)


def profile_block(x: Column | str) -> Column:
    """Two or more marks of a profile in the first 500 characters."""
    head = F.substring(col(x), 1, 500)
    marks = ["人才引进", "特聘教授", "博士生导师", "实验室", "主任\n", "主任\r"]
    return let(head, lambda h: F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(h, m))) >= 2)


def placeholder_papers(x: Column | str) -> Column:
    """Whether a paper field has no credible title: fewer than two, and not one with a venue."""

    def empty(raw: Column) -> Column:
        real = F.filter(F.transform(lines_of(raw), lambda s: clean_title(s)), lambda t: paper_title(t))
        few = let(real, lambda r: ~((F.size(r) >= 2) | ((F.size(r) == 1) & F.coalesce(F.get(r, F.lit(0)).rlike(STRONG_PAPER), F.lit(False)))))
        profile = raw.rlike(PROFILE) & ~raw.rlike("(?i)(Proceedings|Conference|Journal|IEEE|ACM|SIG|ICDE|ACL|KDD|TKDE|arxiv)")
        return F.when(paper_label(raw) | profile, F.lit(True)).otherwise(few)

    return let(strip(x), empty)


def suspicious_papers(text: Column | str, name: Column | str = "", research: Column | str = "") -> Column:
    """Whether a paper field should be screened: half noise, few and short lines, or venues alone."""

    def odd(lines: Column) -> Column:
        n = F.size(lines)
        noise = F.size(F.filter(lines, lambda s: paper_noise(s, name, research, strict=True)))
        short = (n <= 4) & (F.array_max(F.transform(lines, lambda s: F.length(s))) < 45)
        return F.when(n == 0, F.lit(False)).otherwise((noise >= F.greatest(F.lit(1), F.floor(n / 2))) | short | F.forall(lines, lambda s: F.length(s) < 20) | F.forall(lines, lambda s: s.rlike(r"^[A-Za-z][A-Za-z0-9 .\-]{1,14}$")))

    return let(lines_of(text), odd)


def topic_noise(tag: Column, name: Column | str = "", department: Column | str = "") -> Column:
    """Whether a research topic is a name, an institution, a degree, or a part of the department's name."""
    name = F.lit("") if isinstance(name, str) and name == "" else col(name)
    department = F.lit("") if isinstance(department, str) and department == "" else col(department)

    def noise(t: Column) -> Column:
        bare, own = F.replace(t, F.lit(" "), F.lit("")), F.replace(name, F.lit(" "), F.lit(""))
        named = (own != "") & ((t == name) | (bare == own) | (F.contains(bare, own) & (F.length(t) <= F.length(name) + 6)))
        return (F.length(t) < 2) | named | t.rlike(TOPIC_NOISE) | (t.rlike(TOPIC_SITE) & (F.length(t) <= 16)) | ((department != "") & F.contains(department, t))

    return let(squeeze(tag), noise)


def research_topics(text: Column | str, most_chars: int = 140, name: Column | str = "", department: Column | str = "", cuts: tuple[str, ...] = ("http://", "https://", "dblp.")) -> Column:
    """The topics of a research field, joined: numbering and brackets undone, links, titles and noise left out."""

    def line_topics(line: Column) -> Column:
        line = F.regexp_replace(line, r"^[\d一二三四五六七八九十]+[\.、．:：]\s*", "")
        line = F.regexp_replace(line, r"^[（(]\d+[）)]\s*", "")
        line = F.regexp_replace(F.regexp_replace(line, r"(?U)[（(]\s*[）)]", ""), r"[（(]([^（）()]*)[）)]", "、$1")
        parts = F.transform(F.split(F.regexp_replace(line, "[（()）]", "、"), "[;；、,/|]+"), lambda p: strip(squeeze(p), " ：:-.等。"))
        return F.filter(parts, lambda s: (F.length(s) >= 2) & ~s.rlike(TOPIC_META) & ~s.rlike(TOPIC_SKIP) & ~topic_noise(s, name, department))

    def joined(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\(\s*[\r\n]+\s*", "("), r"[\r\n]+\s*\)", ")")
        lines = F.filter(lines_of(x), lambda s: ~s.rlike(TOPIC_META) & ~s.rlike(TOPIC_SKIP))
        return F.substring(F.array_join(F.slice(F.array_distinct(F.flatten(F.transform(lines, line_topics))), 1, 10), "、"), 1, most_chars)

    def cut(x: Column) -> Column:
        return F.substring(x, F.lit(1), F.length(cut_at(F.lower(x), cuts)))

    return let(let(col(text), cut), joined)


def research_tags(text: Column | str, most: int = 8, name: Column | str = "", department: Column | str = "") -> Column:
    parts = F.transform(F.split(research_topics(text, 200, name, department), "[、；;，,/|]+"), lambda p: strip(squeeze(p), " ：:-"))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: F.length(s) >= 2)), 1, most)


# What leads to a research topic in running text, in order; words that show it's something else.
RESEARCH_LEADS = ["主要研究方向", "研究方向", "主要研究领域", "研究领域", "主要研究兴趣", "研究兴趣", "主要兴趣与研究领域", "主要从事", "长期从事", "目前从事", "致力于", "专注于"]
RESEARCH_NOISE = "(教学|课程|邮件|联系|报考|招生|同学|至今|主页|欢迎|发表)"
RESEARCH_MARKERS = ["研究方向包括：", "研究方向包括", "研究方向为", "研究方向：", "研究方向:", "主要研究方向", "主要研究领域", "研究领域：", "研究领域:", "研究领域", "主要研究兴趣", "研究兴趣是", "研究兴趣：", "研究兴趣:", "研究兴趣", "目前主要从事", "主要从事", "致力于", "专注于", "Research Area", "Research Interests", "Research Interest"]
RESEARCH_GARBAGE = r"(?i)^(Publications|Research|To|研究兴趣|研究兴趣、To)$|习题课|周一\d|的同学邮件|Welcome to|Homepage"


def _first(candidates: Column) -> Column:
    return F.coalesce(F.get(F.filter(candidates, lambda s: s.isNotNull() & (s != "")), F.lit(0)), F.lit(""))


def _after(text: Column, marker: Column) -> Column:
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + F.length(marker), F.length(text)))


def research_from_intro(intro: Column | str) -> Column:
    """The clause after the first lead of a running text that has a plausible one, or ''."""

    def clause(tail: Column) -> Column:
        tail = F.regexp_replace(tail, r"^[为是：:，,的有]*(包括|涉及|集中在|主要为|主要是|聚焦于)?[为是：:，,的有\s]*", "")
        seg = strip(F.get(F.split(tail, "[。\n；;！!]", 2), F.lit(0)), " 、,，.;:：-")
        seg = strip(F.regexp_replace(seg, "等(方面)?(的)?(研究|工作)?$", ""), " 、,，.;:：-")
        fit = lambda s: F.length(s).between(2, 80) & ~looks_incomplete(s) & ~s.rlike(RESEARCH_NOISE) & (s.rlike(r"[一-鿿]") | (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 4))
        return let(seg, lambda s: F.when(fit(s), s))

    leads = F.array(*map(F.lit, RESEARCH_LEADS))
    text = F.regexp_replace(col(intro), "[ 　\t ]+", " ")
    return let(text, lambda x: _first(F.transform(F.filter(leads, lambda m: F.contains(x, m)), lambda m: clause(_after(x, m)))))


def valid_research(x: Column) -> Column:
    return (F.length(x) >= 4) & ~x.rlike(RESEARCH_GARBAGE) & ~((F.length(x) > 80) & ~x.rlike("[、，]"))


def research_from_numbered(text: Column) -> Column:
    """The items of a numbered list of two or more, links left out."""
    items = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\n)\s*\d+[\.、．]\s*([^\n]{2,40})"), F.lit(1)), lambda s: strip(s)), lambda s: ~s.rlike(r"(?i)http|dblp|\.html"))
    return let(items, lambda i: F.when(F.size(i) >= 2, research_topics(F.array_join(i, "、"), 120)).otherwise(""))


def research_from_text(section: Column | str, intro: Column | str, full: Column | str) -> Column:
    """A research field from, in this order: its section, the clauses after markers, numbered lists after them, the introduction, the text's beginning."""
    ok = lambda x: F.when(valid_research(x), x)

    def from_full(text: Column) -> Column:
        seg = lambda tail: F.get(F.split(F.regexp_replace(tail, r"^[为是：:\s，,]+", ""), "[。\n；;！!]", 2), F.lit(0))
        by_marker = F.transform(F.filter(F.array(*map(F.lit, RESEARCH_MARKERS)), lambda m: F.contains(text, m)), lambda m: let(research_topics(seg(_after(text, m)), 120), ok))
        heads = F.filter(F.array(*map(F.lit, ["研究方向", "研究领域", "Research Area", "Research"])), lambda m: F.contains(text, m))
        by_list = F.transform(heads, lambda m: let(research_from_numbered(F.substring(text, F.instr(text, m), F.lit(900))), ok))
        rest = [let(research_topics(research_from_intro(x), 120), ok) for x in (col(intro), F.substring(text, 1, 4000))]
        return _first(F.concat(by_marker, by_list, F.array(*rest)))

    own = research_topics(section, 120)
    return let(own, lambda s: F.when(s != "", s).otherwise(let(col(full), lambda t: F.when(t == "", F.lit("")).otherwise(from_full(t)))))


# Where a page's list of papers begins; marks of texts that are no titles; shapes of titles in running text.
PAPER_MARKERS = ["代表论文", "发表论文", "期刊论文", "会议论文", "论文成果", "学术论文", "论著", "主要论文", "Selected Publications", "Publications"]
PAPER_GARBAGE = "(?i)(委员|学会|委员会|奖学金|奖项|Award|Prize|Homepage|Welcome|科研项目|基金项目|指导学生|培养方向|招生要求|旧版|科研成果)"
TITLE_GARBAGE = r"(?i)^(本科|博士|硕士|主要研究|研究方向|软件工程，|语言多模态|\d{4}-\d{4}|CCF-)|二等奖|三等奖|优秀奖|发表论文\d|年度.*奖|编辑\(|Chair|TPC|编委|副主编|Publicity Chair|Distinguished"
_NAME = r"[A-Z][A-Za-z0-9 ,\-'\"&:+/]{12,220}?"
TITLE_SHAPES = [
    rf"({_NAME})\s*[\[（(]\s*[CJ]\s*[\]）)]",
    rf"({_NAME})\s*\.\s*(?:IEEE|ACM)\s+[A-Za-z][A-Za-z ]+",
    rf"({_NAME})\.\s*(?:In\s+)?(?:Proc\.?\s+of\s+)?(?:the\s+)?(?:IEEE|ACM|International)",
    rf"\d+[\.、．]\s*(?:[A-Za-z ,.*\n]{{0,140}}?\.\s*)?({_NAME})\s*\.\s*(?:IEEE|ACM|MobiSys|UbiComp|INFOCOM|Proceedings|Journal|Trans)",
]
MARKED_TITLE = r"([A-Za-z][A-Za-z0-9 ,\-'\"&:+/]{14,220}?)\s*[\[（(]\s*[CJ]\s*[\]）)]"


def papers_after_markers(text: Column | str, most: int = 12) -> Column:
    """The titles after the first marker of a page's text that has any within 6000 characters."""

    def titles(x: Column, marker: Column) -> Column:
        chunk = F.substring(_after(x, marker), 1, 6000)
        return F.slice(F.array_distinct(F.filter(F.transform(F.split(chunk, "\r\n|[\n\r]"), lambda s: clean_title(s)), lambda t: paper_title(t))), 1, most)

    empty = F.array().cast("array<string>")
    found = lambda x: F.filter(F.transform(F.filter(F.array(*map(F.lit, PAPER_MARKERS)), lambda m: F.contains(x, m)), lambda m: titles(x, m)), lambda a: F.size(a) > 0)
    return let(col(text), lambda x: F.coalesce(F.get(found(x), F.lit(0)), empty))


def valid_title(title: Column, source: Column | str = "") -> Column:
    """A title that is long, or that its source has before a venue."""
    source = F.lit("") if isinstance(source, str) and source == "" else col(source)

    def valid(t: Column) -> Column:
        bare = F.replace(t, F.lit(" "), F.lit(""))
        no = ~paper_title(t) | t.rlike(PAPER_GARBAGE) | (bare.rlike(r"^[A-Z][A-Z.、, /]{4,80}$") & (_spaces(t) < 2)) | bare.rlike("^[A-Z]{2,}([、,][A-Z]{2,}){2,}$") | t.rlike(TITLE_GARBAGE)
        no = no | (t.rlike(r"^[A-Za-z ,.\n]+$") & (F.length(F.regexp_replace(t, "[^,]", "")) >= 3) & (F.length(t) < 80)) | ((_spaces(t) < 2) & (F.length(t) < 30))
        around = F.substring(source, F.instr(source, t), F.length(t) + 80)
        yes = (F.contains(source, t) & around.rlike(r"(?i)\[[CJ]\]|IEEE|ACM|Proceedings|Transactions")) | ((F.length(t) >= 25) & (_spaces(t) >= 3)) | t.rlike(r"(?i)\[[CJ]\]|IEEE|ACM|Proceedings|SIG|ICDE|ACL|KDD")
        return ~no & yes

    return let(title, valid)


def marked_titles(text: Column, most: int = 12) -> Column:
    """Titles before [C] or [J]: the last sentence of what stands there."""

    def last(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\."), lambda p: strip(p)), lambda p: F.length(p) > 12)
        return F.when(F.contains(t, F.lit(".")), F.coalesce(F.try_element_at(parts, F.lit(-1)), t)).otherwise(t)

    found = F.transform(F.regexp_extract_all(text, F.lit(MARKED_TITLE), F.lit(1)), lambda t: last(clean_title(t)))
    return F.slice(distinct_by(F.filter(found, lambda t: valid_title(t, text)), F.lower), 1, most)


def papers_of_block(block: Column | str, most: int = 12) -> Column:
    """Titles of a block of text, by the first way that gives two: marked ones, lines, shapes in running text; else what lines or shapes give."""

    def shaped(flat: Column, text: Column) -> Column:
        tail = lambda t: F.when(F.length(F.regexp_replace(t, r"[^.]", "")) >= 2, let(strip(F.element_at(F.split(t, r"\."), -1)), lambda e: F.when(F.length(e) > 15, e).otherwise(t))).otherwise(t)
        tried = [distinct_by(F.filter(F.transform(F.regexp_extract_all(flat, F.lit(p), F.lit(1)), lambda t: tail(clean_title(t))), lambda t: valid_title(t, text)), F.lower) for p in TITLE_SHAPES]
        return F.array(*tried)

    def choose(text: Column) -> Column:
        lines = distinct_by(F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda s: clean_title(s)), lambda t: valid_title(t, text)), F.lower)
        ways = F.concat(F.array(marked_titles(text, most), lines), shaped(F.regexp_replace(text, r"(?U)\s+", " "), text))
        two = lambda w: F.get(F.filter(w, lambda a: F.size(a) >= 2), F.lit(0))
        one = lambda w: F.get(F.filter(F.slice(w, 2, 10), lambda a: F.size(a) > 0), F.lit(0))
        return let(ways, lambda w: F.slice(F.coalesce(two(w), one(w), F.array().cast("array<string>")), 1, most))

    cleaned = without_leading_labels(F.replace(F.replace(col(block), F.lit("软件著作\n专利"), F.lit("")), F.lit("专利\n软件著作"), F.lit("")))
    return let(cleaned, lambda t: F.when((t == "") | paper_label(t), F.array().cast("array<string>")).otherwise(choose(t)))


def source_score(text: Column | str, found: Column) -> Column:
    """How much a block of text looks like a list of papers; found: the titles that it gives."""
    x = col(text)
    marks = [(r"\[[CJ]\]", 50), ("(?i)IEEE|ACM|Proceedings|Transactions", 30), (r"[A-Z][a-z]{4,}.{10,}\.\s*(?:IEEE|ACM)", 20)]
    score = sum((F.when(x.rlike(p), points).otherwise(0) for p, points in marks), F.size(found) * 5)
    return F.when((x == "") | strip(x).isin("软件著作\n专利", "专利\n软件著作", "专利", "软件著作"), 0).otherwise(score)


def paper_meta(title: Column, source: Column | str) -> Column:
    """struct<title, venue, year, ccf_rank> of a title, from the 400 characters of its source that follow its beginning."""
    venues = r"(?i)(IEEE/ACM [A-Za-z ]+|IEEE Transactions [A-Za-z ]+|ACM [A-Z][A-Za-z+ ]+|Proceedings of [A-Za-z ]+|SIG[A-Z]{2,}|INFOCOM|ICDE|ACL|KDD|NeurIPS|CVPR|WWW|MobiSys|UbiComp)"

    def meta(flat: Column) -> Column:
        chunk = F.substring(flat, F.greatest(F.instr(flat, F.substring(title, 1, 30)), F.lit(1)), F.lit(400))
        parts = lambda c: F.struct(title.alias("title"), F.substring(F.trim(F.regexp_extract(c, venues, 1)), 1, 60).alias("venue"), F.regexp_extract(c, r"(20\d{2}|19\d{2})", 1).alias("year"), F.upper(F.regexp_extract(c, r"(?i)CCF[-\s]?([ABC])", 1)).alias("ccf_rank"))
        return let(chunk, parts)

    return let(F.regexp_replace(col(source), r"(?U)\s+", " "), meta)


def display_title(title: Column | str, venue: Column | str, year: Column | str) -> Column:
    """The title, or the venue and year where it is short."""
    named = F.when(squeeze(venue) == "", F.lit("")).when(col(year) == "", squeeze(venue)).otherwise(F.concat(squeeze(venue), F.lit(" ("), col(year), F.lit(")")))
    return let(clean_title(title), lambda t: F.when(F.length(t) >= 6, t).otherwise(named))


