"""Queries of normalising, tokenising, cleaning and masking, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import papers as P
from quernstone.functions import query as Q
from quernstone.functions import text as T
from quernstone.functions.dictionaries import ABBREVIATIONS, PHRASES
from quernstone.operators import grams
from quernstone.operators.tables import small
from quernstone.plans import fixtures as X
from quernstone.plans.retrieval import _GRAMS, _NORM, _WS, stored_grams, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_quote, xs)) + "]"


def _trim(x: str, inside: str = _WS) -> str:
    return f"regexp_replace({x}, '^{inside}+|{inside}+$', '', 'g')"


_T, _Q = X.values(X.TEXTS, X.TEXT), X.values(X.QUERIES, X.QUERY)
_LINES, _MASK = X.values(X.LINES, X.TEXT), X.values(X.MASK, X.TEXT)


def _texts(spark, rows=X.TEXTS) -> DataFrame:
    return X.frame(spark, rows, X.TEXT)


#: Nine letters that are written as Han characters where a query needs such text; the tables have none.
_HAN = ("etaoinsrh", "自然语言处理机器")


def _han(x: str) -> str:
    return f"translate({x}, '{_HAN[0]}', '{_HAN[1]}')"


def _digest(x) -> Column:
    return F.md5(x.cast("binary"))


def _member(key: str, xs) -> Column:
    """One of the texts, by a number."""
    return F.element_at(F.array(*map(F.lit, xs)), (F.col(key) % len(xs) + 1).cast("int"))


def _member_sql(key: str, xs) -> str:
    return f"{_list(xs)}[{key} % {len(xs)} + 1]"


def _said(spark, sf_dir) -> DataFrame:
    """(id, text) of every turn of the conversations."""
    return table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


_SAID = "SELECT 1000 + conv_id * 1000 + turn AS id, text FROM conversations"


@query("SELECT doc_id, len(x) AS n, md5(array_to_string(x, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS x FROM documents)")
def tokenize_latin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("x"))
    return docs.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", " ").cast("binary")).alias("tokens"))


@query(f"SELECT id, array_to_string(list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), {_GRAMS.format("coalesce(text, '')")}), ' ') AS tokens FROM {_T} UNION ALL SELECT 1000 + doc_id, md5(array_to_string(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), {_GRAMS.format("text")}), ' ')) FROM (SELECT doc_id, {_han("coalesce(text, '')")} AS text FROM documents)")
def tokenize_cjk(spark, sf_dir):
    """Words, characters and pairs of characters of all documents, in which nine letters are Han characters, and of the fixture's texts."""
    docs = table(spark, sf_dir, "documents").select((1000 + F.col("doc_id")).alias("id"), F.translate("text", *_HAN).alias("text"))
    return _texts(spark).select("id", F.array_join(T.tokens("text"), " ").alias("tokens")).union(docs.select("id", _digest(F.array_join(T.tokens("text"), " "))))


_PIECES = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda b: list_transform(range(1, length(b) + 1, 2), lambda i: substring(b, i, 2)))))"


@query(f"""WITH t AS (SELECT id, text FROM {_T} UNION ALL SELECT id, {_han('text')} FROM ({_SAID})),
p AS (SELECT id, t, min(n) AS n FROM (SELECT id, unnest(p) AS t, unnest(range(len(p))) AS n FROM (SELECT id, {_PIECES.format("coalesce(text, '')")} AS p FROM t)) GROUP BY id, t)
SELECT t.id, md5(coalesce(string_agg(p.t, ' ' ORDER BY n), '')) AS terms FROM t LEFT JOIN p ON p.id = t.id GROUP BY t.id""")
def relax_terms(spark, sf_dir):
    said = _said(spark, sf_dir).withColumn("text", F.translate("text", *_HAN))
    return _texts(spark).union(said).select("id", _digest(F.array_join(T.relax_terms("text"), " ")).alias("terms"))


@query(f"SELECT id, {_NORM.format("coalesce(text, '')")} AS norm FROM {_T} UNION ALL SELECT doc_id, md5({_NORM.format("coalesce(text, '')")}) FROM documents")
def normalize_text(spark, sf_dir):
    own = _texts(spark).select("id", T.normalize_text("text").alias("norm"))
    return own.union(table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text("text").cast("binary"))))


_NORMAL_QUERY = _trim(f"regexp_replace(regexp_replace({_trim("coalesce(raw, '')")}, '[-_/]+', ' ', 'g'), '{_WS}+', ' ', 'g')")


@query(f"SELECT query_id, {_NORMAL_QUERY} AS query FROM (SELECT * FROM {_Q} UNION ALL SELECT 1000 + page_id, ' ' || url || chr(10) FROM pages UNION ALL SELECT -id, text FROM ({_SAID}))")
def normalize_query(spark, sf_dir):
    """The fixture's queries, addresses of all pages, and all that is said in conversations."""
    pages = table(spark, sf_dir, "pages").select(1000 + F.col("page_id"), F.concat(F.lit(" "), "url", F.lit("\n")))
    asked = X.frame(spark, X.QUERIES, X.QUERY).union(pages).union(_said(spark, sf_dir).select(-F.col("id"), "text"))
    return asked.select("query_id", T.normalize_query("raw").alias("query"))


_STARTS = [*[x for p, _ in T.FIELD_PREFIXES for x in (p, f" {p.upper()} ", p[:-1])], "", "x "]
_PREFIX = " ".join(f"WHEN starts_with(lower(r), {_quote(p.lower())}) THEN {{{i}}}" for i, (p, _) in enumerate(T.FIELD_PREFIXES))
_FIELD = "CASE " + _PREFIX.format(*[_quote(n) for _, n in T.FIELD_PREFIXES]) + " END"
_REST = "CASE " + _PREFIX.format(*[_trim(f"substring(r, {len(p) + 1})") for p, _ in T.FIELD_PREFIXES]) + " ELSE r END"


@query(f"SELECT query_id, {_REST} AS query, {_FIELD} AS field FROM (SELECT query_id, {_trim("coalesce(raw, '')")} AS r FROM (SELECT * FROM {_Q} UNION ALL SELECT 1000 + c_custkey, {_member_sql('c_custkey', _STARTS)} || c_name || ' ' FROM customer))")
def strip_field_prefix(spark, sf_dir):
    """The fixture's queries, and names of all customers after something that is, or is almost, a prefix."""
    named = table(spark, sf_dir, "customer").select(1000 + F.col("c_custkey"), F.concat(_member("c_custkey", _STARTS), "c_name", F.lit(" ")))
    return X.frame(spark, X.QUERIES, X.QUERY).union(named).select("query_id", T.field_prefix(T.strip("raw")).alias("p")).select("query_id", "p.query", "p.field")


_SUFFIXED = [(1, "自然语言处理方向"), (2, "机器学习研究方向"), (3, "方向"), (4, "a方向"), (5, "图像技术应用"), (6, "plain"), (7, "x y 相关技术"), (8, "")]
_LONGEST = sorted(T.NAVIGATION_SUFFIXES, key=len, reverse=True)
_CORE = "coalesce(" + ", ".join(f"CASE WHEN ends_with(text, {_quote(s)}) AND length(text) > {len(s) + 1} AND length({_trim(f'left(text, length(text) - {len(s)})')}) >= 2 THEN {_trim(f'left(text, length(text) - {len(s)})')} END" for s in _LONGEST) + ")"


_ENDS = ["", *T.NAVIGATION_SUFFIXES, " " + T.NAVIGATION_SUFFIXES[0], T.NAVIGATION_SUFFIXES[-1] * 2]


@query(f"SELECT id, {_CORE} AS core FROM (SELECT * FROM {X.values(_SUFFIXED, X.TEXT)} UNION ALL SELECT 1000 + p_partkey, CASE WHEN p_partkey % 7 = 0 THEN left(p_name, 1) ELSE p_name END || {_member_sql('p_partkey', _ENDS)} FROM part)")
def strip_nav_suffix(spark, sf_dir):
    """The fixture's texts, and names of all parts, some of one letter, before each of the words that are taken off."""
    named = table(spark, sf_dir, "part").select(1000 + F.col("p_partkey"), F.concat(F.when(F.col("p_partkey") % 7 == 0, F.left("p_name", F.lit(1))).otherwise(F.col("p_name")), _member("p_partkey", _ENDS)))
    return _texts(spark, _SUFFIXED).union(named).select("id", T.strip_navigation("text").alias("core"))


_RULES = "(VALUES " + ", ".join(f"({i}, {_quote(p)}, {_list(a)})" for i, (p, a) in enumerate(PHRASES)) + ") rules(n, pattern, aliases)"
_ABBR = "(VALUES " + ", ".join(f"({_quote(k)}, {_list(a)})" for k, a in ABBREVIATIONS) + ") abbr(k, aliases)"
_ASKED = [(1, "NLP"), (2, "deep reinforcement learning"), (3, "机器学习方向"), (4, "5G or AI"), (5, ""), (6, "graph-neural networks"), (7, "event extraction nlp"), (8, "plain words"), (9, "CV 研究"), (10, "NLP nlp")]


_WORDS = [k for k, _ in ABBREVIATIONS] + ["", "machine learning", "knowledge graph 方向", "deep-learning"]
#: (id, text) of queries: the fixture's, all benchmark items, and names of all parts beside a word of the dictionaries.
_WIDENED = f"(SELECT * FROM {X.values(_ASKED, X.TEXT)} UNION ALL SELECT 1000 + p_partkey, p_name || ' ' || {_member_sql('p_partkey', _WORDS)} FROM part UNION ALL SELECT -1 - item_id, text FROM benchmark)"


def _widened(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(1000 + F.col("p_partkey"), F.concat("p_name", F.lit(" "), _member("p_partkey", _WORDS)))
    return _texts(spark, _ASKED).union(parts).union(table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id"), "text"))


#: f(id, p, r): the phrases of the queries of `asked`, in order.
_PHRASES = f"""q AS (SELECT id, {_NORMAL_QUERY.replace('raw', 'text')} AS text FROM {{asked}}),
c AS (SELECT id, n, m, unnest(aliases) AS p, unnest(range(len(aliases))) AS k FROM (SELECT id, 1 AS n, n AS m, aliases FROM q JOIN {_RULES} ON regexp_matches(lower(q.text), pattern)
  UNION ALL SELECT id, 2, i, aliases FROM (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT id, regexp_extract_all(text, '[a-zA-Z0-9]+') AS w FROM q)) JOIN {_ABBR} ON k = lower(word)
  UNION ALL SELECT id, 3, 0, [core] FROM (SELECT id, {_CORE} AS core FROM q) WHERE core IS NOT NULL UNION ALL SELECT id, 4, 0, [text] FROM q WHERE text <> '')),
o AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY n, m, k) AS r, {_NORM.format('p')} AS key FROM c),
f AS (SELECT * FROM o WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY r) = 1)"""


@query(f"WITH {_PHRASES.replace('{asked}', _WIDENED)} SELECT q.id, coalesce(string_agg(p, '|' ORDER BY r), '') AS phrases FROM q LEFT JOIN f USING (id) GROUP BY q.id")
def expand_query(spark, sf_dir):
    return _widened(spark, sf_dir).select("id", F.array_join(Q.query_plan("text")["phrases"], "|").alias("phrases"))


def _cleaned(text: str) -> str:
    lines = f"list_transform(string_split_regex({text}, '\\r\\n|[\\n\\r]'), lambda s: {_trim('s')})"
    keep = f"s <> '' AND NOT list_contains({_list(T.NAVIGATION_LINES)}, s) AND NOT regexp_matches(s, '^[0-9]{{1,6}}$') AND NOT (length(s) <= 12 AND regexp_matches(s, '[：:]$')) AND NOT starts_with(s, '姓名:') AND NOT starts_with(s, '页面标题:')"
    return f"list_filter({lines}, lambda s: {keep})"


_BODY = "CASE WHEN regexp_matches(coalesce(text, ''), '\\n-{3,}\\n') THEN regexp_replace(text, '(?s)^.*?\\n-{3,}\\n', '') ELSE coalesce(text, '') END"


@query(f"WITH s AS (SELECT id, text FROM {_LINES} UNION ALL SELECT doc_id + 1000, text FROM documents), k AS (SELECT id, {_cleaned(_BODY)} AS l FROM s) SELECT id, md5(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10))) AS body FROM k")
def clean_corpus_lines(spark, sf_dir):
    rows = _texts(spark, X.LINES).union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))
    return rows.select("id", F.md5(T.clean_corpus_text("text").cast("binary")).alias("body"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '***@***', 'g')) AS masked FROM documents")
def mask_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask_emails("text").cast("binary")).alias("masked"))


# what may stand around a number is captured and put back, and as a number's end may be the next one's head, twice
_HEADED = r"(^|[^\d#-])(?:1[3-9]\d{9}|0\d{2,3}[-\s]?\d{7,8}|\d{3,4}[-\s]\d{7,8})($|\D)"
_MAILS = "regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '***@***', 'g')"
_MASKED = f"regexp_replace(regexp_replace({_MAILS}, '{_HEADED}', '\\1***\\2', 'g'), '{_HEADED}', '\\1***\\2', 'g')"


@query(f"SELECT id, {_MASKED} AS masked FROM {_MASK} UNION ALL SELECT 1000 + doc_id, md5({_MASKED}) FROM documents")
def mask_phone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(1000 + F.col("doc_id"), F.md5(T.mask_private("text").cast("binary")))
    return _texts(spark, X.MASK).select("id", T.mask_private("text").alias("masked")).union(docs)


_URL = "CASE WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/') THEN 'https://base.example' || u ELSE u END"
_URL_OUT = f"lower(regexp_replace(regexp_replace({_URL}, '(?s)[?#].*$', ''), '/+$', ''))"


@query(f"SELECT page_id, {_URL_OUT} AS normal FROM (SELECT page_id, {_trim("coalesce(url, '')")} AS u FROM pages) UNION ALL SELECT -1 - n, {_URL_OUT} FROM (VALUES (1, '//a.B/c/?q'), (2, '/p/Q#r'), (3, ' http://x.y/ '), (4, '')) v(n, u0), LATERAL (SELECT trim(u0) AS u)")
def normalize_url(spark, sf_dir):
    own = spark.createDataFrame([(-2, "//a.B/c/?q"), (-3, "/p/Q#r"), (-4, " http://x.y/ "), (-5, "")], "page_id long, url string")
    return table(spark, sf_dir, "pages").select("page_id", "url").union(own).select("page_id", T.normalize_url("url", "https://base.example").alias("normal"))


@query(r"SELECT page_id, contains(h, 'example.org') AND (regexp_matches(p, '\.html?$') OR regexp_matches(p, '^/[0-9A-Za-z_-]+/?$')) AS allowed, substring(regexp_replace(regexp_replace(p0, '^/+|/+$', '', 'g'), '[^0-9A-Za-z_]+', '_', 'g'), 1, 80) AS slug FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)([^?#]*)', 2) AS p, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p0 FROM pages)")
def allowed_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.allowed_url("url", ["example.org"]).alias("allowed"), T.slug("url").alias("slug"))


_VALUES = [(1, "研究方向："), (2, "个人简介"), (3, "简介。"), (4, "机器学习"), (5, "a"), (6, ""), (7, "我的研究兴趣包括:"), (8, "ab"), (9, None), (10, "  研究领域: ")]


@query(f"SELECT id, s = '' OR regexp_matches(s, '[：:]$') OR list_contains({_list(T.INCOMPLETE)}, c) OR length(c) < 2 AS incomplete FROM (SELECT id, s, {_trim("regexp_replace(s, '[：: 。.]+$', '')")} AS c FROM (SELECT id, {_trim("coalesce(text, '')")} AS s FROM (SELECT * FROM {X.values(_VALUES, X.TEXT)} UNION ALL SELECT 1000 + p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '：' WHEN 1 THEN left(p_name, 1) || '。' WHEN 2 THEN p_type WHEN 3 THEN '' WHEN 4 THEN ' ' || {_member_sql('p_partkey', T.INCOMPLETE)} || ' 。' ELSE {_member_sql('p_partkey', T.INCOMPLETE)} || p_name END FROM part)))")
def looks_incomplete(spark, sf_dir):
    """The fixture's values, and those of all parts: names, types, labels, and pieces of them."""
    label, kind = _member("p_partkey", T.INCOMPLETE), F.col("p_partkey") % 6
    made = F.when(kind == 0, F.concat("p_name", F.lit("："))).when(kind == 1, F.concat(F.left("p_name", F.lit(1)), F.lit("。"))).when(kind == 2, F.col("p_type")).when(kind == 3, F.lit("")).when(kind == 4, F.concat(F.lit(" "), label, F.lit(" 。"))).otherwise(F.concat(label, "p_name"))
    return _texts(spark, _VALUES).union(table(spark, sf_dir, "part").select(1000 + F.col("p_partkey"), made)).select("id", T.looks_incomplete("text").alias("incomplete"))


_FIELDS = [(1, "研究 机器学习。 联系方式 x"), (2, "  、a b  c,"), (3, "长" * 190), (4, "联系方式 first"), (5, ""), (6, "text Copyright 2020 招生信息"), (7, "研究方向: 翻译 与 理解 主持 项目")]
_CUT = lambda x, ms: f"left({x}, coalesce(list_min(list_filter(list_transform({_list(ms)}, lambda m: instr({x}, m)), lambda i: i > 1)), length({x}) + 1) - 1)"
_IN = lambda chars: "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in chars) + "]"
_FIELD_TRIMMED = _trim(f"regexp_replace({_CUT('text', T.BOILERPLATE)}, '{_WS}+', ' ', 'g')", _IN(T.FIELD_ENDS))


_MARKS = [*T.BOILERPLATE, *T.FOOTERS, ""]
_MARKED = f"(SELECT * FROM {X.values(_FIELDS, X.TEXT)} UNION ALL SELECT 1000 + doc_id, coalesce(text, '') || {_member_sql('doc_id', _MARKS)} || ' ,tail' FROM documents)"


@query(f"SELECT id, md5(CASE WHEN length(f) > 180 THEN regexp_replace(left(f, 180), '{_WS}+$', '') || '…' ELSE f END) AS field, md5({_CUT('text', T.FOOTERS)}) AS body FROM (SELECT id, text, {_FIELD_TRIMMED} AS f FROM {_MARKED})")
def clean_field(spark, sf_dir):
    """The fixture's fields, and all documents with each of the markers at which fields and bodies are cut."""
    docs = table(spark, sf_dir, "documents").select(1000 + F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), _member("doc_id", _MARKS), F.lit(" ,tail")))
    return _texts(spark, _FIELDS).union(docs).select("id", _digest(T.clean_field("text", 180, True)).alias("field"), _digest(T.trim_footer("text")).alias("body"))


@query(f"""WITH p AS (SELECT item_id, {_NORM.format("text")} AS needle, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM benchmark),
h AS (SELECT item_id, doc_id, text, terms FROM documents JOIN p ON needle <> '' AND contains({_NORM.format("coalesce(text, '')")}, needle)),
f AS (SELECT item_id, doc_id, text, list_filter(list_transform(terms, lambda x: instr(text, x)), lambda i: i > 0)[1] - 1 AS pos FROM h)
SELECT item_id, doc_id, left(CASE WHEN pos IS NULL THEN trim(replace(left(text, 120), chr(10), ' ')) ELSE trim(replace(substring(text, greatest(pos - 40, 0) + 1, pos + 40 - greatest(pos - 40, 0)), chr(10), ' ')) END, 120) AS snippet FROM f""")
def snippet(spark, sf_dir):
    """The surroundings of the first of an item's words that a document has, for every document that holds the item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.normalize_text("text").alias("needle"), T.tokens("text").alias("terms")).where("needle <> ''")
    hits = grams.look_up(stored_grams(spark, sf_dir), items).join(small(items), "needle")
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("item_id", "doc_id", T.snippet("text", F.col("terms")).alias("snippet"))


_PAIRS = [(1, "NLP 机器学习", "自然语言处理 machine learning nlp"), (2, "机器学习 机器", "机器学习与图像"), (3, "abc abcd", "xx abcd"), (4, "", "x"), (5, "plain text", "nothing")]


_PAIR = f"(SELECT * FROM {X.values(_PAIRS, 'id long, text string, hay string')} UNION ALL SELECT 1000 + p_partkey, p_name || ' ' || {_member_sql('p_partkey', _WORDS)}, p_type || ' old ' || p_name || ' 自然语言处理 graph learning' FROM part)"


@query(f"""WITH {_PHRASES.replace('{asked}', _PAIR)},
t AS (SELECT id, x, 2 AS n, r, k FROM (SELECT id, r, unnest(p) AS x, unnest(range(len(p))) AS k FROM (SELECT id, r, {_PIECES.format('p')} AS p FROM f)) QUALIFY row_number() OVER (PARTITION BY id, {_NORM.format('x')} ORDER BY r, k) = 1),
w AS (SELECT * FROM (SELECT id, p AS x, 1 AS n, r, 0 AS k FROM f UNION ALL FROM t) QUALIFY row_number() OVER (PARTITION BY id, x ORDER BY n, r, k) = 1),
m AS (SELECT w.*, row_number() OVER (PARTITION BY w.id ORDER BY length(x) DESC, n, r, k) AS i FROM w JOIN {_PAIR} h ON h.id = w.id AND contains({_NORM.format('h.hay')}, {_NORM.format('x')})),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.id = m.id AND y.x <> m.x AND contains(y.x, m.x)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 5)
SELECT q.id, coalesce(string_agg(k.x, '|' ORDER BY k.i), '') AS keywords FROM q LEFT JOIN k ON k.id = q.id GROUP BY q.id""")
def match_keywords(spark, sf_dir):
    """The words of a query that a text has, longest first, for the fixture's pairs and for all parts."""
    parts = table(spark, sf_dir, "part").select(1000 + F.col("p_partkey"), F.concat("p_name", F.lit(" "), _member("p_partkey", _WORDS)), F.concat("p_type", F.lit(" old "), "p_name", F.lit(" 自然语言处理 graph learning")))
    rows = spark.createDataFrame(_PAIRS, "id long, raw string, hay string").union(parts)
    return rows.select("id", F.array_join(Q.matched_keywords("raw", "hay"), "|").alias("keywords"))


_RANKS = [(1, "Proc. of ACL 2020"), (2, "The oracle of words"), (3, "databases"), (4, "EMNLP"), (5, "PAKDD"), (6, ""), (7, "TKDE"), (8, "软件学报"), (9, "nothing here"), (10, None)]
_RANK = "CASE " + " ".join(f"WHEN len(list_filter({_list(h)}, lambda h: contains(x, h))) > 0 THEN '{r}'" for r, h in P.RANK_HINTS) + " ELSE '' END"


@query(f"SELECT id, {_RANK} AS rank_hint FROM (SELECT id, lower(' ' || coalesce(text, '')) AS x FROM {X.values(_RANKS, X.TEXT)}) UNION ALL SELECT 100 + p_partkey, {_RANK} FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS x FROM part)")
def rank_hint(spark, sf_dir):
    own = _texts(spark, _RANKS).select("id", P.rank_hint(F.lit(""), "text").alias("rank_hint"))
    return own.union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 100, P.rank_hint("p_type", "p_name")))
