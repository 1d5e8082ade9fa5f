"""Queries of indexing, search, ranking and evaluation, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import query as Q
from quernstone.functions import text as T
from quernstone.operators import display, evaluate, filters, grams, index, rank, vectors
from quernstone.operators.likeness import alike
from quernstone.operators.search import Search, doc_entities, entity_docs
from quernstone.operators.tables import small, stored
from quernstone.plans import fixtures as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TF = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + (SELECT greatest(count(*), 1) FROM documents) / (1 + count(*))) AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, tf.term, tf, (1 + ln(tf)) * idf AS weight FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id)"""
_HEADS = "heads AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens FROM benchmark)"


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, sf_dir):
    return index.term_frequencies(table(spark, sf_dir, "documents"))


_KEPT: dict[tuple, object] = {}


def _kept(spark: SparkSession, sf_dir: str, kind: str, build):
    """What build gives for the documents, made once in a session for each state of their files: a table that has changed is read anew."""
    files = table(spark, sf_dir, "documents").select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    state = files.agg(F.count("h"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _KEPT or _KEPT[key][0] != tuple(state):
        _KEPT[key] = tuple(state), build()
    return _KEPT[key][1]


def stored_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of documents, built and stored the first time that a session asks for it."""
    return _kept(spark, sf_dir, "index", lambda: index.build_index(table(spark, sf_dir, "documents")).stored())


def stored_vectors(spark: SparkSession, sf_dir: str) -> vectors.Vectors:
    """The documents' vectors, made of that index."""
    return _kept(spark, sf_dir, "vectors", lambda: vectors.document_vectors(stored_index(spark, sf_dir)))


def stored_grams(spark: SparkSession, sf_dir: str) -> grams.GramIndex:
    """The normalised documents by sampled grams."""
    docs = lambda: table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("hay"))
    return _kept(spark, sf_dir, "grams", lambda: grams.gram_index(docs()))


@query(f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def document_frequency(spark, sf_dir):
    return stored_index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 6))


@query(f"WITH {_TF} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def doc_norms(spark, sf_dir):
    return stored_index(spark, sf_dir).norms.withColumn("norm", F.round("norm", 6))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query; scores are rounded first, so that ties fall the same way everywhere."""
    scores = scores.withColumn("score", F.round("score", 6))
    return rank.number(scores, ["query_id"], [F.desc("score"), "doc_id"]).where(F.col("rank") <= k)


_BEST = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM scores)) WHERE rank <= {}"


@query(f"WITH {_TF}, scores AS (SELECT 1 AS query_id, doc_id, sum(weight) / any_value(norm) AS score FROM w JOIN norms USING (doc_id) WHERE term IN ('the', 'hely', 'blend') GROUP BY doc_id) SELECT doc_id, score, rank FROM ({_BEST.format(10)})")
def tfidf_topk(spark, sf_dir):
    """The flagship: the ten best documents of a three-word query."""
    wanted = spark.createDataFrame([(1, ["the", "hely", "blend"])], "query_id long, tokens array<string>")
    return _ranked(index.token_scores(wanted, stored_index(spark, sf_dir)), 10).select("doc_id", "score", "rank")


def _items(spark, sf_dir) -> DataFrame:
    """The words of every benchmark item as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens("text").alias("tokens"))


@query(f"WITH {_TF}, {_HEADS}, scores AS (SELECT query_id, doc_id, sum(weight) / any_value(norm) AS score FROM (SELECT query_id, unnest(tokens) AS term FROM heads) JOIN w USING (term) JOIN norms USING (doc_id) GROUP BY ALL) {_BEST.format(5)}")
def tfidf_topk_batch(spark, sf_dir):
    return _ranked(vectors.best_documents(_items(spark, sf_dir), stored_vectors(spark, sf_dir), 5), 5).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_TF}, {_HEADS} SELECT query_id, doc_id, round(sum(weight) / any_value(norm), 6) AS score FROM (SELECT query_id, len(tokens) AS n, unnest(tokens) AS term FROM heads) JOIN w USING (term) JOIN norms USING (doc_id) GROUP BY query_id, doc_id, n HAVING count(*) = n")
def token_search_all_terms(spark, sf_dir):
    found = vectors.documents_with_all(_items(spark, sf_dir), stored_vectors(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{000b}\x{0085}\x{001c}-\x{001f}]"
_NORM = "lower(regexp_replace({}, '" + _WS.replace("{", "{{").replace("}", "}}") + "+', '', 'g'))"


@query(f"""WITH p AS (SELECT item_id AS query_id, {_NORM.format("text")} AS needle FROM benchmark),
h AS (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS hay FROM documents),
scores AS (SELECT query_id, doc_id, 1 + ln(1 + (length(hay) - length(replace(hay, needle, ''))) // length(needle)) AS score FROM h JOIN p ON needle <> '' AND contains(hay, needle)) {_BEST.format(5)}""")
def phrase_count_topk(spark, sf_dir):
    """Documents by how often they hold a benchmark item, white space apart."""
    wanted = small(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.normalize_text("text").alias("needle")).where("needle <> ''"))
    hits = grams.look_up(stored_grams(spark, sf_dir), wanted).join(wanted, "needle")
    return _ranked(hits.select("query_id", "doc_id", (1 + F.log1p("n")).alias("score")), 5).select("query_id", "doc_id", "score", "rank")


@query("""WITH q AS (SELECT c_custkey AS query_id, replace(c_name, 'Customer', 'Supplier') AS raw FROM customer)
SELECT query_id, CAST(s_suppkey AS VARCHAR) AS department, s_name AS name, 1.0::DOUBLE AS score FROM q JOIN supplier ON replace(raw, ' ', '') = replace(s_name, ' ', '')""")
def exact_name_route(spark, sf_dir):
    """Queries that are the name of an entity, spaces apart: the first stage of the search, for every customer."""
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("department"), *[F.lit("").alias(c) for c in ("career", "url", "research_direction", "personal_intro", "papers_text")])
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("query"), F.lit(None).cast("string").alias("field"))
    return Search(X.frame(spark, [], X.DOC), entities).by_name(wanted).select("query_id", "department", "name", "score")


_PART = """fq(query_id, phrase, tokens) AS (VALUES (1, 'blue widget', ['blue', 'widget']), (2, 'economy', ['economy']), (3, 'red', ['red']), (4, 'small gear', ['small', 'gear'])),
f AS (SELECT query_id, p_partkey, src, (CASE WHEN contains(hay, replace(phrase, ' ', '')) THEN 3 + 0.2 * length(replace(phrase, ' ', '')) ELSE 0 END) + len(list_filter(tokens, lambda t: length(t) >= 2 AND contains(hay, t))) AS score
  FROM fq, (SELECT p_partkey, 'research' AS src, lower(replace(p_type, ' ', '')) AS hay FROM part UNION ALL SELECT p_partkey, 'papers', lower(replace(p_name, ' ', '')) FROM part) WHERE hay <> '')"""
_FIELD_QUERIES = [(1, "blue widget"), (2, "economy"), (3, "red"), (4, "small gear")]


def _parts(spark, sf_dir) -> Search:
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("department"), F.lit("").alias("career"), F.lit("").alias("url"), F.col("p_type").alias("research_direction"), F.lit("").alias("personal_intro"), F.col("p_name").alias("papers_text"))
    return Search(X.frame(spark, [], X.DOC), entities)


def _field_plans(spark) -> DataFrame:
    plans = spark.createDataFrame(_FIELD_QUERIES, "query_id int, raw string").select("query_id", Q.planned("raw").alias("p"))
    return stored(plans.select("query_id", "p.phrases", "p.tokens"))


@query(f"WITH {_PART} SELECT query_id, p_partkey, round(CAST(score AS DOUBLE), 6) AS score FROM f WHERE src = 'papers' AND score > 0")
def field_search(spark, sf_dir):
    hits = _parts(spark, sf_dir).by_field(_field_plans(spark), "papers")
    return hits.select("query_id", F.col("name").cast("long").alias("p_partkey"), F.round("score", 6).alias("score"))


@query(f"WITH {_PART} SELECT query_id, p_partkey, max(round(CAST(score AS DOUBLE), 6)) AS score FROM f WHERE score > 0 GROUP BY ALL")
def field_search_union(spark, sf_dir):
    """Two fields: the greater score counts, not the sum."""
    parts, plans = _parts(spark, sf_dir), _field_plans(spark)
    hits = parts.by_field(plans, "research").unionByName(parts.by_field(plans, "papers"))
    best = rank.first_per_key(hits, ["query_id", "name", "department"], rank.hit_order())
    return best.select("query_id", F.col("name").cast("long").alias("p_partkey"), F.round("score", 6).alias("score"))


_HITS = "hits AS (SELECT o_orderstatus AS query_id, o_totalprice AS score, c_name AS name, c_mktsegment AS department, '' AS url, CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey)"
_RANKED = f"""{_HITS}, best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, replace(name, ' ', ''), trim(department) ORDER BY score DESC, name, department, url, doc_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, department, url, doc_id) AS rank FROM best)"""


def _order_hits(spark, sf_dir) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("o_orderstatus").alias("query_id"), F.col("o_totalprice").alias("score"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"), F.lit("").alias("url"), F.col("o_orderkey").cast("string").alias("doc_id"))


@query(f"WITH {_RANKED} SELECT query_id, rank, score, name, department, doc_id FROM ranked WHERE rank <= 20")
def dedupe_rank(spark, sf_dir):
    return rank.dedupe_and_rank(_order_hits(spark, sf_dir), 20).select("query_id", "rank", "score", "name", "department", "doc_id")


def _sorted_sql(order: str) -> str:
    return f"WITH {_RANKED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}, rank) AS place, name, department, score FROM ranked WHERE rank <= 20"


def _placed(spark, sf_dir, mode):
    ranked = rank.dedupe_and_rank(_order_hits(spark, sf_dir), 20)
    return rank.number(ranked, ["query_id"], [*rank.result_order(mode), "rank"], "place").select("query_id", "place", "name", "department", "score")


@query(_sorted_sql("name, score DESC"))
def sort_by_name(spark, sf_dir):
    return _placed(spark, sf_dir, "name")


@query(_sorted_sql("department, name, score DESC"))
def sort_by_group(spark, sf_dir):
    return _placed(spark, sf_dir, "department")


@query(f"WITH {_RANKED}, a AS (SELECT * FROM ranked WHERE rank <= 10), b AS (SELECT * FROM ranked WHERE rank <= 20) SELECT b.query_id, b.name, b.rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.name = b.name)")
def compare_modes_new(spark, sf_dir):
    """Names that one way of searching finds and the other doesn't."""
    hits = _order_hits(spark, sf_dir)
    return filters.new_names(rank.dedupe_and_rank(hits, 10), rank.dedupe_and_rank(hits, 20)).select("query_id", "name", "rank")


@query(f"WITH {_RANKED} SELECT query_id, rank, name, department FROM ranked WHERE rank <= 50 AND contains(name, '1') AND contains(lower(department), 'build')")
def post_filter(spark, sf_dir):
    ranked = rank.dedupe_and_rank(_order_hits(spark, sf_dir), 50).withColumn("research", F.col("department")).withColumn("papers", F.lit(""))
    return filters.filter_results(ranked, name="1", research="build").select("query_id", "rank", "name", "department")


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def cap_per_group(spark, sf_dir):
    capped = rank.cap_per_group(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3)
    return rank.number(capped, ["user_id"], ["ts", "event_id"], "n").select("event_id", "user_id", "n")


_ITEM = f"regexp_replace(regexp_replace(regexp_replace(text, '[-_/]+', ' ', 'g'), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


#: Part names as entities, with documents that are dealt out to the first 200 parts, beside the fixture's; and queries made of both.
_OF_PART = "SELECT min(p_partkey) + 1000 AS ord, p_name AS name, min(p_brand) AS department, '' AS career, 'u/' || min(p_partkey) AS url, min(p_type) AS research_direction, 'Works on ' || max(p_type) AS personal_intro, 'A study of the ' || reverse(p_name) AS papers_text FROM part GROUP BY p_name"
_OF_DOCUMENT = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'c/' || p_name || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text, doc_id + 1000 AS ord FROM documents JOIN part ON p_partkey = doc_id % 200"
_E, _D = (f"(SELECT * FROM {X.values(rows, kind)} UNION ALL {of})" for rows, kind, of in ((X.ENTITIES, X.ENTITY, _OF_PART), (X.DOCS, X.DOC, _OF_DOCUMENT)))


def _entities(spark, sf_dir) -> DataFrame:
    named = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg((F.min("p_partkey") + 1000).alias("ord"), F.min("p_brand").alias("department"), F.min("p_type").alias("research_direction"), F.concat(F.lit("Works on "), F.max("p_type")).alias("personal_intro"))
    made = named.withColumns({"career": F.lit(""), "url": F.concat(F.lit("u/"), (F.col("ord") - 1000).cast("string")), "papers_text": F.concat(F.lit("A study of the "), F.reverse("name"))})
    return X.frame(spark, X.ENTITIES, X.ENTITY).unionByName(made)


def _documents(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parts = small(parts.where("p_partkey BETWEEN -199 AND 199"))  # what a remainder can be
    docs = table(spark, sf_dir, "documents").withColumn("p_partkey", F.col("doc_id") % 200).join(parts, "p_partkey")
    path = F.concat(F.lit("c/"), "p_name", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return X.frame(spark, X.DOCS, X.DOC).unionByName(docs.select(F.col("doc_id").cast("string").alias("doc_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") + 1000).alias("ord")))


@query(f"SELECT d.doc_id, min(e.ord) AS entity FROM {_D} d JOIN {_E} e ON length(e.name) > 0 AND contains(d.path, e.name) GROUP BY d.doc_id")
def doc_entity_bridge(spark, sf_dir):
    return doc_entities(_documents(spark, sf_dir), _entities(spark, sf_dir))


@query(f"SELECT e.ord AS entity, arg_min(d.doc_id, d.ord) AS doc_id FROM {_D} d JOIN {_E} e ON length(e.name) > 0 AND contains(d.path, e.name) GROUP BY e.ord")
def entity_doc_bridge(spark, sf_dir):
    return entity_docs(_documents(spark, sf_dir), _entities(spark, sf_dir)).select("entity", "doc_id")


#: Queries of the tables, and their plans: names, types and papers of parts with and without a prefix, and whole benchmark items.
_ASKED = f"""asked(query_id, query, field) AS (SELECT 1000 + 4 * ord, name, CASE WHEN ord % 2 = 0 THEN 'name' END FROM part_entity UNION ALL SELECT 1001 + 4 * ord, research_direction, 'research' FROM part_entity
  UNION ALL SELECT 1002 + 4 * ord, papers_text, CASE WHEN ord % 2 = 0 THEN 'papers' END FROM part_entity UNION ALL SELECT 100000000 + item_id, {{item}}, NULL FROM benchmark WHERE {{item}} <> '')"""


def _asked(spark, sf_dir) -> DataFrame:
    entities = _entities(spark, sf_dir).where("ord >= 1000")
    prefix = lambda p: F.when(F.col("ord") % 2 == 0, F.lit(p)).otherwise(F.lit(""))
    kinds = [(0, F.concat(prefix("name: "), "name")), (1, F.concat(F.lit("Research: "), "research_direction")), (2, F.concat(prefix("paper: "), "papers_text"))]
    made = [entities.select((1000 + k + 4 * F.col("ord")).alias("query_id"), raw.alias("raw")) for k, raw in kinds]
    made.append(table(spark, sf_dir, "benchmark").select((100_000_000 + F.col("item_id")).alias("query_id"), F.col("text").alias("raw")))
    return reduce(DataFrame.unionByName, made, X.frame(spark, X.QUERIES, X.QUERY))


def _search(spark, sf_dir) -> Search:
    return Search(stored(_documents(spark, sf_dir)), stored(_entities(spark, sf_dir)))


def _cascade_results(spark, sf_dir, **options) -> DataFrame:
    return _search(spark, sf_dir).ranked(_asked(spark, sf_dir), **options)


#: Plans of the fixture's queries as SQL has them: query_id, text without prefix, field, phrases, tokens.
_PLANS = """fixed(query_id, query, field, phrases, tokens) AS (VALUES
(1, '王一', NULL, ['王一'], ['王一']), (2, '李二', NULL, ['李二'], ['李二']), (3, 'NLP', NULL, ['自然语言处理', '中文信息处理', 'NLP'], ['自然', '语言', '处理', '中文', '信息', 'nlp']),
(4, '自然语言处理方向', NULL, ['自然语言处理', '自然语言处理方向'], ['自然', '语言', '处理', '方向']), (5, '偏微分方程', 'research', ['偏微分方程'], ['偏微', '分方', '程']),
(6, 'wave equations', 'papers', ['wave equations'], ['wave', 'equations']), (7, 'antenna power', NULL, ['antenna power'], ['antenna', 'power']), (9, '赵五', 'name', ['赵五'], ['赵五']),
(10, 'deep reinforcement learning', NULL, ['深度强化学习', '强化学习', 'deep reinforcement learning'], ['深度', '强化', '学习', 'deep', 'reinforcement', 'learning']), (12, 'zzz', 'papers', ['zzz'], ['zzz']),
(13, '信号 处理', NULL, ['信号 处理'], ['信号', '处理']), (14, 'graphical models', NULL, ['graphical models'], ['graphical', 'models']), (15, 'DISCOVERY causal graphs', NULL, ['DISCOVERY causal graphs'], ['discovery', 'causal', 'graphs']),
(16, 'PDE', NULL, ['偏微分方程', '数值方法', 'PDE'], ['偏微', '分方', '程', '数值', '方法', 'pde']))"""
_PLANS += f""",
part_entity AS ({_OF_PART}), {_ASKED.replace("{item}", _ITEM)},
plans AS (SELECT * FROM fixed UNION ALL SELECT query_id, query, field, [query], list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) FROM asked)"""
_GRAMS = """flatten(list_transform(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda b: list_concat(string_split(b, ''), list_transform(range(1, length(b)), lambda i: substring(b, i, 2)))))"""
_CASCADE = f"""WITH e AS (SELECT * FROM {_E}), d AS (SELECT * FROM {_D}), {_PLANS},
bridge AS (SELECT d.doc_id, min(e.ord) AS entity FROM d JOIN e ON length(e.name) > 0 AND contains(d.path, e.name) GROUP BY d.doc_id),
first_doc AS (SELECT e.ord AS entity, arg_min(d.doc_id, d.ord) AS doc_id FROM d JOIN e ON length(e.name) > 0 AND contains(d.path, e.name) GROUP BY e.ord),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), {_GRAMS.format('text')})) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM d) / (1 + count(*))) AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, tf.term, (1 + ln(tf)) * idf AS weight FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id),
ph AS (SELECT query_id, {_NORM.format('p')} AS needle FROM (SELECT query_id, unnest(phrases) AS p FROM plans)),
fields AS (SELECT ord, 'papers' AS src, {_NORM.format("coalesce(papers_text, '')")} AS hay FROM e UNION ALL SELECT ord, 'research', {_NORM.format("coalesce(research_direction, '')")} FROM e),
fs AS (SELECT query_id, field, src, ord, list_sum(list_transform(list_filter(list_transform(phrases, lambda x: {_NORM.format('x')}), lambda x: x <> '' AND contains(hay, x)), lambda x: 3 + 0.2 * length(x))) AS a,
  len(list_filter(list_transform(tokens, lambda x: {_NORM.format('x')}), lambda x: length(x) >= 2 AND contains(hay, x))) AS b FROM plans, fields WHERE hay <> ''),
ents AS (
  SELECT query_id, 1 AS stage, 1.0::DOUBLE AS score, ord FROM plans JOIN e ON name <> '' AND replace(query, ' ', '') = replace(name, ' ', '') WHERE field IS NULL OR field = 'name'
  UNION ALL SELECT query_id, 2, coalesce(a, 0) + b, ord FROM fs WHERE field = src AND coalesce(a, 0) + b > 0
  UNION ALL SELECT query_id, 3, 1.0, ord FROM e JOIN ph ON needle <> '' AND contains({_NORM.format("concat_ws(' ', name, coalesce(research_direction, ''), coalesce(personal_intro, ''), coalesce(papers_text, ''))")}, needle)
  UNION ALL SELECT query_id, 4, coalesce(a, 0) + b, ord FROM fs WHERE coalesce(a, 0) + b > 0),
all_hits AS (
  SELECT query_id, stage, score, e.name, department, url, coalesce(doc_id, e.name) AS doc_id FROM ents JOIN e USING (ord) LEFT JOIN first_doc ON entity = ord
  UNION ALL SELECT query_id, 3, 1 + ln(1 + (length(hay) - length(replace(hay, needle, ''))) // length(needle)), name, department, url, doc_id FROM (SELECT doc_id, {_NORM.format('text')} AS hay FROM d) JOIN ph ON needle <> '' AND contains(hay, needle) JOIN bridge USING (doc_id) JOIN e ON e.ord = entity
  UNION ALL SELECT query_id, 5, sum(weight) / any_value(norm), any_value(name), any_value(department), any_value(url), doc_id FROM (SELECT query_id, unnest(tokens) AS term FROM plans) JOIN w USING (term) JOIN norms USING (doc_id) JOIN bridge USING (doc_id) JOIN e ON e.ord = entity GROUP BY query_id, doc_id),
hits AS (SELECT * REPLACE (round(score, 9) AS score) FROM all_hits),
least AS (SELECT *, min(stage) OVER (PARTITION BY query_id) AS m FROM hits WHERE {{stages}}),
best AS (SELECT * FROM least WHERE stage = m QUALIFY row_number() OVER (PARTITION BY query_id, replace(name, ' ', ''), trim(department) ORDER BY score DESC, name, department, coalesce(url, ''), doc_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, department, coalesce(url, ''), doc_id) AS rank FROM best)"""
_CASCADE_ROWS = "SELECT query_id, stage, rank, round(score, 6) AS score, name, department, doc_id FROM ranked WHERE rank <= 8"


@query(_CASCADE.replace("{stages}", "true") + _CASCADE_ROWS)
def cascade_batch(spark, sf_dir):
    """All stages but the fuzzy one, for a batch of queries."""
    found = _cascade_results(spark, sf_dir, fuzzy=False)
    return found.select("query_id", "stage", "rank", F.round("score", 6).alias("score"), "name", "department", "doc_id")


@query(_CASCADE.replace("{stages}", "stage IN (1, 2, 5)") + _CASCADE_ROWS)
def cascade_baseline(spark, sf_dir):
    """Without relaxing: names, scoped fields and terms alone."""
    found = _cascade_results(spark, sf_dir, relax=False)
    return found.select("query_id", "stage", "rank", F.round("score", 6).alias("score"), "name", "department", "doc_id")


@query(_CASCADE.replace("{stages}", "stage = 3") + "SELECT query_id, rank, round(score, 6) AS score, name, department, doc_id FROM ranked WHERE rank <= 8")
def phrase_entity_union(spark, sf_dir):
    """Documents and entities that hold a phrase, as one ranking."""
    search = _search(spark, sf_dir)
    plans = stored(_asked(spark, sf_dir)).select("query_id", Q.planned("raw").alias("p")).where("p.query <> ''").select("query_id", "p.phrases", "p.tokens")
    ranked = rank.dedupe_and_rank(search.by_phrase(plans), 8)
    return ranked.select("query_id", "rank", F.round("score", 6).alias("score"), "name", "department", "doc_id")




@query(f"""WITH {_TF}, e AS (SELECT DISTINCT source AS name, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS ord FROM documents WHERE source <> ''),
q AS (SELECT item_id AS query_id, {_ITEM} AS query FROM benchmark WHERE {_ITEM} <> ''), ph AS (SELECT query_id, {_NORM.format('query')} AS needle FROM q),
of_doc AS (SELECT doc_id, min(ord) AS ord FROM documents JOIN e ON contains('/corpus/' || source || '/' || doc_id || '.txt', name) GROUP BY doc_id),
h AS (SELECT query_id, 3 AS stage, 1 + ln(1 + (length(hay) - length(replace(hay, needle, ''))) // length(needle)) AS score, doc_id FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS hay FROM documents) JOIN ph ON needle <> '' AND contains(hay, needle)
  UNION ALL SELECT query_id, 5, sum(weight) / any_value(norm), doc_id FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS term FROM q) JOIN w USING (term) JOIN norms USING (doc_id) GROUP BY query_id, doc_id),
n AS (SELECT query_id, stage, round(score, 9) AS score, name, CAST(doc_id AS VARCHAR) AS doc_id FROM h JOIN of_doc USING (doc_id) JOIN e USING (ord) QUALIFY stage = min(stage) OVER (PARTITION BY query_id)),
best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC, doc_id) = 1)
SELECT query_id, stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, doc_id) AS rank, round(score, 6) AS score, name, doc_id FROM best QUALIFY rank <= 8""")
def cascade_documents(spark, sf_dir):
    """The staged search of all benchmark items over all documents, whose sources are the entities."""
    docs = table(spark, sf_dir, "documents")
    paths = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    corpus = docs.select(F.col("doc_id").cast("string").alias("doc_id"), paths.alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("ord"))
    named = docs.where("source <> ''").select(F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("ord"), F.col("source").alias("name")).distinct()
    entities = named.select("ord", "name", *[F.lit("").alias(c) for c in ("department", "career", "url", "research_direction", "personal_intro", "papers_text")])
    known = stored_index(spark, sf_dir)
    words = index.Index(known.frequencies.withColumn("doc_id", F.col("doc_id").cast("string")), known.terms, known.norms.withColumn("doc_id", F.col("doc_id").cast("string")), known.documents)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw"))
    found = Search(corpus, entities, words).run(items, fuzzy=False)
    return found.select("query_id", "stage", "rank", F.round("score", 6).alias("score"), "name", "doc_id")


_CASES = [(1, "王一", "王一", "name"), (2, "李二", "李 二", "spaced name"), (3, "NLP", "王一", "abbreviation"), (7, "antenna power", "Ann Lee", "miss"), (12, "paper: zzz", "王一", "no result"), (16, "PDE", "王一凡", "second")]
_CASE = "query_id long, query string, expected string, note string"
_EVAL = f""", cases AS (SELECT * FROM (VALUES {', '.join(str(c) for c in _CASES)}) v(query_id, query, expected, note)
  UNION ALL SELECT query_id, CASE field WHEN 'name' THEN 'name: ' WHEN 'papers' THEN 'paper: ' ELSE '' END || query, CASE WHEN query_id % 4 = 0 THEN name ELSE reverse(substring(query, 16)) END, 'part' FROM asked JOIN part_entity ON 4 * ord + 1000 + query_id % 4 = query_id WHERE query_id < 100000000 AND query_id % 4 IN (0, 2)),
detail AS (SELECT c.query_id, c.query, c.expected, coalesce(max(CASE WHEN rank = 1 THEN name END), '') AS top1, coalesce(string_agg(name, '|' ORDER BY rank), '') AS topk_names,
  CAST(coalesce(max(CASE WHEN rank = 1 THEN name END), '') = c.expected AS INTEGER) AS hit_at_1, CAST(count(CASE WHEN name = c.expected THEN 1 END) > 0 AS INTEGER) AS hit_at_k,
  coalesce(min(CASE WHEN name = c.expected THEN rank END), 0) AS expected_rank, count(rank) AS result_count FROM cases c LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (query_id) GROUP BY c.query_id, c.query, c.expected)"""


def _cases(spark, sf_dir) -> DataFrame:
    """The fixture's cases, and names and papers of parts, which are to find the part."""
    expected = _entities(spark, sf_dir).where("ord >= 1000").select(F.explode(F.array((1000 + 4 * F.col("ord")), (1002 + 4 * F.col("ord")))).alias("query_id"), F.col("name").alias("expected"), F.lit("part").alias("note"))
    asked = _asked(spark, sf_dir).select("query_id", F.col("raw").alias("query"))
    return spark.createDataFrame(_CASES, _CASE).unionByName(asked.join(expected, "query_id"))


def _detail(spark, sf_dir) -> DataFrame:
    results = _cascade_results(spark, sf_dir, top_k=5, fuzzy=False)
    return evaluate.evaluate(_cases(spark, sf_dir), results)


@query(_CASCADE.replace("{stages}", "true") + _EVAL + " SELECT * FROM detail")
def eval_detail(spark, sf_dir):
    return _detail(spark, sf_dir).select("query_id", "query", "expected", "top1", "topk_names", "hit_at_1", "hit_at_k", "expected_rank", "result_count")


@query(_CASCADE.replace("{stages}", "true") + _EVAL + " SELECT 'optimized' AS mode, count(*) AS cases, sum(hit_at_1) AS hit_at_1_count, round(avg(hit_at_1), 4) AS hit_at_1_rate, sum(hit_at_k) AS hit_at_k_count, round(avg(hit_at_k), 4) AS hit_at_k_rate FROM detail")
def eval_summary(spark, sf_dir):
    return evaluate.summarize(_detail(spark, sf_dir).withColumn("mode", F.lit("optimized")))


_BASELINE, _OPTIMIZED = (f"({_CASCADE.replace('{stages}', stages)}{_EVAL} SELECT * FROM detail)" for stages in ("stage IN (1, 2, 5)", "true"))


@query(f"SELECT 'baseline' AS mode, * FROM {_BASELINE} UNION ALL SELECT 'optimized' AS mode, * FROM {_OPTIMIZED}")
def eval_modes(spark, sf_dir):
    """Details of the same cases without and with relaxing."""
    details = evaluate.evaluate_modes(_search(spark, sf_dir), _cases(spark, sf_dir), 5, fuzzy=False)
    return details.select("mode", "query_id", "query", "expected", "top1", "topk_names", "hit_at_1", "hit_at_k", "expected_rank", "result_count")


def _misspelled(spark, sf_dir) -> DataFrame:
    """(query_id, query, expected): every part name, and the same without every fifth letter."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("expected")).agg(F.min("p_partkey").alias("query_id"))
    return names.select("query_id", F.regexp_replace("expected", "(.{4}).", "$1").alias("query"), "expected", F.lit("").alias("note"))


def _named(spark, sf_dir) -> Search:
    """Part names as entities without documents."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return Search(X.frame(spark, [], X.DOC), names.select("ord", "name", *[F.lit("").alias(c) for c in ("department", "career", "url", "research_direction", "personal_intro", "papers_text")]))


@query(None)
def likeness_join(spark, sf_dir):
    """Misspelled part names, and the names of all customers and suppliers, that are like the name of a part."""
    others = table(spark, sf_dir, "customer").select(F.col("c_name").alias("text")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return alike(_misspelled(spark, sf_dir).select(F.col("query").alias("text")).union(others), table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), 60)


@query(None)
def fuzzy_search(spark, sf_dir):
    """The five entities that are most like each misspelled part name."""
    plans = _misspelled(spark, sf_dir).select("query_id", F.array("query").alias("phrases"))
    return rank.dedupe_and_rank(_named(spark, sf_dir).by_likeness(plans, 70), 5).select("query_id", "rank", "score", "name")


@query(None)
def threshold_sweep(spark, sf_dir):
    """How often misspelled part names find what they mean, by the threshold of likeness."""
    return evaluate.sweep(_named(spark, sf_dir), _misspelled(spark, sf_dir), range(50, 101, 5))


@query(None)
def fuzzy_filter(spark, sf_dir):
    """Customers whose name a misspelled needle matches, contains, or is like, by the filter of result lists."""
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return named.where(filters.text_filter("name", "Custmr#000000149", fuzzy=True, threshold=92))


def _found(spark, sf_dir):
    """The search of the fixture and the parts, its results for all queries, and the queries."""
    search, asked = _search(spark, sf_dir), stored(_asked(spark, sf_dir))
    return search, search.run(asked, top_k=3, fuzzy=False), asked


@query(None)
def display_results(spark, sf_dir):
    """What a reader sees of the three best results of every query: masked, cleaned and shortened, as lines of text."""
    search, results, asked = _found(spark, sf_dir)
    return display.as_text(display.build_display(results, search.entities, asked))


@query(None)
def form_results(spark, sf_dir):
    """A search form over the parts: research and name fields without free text, sorted by name."""
    return filters.form_search(_search(spark, sf_dir), research="economy", name="bolt", k=20, fuzzy=False, order="name").select("rank", "name", "department", "stage", "score")
