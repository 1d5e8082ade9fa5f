"""Operators on small tables: sources and sinks, search options, top-k, streaming."""

import json

import uuid

import pytest
from pyspark.sql import functions as F

from quernstone.operators import display, evaluate, extract, filters, index, merge, phrases, rank
from quernstone.operators.search import Search, search_one
from quernstone.plans import fixtures as X
from quernstone.sources import records as R
from quernstone.sources import sinks
from quernstone.streaming import incremental


@pytest.fixture(scope="module")
def search(spark):
    return Search(X.frame(spark, X.DOCS, X.DOC), X.frame(spark, X.ENTITIES, X.ENTITY))


def test_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"name": " a ", "keywords": ["x", " x", "y"], "papers_struct": [{"title": ""}, {"title": "t"}], "url": "u", "parser_version": 2}, {"name": "b", "cn_url": "c"}]))
    rows = R.load_entities(spark, str(tmp_path / "e.json")).orderBy("ord").collect()
    assert [(r.name, r.url, r.profile_keywords, len(r.papers_struct)) for r in rows] == [("a", "u", ["x", "y"], 1), ("b", "c", [], 0)]
    assert R.existing_records(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "broken.json").write_text("{not json")
    assert R.existing_records(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "0001_a b.txt").write_text("k: v\n---\nbody\n论文\n")
    docs = R.load_corpus(spark, str(tmp_path)).collect()
    assert [(d.doc_id, d.text) for d in docs] == [("0001_a b", "body")]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(5, "b/c", "d" * 12, "", 1, "u", "text"), (2, "", None, None, None, None, None)], "ord long, name string, department string, career string, college_id int, url string, corpus_text string")
    sinks.write_artifacts(rows, str(tmp_path / "out"))
    found = R.load_document_numbers(spark, str(tmp_path / "out" / "docno")).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, "0001_teacher_1_.txt"), (2, "0002_b_c_dddddddd.txt")]
    sinks.write_report(rows.select(F.lit("n").alias("name"), "department", "url", F.lit("x").alias("research_direction"), F.lit("").alias("personal_intro"), F.lit(None).cast("string").alias("papers_text")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "coverage")).where("field = 'research_direction'").first()["coverage"] == "2/2 (100.0%)"
    sinks.write_csv(rows.limit(0), str(tmp_path / "none.csv"))
    assert not (tmp_path / "none.csv").exists()
    sinks.write_csv(rows.select("ord"), str(tmp_path / "some.csv"))
    assert (tmp_path / "some.csv").read_bytes().startswith(b"\xef\xbb\xbford")
    sinks.append_log(str(tmp_path / "log.md"), "run", rows.select("ord"))
    assert "| ord |" in (tmp_path / "log.md").read_text()


def test_captured_lists(spark, tmp_path):
    (tmp_path / "list.jsonl").write_text("\n".join(json.dumps({"page": p, "data": [{"name": f"n{p}{i}", "cn_url": f"u{i}", "college_id": p, "site_id": i} for i in range(2)]}) for p in (2, 1)))
    roster = R.load_roster(spark, str(tmp_path / "list.jsonl"))
    assert [r.name for r in roster.orderBy("ord").collect()] == ["n10", "n11", "n20", "n21"]
    (tmp_path / "meta.json").write_text(json.dumps({"colleges": [{"collegeId": 1, "collegeName": "c", "count": 3}]}))
    assert [(r.collegeId, r.collegeName) for r in R.load_colleges(spark, str(tmp_path / "meta.json")).collect()] == [(1, "c")]
    pages = spark.createDataFrame([("http://a.b/x/y z.htm", "<p>")], "url string, html string")
    assert sinks.raw_pages(pages).first()["file"] == "x_y_z_htm.html"
    sinks.save_state(roster, str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "state")).where("saved_at IS NOT NULL").count() == 4


def test_numbers_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert sorted((r.x, r.n) for r in rank.number_all(df, ["x"], "n").collect()) == [(i, i + 1) for i in range(1000)]
    assert rank.number_all(df.limit(0), ["x"], "n").count() == 0


def test_inner_limits_dont_matter(spark):
    """Top-k of each phrase before the union gives the same as one top-k after it."""
    rows = [(1, p, float((n * 7 + p) % 5), f"n{n % 6}", "d", "u", f"x{n}") for n in range(40) for p in range(3)]
    hits = spark.createDataFrame(rows, "query_id int, p int, score double, name string, department string, url string, doc_id string")
    inner = rank.dedupe_and_rank(hits, 4, ["query_id", "p"]).drop("rank")
    got, want = (sorted(map(tuple, rank.dedupe_and_rank(df, 4).drop("p").collect())) for df in (inner, hits))
    assert got == want


def test_search_options(search, spark):
    queries = X.frame(spark, [(12, "paper: graphical models")], X.QUERY)
    assert search.run(X.frame(spark, [(1, "paper: inference")], X.QUERY), strict_scope=True).count() == 0
    assert search.run(X.frame(spark, [(1, "paper: inference")], X.QUERY)).count() > 0
    assert search.run(queries).first()["stage"] == 2
    assert search_one(search, "wirless snsors", threshold=40).first()["stage"] == 7
    assert search.run(X.frame(spark, [], X.QUERY)).count() == 0


def test_all_terms(search, spark):
    wanted = spark.createDataFrame([(1, ["wireless", "power"]), (2, ["wireless", "absent"])], "query_id int, tokens array<string>")
    assert [r.doc_id for r in index.token_scores(wanted, search.index, require_all=True).collect()] == ["0004_赵五_电子学院"]


def test_stored_index_is_read_by_term(spark, search):
    name = f"idx_{uuid.uuid4().hex}"
    search.index.save(name, 4)
    loaded = index.Index.load(spark, name)
    assert loaded.postings.count() == search.index.postings.count()
    for t in ("frequencies", "terms", "norms"):
        spark.sql(f"DROP TABLE {name}_{t}")


def test_display(search, spark):
    queries = X.frame(spark, X.QUERIES, X.QUERY)
    view = display.build_display(search.run(queries, fuzzy=False), search.entities, queries)
    row = view.where("query_id = 10").first()
    assert row.research_tags == [] and row.keywords[0] == "deep reinforcement learning"
    text = display.as_text(view).where("query_id = 3 AND rank = 1").first()["text"]
    assert text.startswith("[1] 王一  |  计算机学院  |  教授\n研究方向: 自然语言处理、机器翻译") and "[CCF-A]" in text


def test_filters(search, spark):
    queries = X.frame(spark, X.QUERIES, X.QUERY)
    base, other = (search.run(queries, relax=relax, fuzzy=False) for relax in (False, True))
    assert {r.query_id for r in filters.compare(base, other).where("new > 0").collect()} >= {15}
    row = spark.range(1).select(filters.query_text(F.lit(" "), F.lit("a"), F.lit("b"), F.lit("c")).alias("q")).first()
    assert row.q == "a b" and filters.clamp(99, -1) == (20, 0)
    assert evaluate.summarize(evaluate.evaluate_modes(search, spark.createDataFrame([(1, "王一", "王一", "")], "query_id int, query string, expected string, note string"))).count() == 2


def test_few_and_many_phrases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "lower(text) AS hay").unionByName(spark.createDataFrame([(-1, None), (-2, "aaaa"), (-3, "")], "doc_id long, hay string"))
    wanted = spark.createDataFrame([("the",), ("er",), ("aa",), ("",), ("a",), ("no such thing",)], "needle string")
    few, many, parts = (sorted(map(tuple, phrases.phrase_counts(docs, wanted, few=f, batch=b).collect())) for f, b in ((64, 100), (0, 100), (0, 2)))
    assert few == many == parts and (-2, "aa", 2) in few


def test_form(search):
    assert [r.name for r in filters.form_search(search, free="wireless", research="无线").collect()] == ["赵五"]
    assert filters.form_search(search, free="wireless", name="王").count() == 0
    assert [r.name for r in filters.form_search(search, name="王 一", order="department").collect()] == ["王一", "王一"]


def test_merge_picks_all_names(spark):
    with pytest.raises(ValueError):
        merge.pick_by_name(spark.createDataFrame([("a",)], "n string"), ["a", "z"], "n")


def test_boxes(spark):
    html = '<title>T</title><script>x</script><div class="post mbox"><div class="tt"><h3 class="tit">研究方向</h3></div><div class="con">图像处理<br>跟踪</div></div><div class="post mbox"><h3>论文</h3><div class="con">A paper about image tracking</div></div>'
    pages = spark.createDataFrame([(1, "http://a", html), (2, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in extract.page_records(extract.walked(pages)).collect()}
    assert rows[1].sections == {"research": "图像处理\n跟踪", "papers": "A paper about image tracking"} and rows[1].title == "T"
    assert rows[2].sections == {} and rows[2].research_direction == ""


def test_stream(spark, data, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40)
    docs.repartition(3).write.parquet(source)
    query = incremental.append_postings(incremental.read_documents(spark, source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("doc_id", "term", "tf").exceptAll(index.term_frequencies(docs)).count() == 0 and got.select("batch").distinct().count() == 3
