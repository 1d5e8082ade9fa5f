"""Hand-derived expectations of the column functions."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import loose_json as J
from quernstone.functions import papers as P
from quernstone.functions import query as Q
from quernstone.functions import text as T
from quernstone.functions.fuzzy import partial_ratio
from quernstone.sources.records import decode_bytes


@pytest.fixture
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return of


def test_masks(value):
    assert value(T.mask_private(F.lit("a.b@c.org 13812345678 0512-1234567 #61331011 2014.01-2018.12"))) == "***@*** *** *** #61331011 2014.01-2018.12"
    assert value(T.mask_private(F.lit("周 国栋@Google Scholar"))) == "周 国栋@Google Scholar"


def test_terms(value):
    assert value(T.tokens(F.lit("GPT4 机器学"))) == ["gpt4", "机", "器", "学", "机器", "器学"]
    assert value(T.relax_terms(F.lit("机器学习论 ab AB 机"))) == ["ab", "机器", "学习", "论", "机"]
    assert [tuple(r) for r in value(T.term_counts(T.tokens(F.lit("b a b"))))] == [("a", 1), ("b", 2)]
    assert value(T.term_counts(T.tokens(F.lit("")))) == []


def test_relaxed_terms_are_tokens(value):
    for text in ("机器", "深度 learning 42", "x"):
        assert set(value(T.relax_terms(F.lit(text)))) - set(value(T.tokens(F.lit(text)))) <= {t for t in value(T.relax_terms(F.lit(text))) if len(t) > 2}


def test_plans(value):
    plan = value(Q.planned(F.lit("research: NLP方向")))
    assert plan["field"] == "research" and plan["phrases"] == ["自然语言处理", "中文信息处理", "NLP", "NLP方向"]
    assert value(Q.planned(F.lit("name：x")))["field"] is None
    assert value(Q.query_plan(F.lit("5g")))["phrases"][-1] == "5g"
    assert value(Q.text_matches(F.lit("x"), F.lit(" "))) and not value(Q.text_matches(F.lit(""), F.lit("x")))
    assert value(Q.matched_keywords(F.lit("机器学习 机器"), F.lit("机器学习"))) == ["机器", "学习"]


def test_snippets(value):
    assert value(T.snippet(F.lit("a" * 60 + "key" + "b" * 60), F.array(F.lit("none"), F.lit("key")))) == "a" * 40 + "key" + "b" * 37
    assert value(T.snippet(F.lit("x\ny"), F.array(F.lit("none")))) == "x y"
    assert value(T.clean_snippet(F.lit("务。"))) == ""


def test_lines(value):
    raw = "a: 1\n---\n导航\nx\nx\n12345\n职称：\n x \ny"
    assert value(T.clean_corpus_text(F.lit(raw))) == "x\ny"
    assert value(T.clean_corpus_text(F.lit(None).cast("string"))) == ""


def test_ranks(value):
    assert value(P.rank_hint(F.lit("TKDE"), F.lit(""))) == "A"
    assert value(P.rank_hint(F.lit(""), F.lit("an oracle"))) == "A"
    assert value(P.rank_hint(F.lit(""), F.lit("nothing"))) == ""


def test_titles(value):
    assert value(P.clean_title(F.lit("[C48] A title, of work."))) == "A title, of work"
    assert value(P.paper_title(F.lit("Neural machine translation with long contexts")))
    assert not value(P.paper_title(F.lit("John Smith")))
    assert value(P.without_leading_labels(F.lit("专利\n待更新\nA paper about graphs"))) == "A paper about graphs"
    assert value(P.marked_titles(F.lit("A. Author. Learning graphs from few examples [C]. ACL")))[0].endswith("Learning graphs from few examples")


def test_research(value):
    assert value(P.research_from_intro(F.lit("他主要从事数据库系统等方面的研究。其他"))) == "数据库系统"
    assert value(P.research_from_intro(F.lit("主要从事教学。"))) == ""
    assert value(P.research_topics(F.lit("1、视觉(跟踪,检测)\n教授"))) == "视觉、跟踪、检测"
    assert value(P.research_from_numbered(F.lit("1. 图像处理\n2. 信号处理"))) == "图像处理、信号处理"


def test_literals(value):
    row = value(J.paper_item(J.parse_literal(F.lit("{'venue': 'KDD', 'year': '2019', 'title': None}"))))
    assert row["title"] == "KDD (2019)" and row["ccf_rank"] == "A"


def test_likeness():
    assert partial_ratio("abc", "xxabcxx") == 100
    assert partial_ratio("", "x") == 0
    assert 70 <= partial_ratio("machne learning", "on machine learning") <= 99


def test_charsets():
    assert decode_bytes("中文".encode("gb18030")) == "中文"
    assert decode_bytes(None) == ""
    assert decode_bytes("é".encode("latin-1"), "latin-1") == "é"


def test_clean_papers(spark):
    raw = ["1、Neural machine translation", "[C48] Parsing of sentences", "专利", "www.example.org/x", "see google scholar", "Neural machine translation", "short", "（3）Graph mining at scale"]
    got = spark.createDataFrame([(raw,)], "x array<string>").select(P.clean_papers(F.col("x")).alias("y")).first()["y"]
    assert got == ["Neural machine translation", "Parsing of sentences", "Graph mining at scale"]
