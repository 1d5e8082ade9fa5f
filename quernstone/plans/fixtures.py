"""Small literal tables, the same in Spark and, as VALUES, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTITY = "ord long, name string, department string, career string, url string, research_direction string, personal_intro string, papers_text string"
ENTITIES = [
    (1, "王一", "计算机学院", "教授", "u/1", "自然语言处理、机器翻译", "主要从事自然语言处理研究。", "Neural machine translation with long contexts. ACL 2021"),
    (2, "王一", "软件学院", "讲师", "u/2", "数据库系统", "", ""),
    (3, "李 二", "计算机学院", "副教授", "u/3", "计算机视觉", "研究图像识别与机器学习。", ""),
    (4, "王一凡", "数学学院", "教授", "u/4", "偏微分方程", "", "Finite element methods for wave equations"),
    (5, "赵五", "电子学院", "", "u/5", "", "长期从事无线通信与信号处理。", "Deep reinforcement learning for wireless networks"),
    (6, "钱六", "电子学院", "", None, None, None, None),
    (7, "Ann Lee", "Statistics", "Professor", "u/7", "causal inference", "Works on graphical models.", "Graphical models for causal discovery"),
]
DOC = "doc_id string, path string, text string, ord long"
DOCS = [
    ("0001_王一_计算机学院", "c/0001_王一_计算机学院.txt", "学院:计算机学院\n研究方向:自然语言处理、机器翻译\n自然语言处理 自然语言处理", 1),
    ("0002_王一凡_数学学院", "c/0002_王一凡_数学学院.txt", "学院:数学学院\n研究方向:偏微分方程 有限元方法", 2),
    ("0003_赵五_电子学院", "c/0003_赵五_电子学院.txt", "学院:电子学院\n无线通信 信号处理 wireless networks", 3),
    ("0004_赵五_电子学院", "c/0004_赵五_电子学院.txt", "antenna arrays and wireless power", 4),
    ("0005_nobody", "c/0005_nobody.txt", "wireless sensors", 5),
    ("0006_Ann Lee_Statistics", "c/0006_Ann Lee_Statistics.txt", "Bayesian inference and graphical models", 6),
]
QUERY = "query_id long, raw string"
QUERIES = [
    (1, "王一"), (2, "李二"), (3, "NLP"), (4, "自然语言处理方向"), (5, "research: 偏微分方程"), (6, "paper: wave equations"), (7, "antenna power"), (8, "  "), (9, "姓名: 赵五"),
    (10, "deep reinforcement learning"), (11, "name:"), (12, "paper: zzz"), (13, "信号 处理"), (14, "graphical-models"), (15, "DISCOVERY causal graphs"), (16, "PDE"),
]
TEXT = "id long, text string"
TEXTS = [
    (1, "自然语言处理 NLP"), (2, "机"), (3, "机器"), (4, "机器学"), (5, "Deep Learning, 深度学习 2024"), (6, ""), (7, None), (8, "a　b c"), (9, "5G 与 6G"), (10, "Mixed123文字ABC"),
]
LINES = [
    (1, "doc_id: 1\nname: x\n---\n教师个人主页\n姓名:王一\n研究方向\n机器翻译\n机器翻译\n12345\n联系电话：\n  主要从事翻译研究  \n"),
    (2, "no header\n\n导航\nbody line\n1234567\n页面标题:主页"),
    (3, ""), (4, None), (5, "a\n----\nb\n---\nc\nc\n论文\nc"),
]
MASK = [
    (1, "mail a.b@c.org now"), (2, "call 13812345678."), (3, "0512-1234567 or 010 12345678"), (4, "#61331011 and 2014.01-2018.12"), (5, "周 国栋@Google Scholar"), (6, "x1381234567890"), (7, ""), (8, None),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple], schema: str) -> str:
    """The rows as a subquery of SQL."""
    names, types = zip(*[part.split() for part in schema.split(", ")], strict=True)
    kinds = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
    body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {kinds[t]}) AS {n}" for n, t in zip(names, types, strict=True))
    return f"(SELECT {casts} FROM (VALUES {body}) v({', '.join(names)}))"
