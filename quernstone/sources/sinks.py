"""Writing of index artifacts, reports, state and logs. Spark's commit protocol makes each table whole or absent."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.rank import number_all
from quernstone.operators.report import coverage, incomplete


def artifacts(records: DataFrame) -> DataFrame:
    """(doc_id, file, name, department, career, college_id, url, content): numbered from 1 in order, with the file that each becomes."""
    df = number_all(records, ["ord"], "doc_id") if "doc_id" not in records.columns else records
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("teacher_"), F.col("doc_id").cast("string")))
    field = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    df = df.withColumn("name", name).withColumn("file", T.file_name(F.col("doc_id"), "name", "department"))
    head = F.concat_ws("\n", *[field(c, c) for c in ("doc_id", "name", "career", "department", "college_id", "url")])
    return df.select("doc_id", "file", "name", "department", "career", "college_id", "url", F.concat(head, F.lit("\n---\n"), T.col("corpus_text")).alias("content"))


def write_artifacts(records: DataFrame, folder: str) -> None:
    """The corpus as a table of files, their numbers, and the index without texts; replaces what was there."""
    made = artifacts(records).persist()
    made.select("file", "content").write.mode("overwrite").parquet(f"{folder}/corpus")
    made.select("doc_id", "file").write.mode("overwrite").option("sep", "\t").csv(f"{folder}/docno")
    made.drop("content").write.mode("overwrite").json(f"{folder}/index")
    made.unpersist()


def write_report(records: DataFrame, folder: str, fields: Sequence[str] = ("research_direction", "personal_intro", "papers_text"), samples: int = 60) -> None:
    """Coverage, and the first records that lack a field."""
    coverage(records, fields).write.mode("overwrite").json(f"{folder}/coverage")
    incomplete(records, fields, ["name", "department", "url"], samples).write.mode("overwrite").json(f"{folder}/incomplete")


def save_state(records: DataFrame, folder: str) -> None:
    """A snapshot with the time at which it was saved."""
    records.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").json(folder)


def raw_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file, html) of raw pages, named by their address."""
    return pages.select(F.concat(T.slug(url_col), F.lit(".html")).alias("file"), F.col(html_col).alias("html"))


def write_csv(report: DataFrame, path: str) -> None:
    """A report of few rows (one for each case or mode) as one local file with a header and a byte-order mark; none if it's empty."""
    rows = report.collect()
    if rows:
        with open(path, "w", encoding="utf-8-sig", newline="") as file:
            writer = csv.writer(file)
            writer.writerow(report.columns)
            writer.writerows(rows)


def append_log(path: str, title: str, report: DataFrame) -> None:
    """Adds a block with a report's rows to a local Markdown file."""
    lines = [f"## {title}", "", f"| {' | '.join(report.columns)} |", "|" + " - |" * len(report.columns), *[f"| {' | '.join(map(str, r))} |" for r in report.collect()], ""]
    with Path(path).open("a", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
