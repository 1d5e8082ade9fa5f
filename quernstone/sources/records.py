"""Reading of record files, text corpora, page tables and captured lists; explicit schemas, no inference."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.loose_json import PAPER
from quernstone.functions.papers import normal_list

RAW = f"name string, department string, career string, url string, cn_url string, research_direction string, personal_intro string, papers_text string, title string, full_text string, html_file string, college_id int, site_id int, parser_version int, keywords array<string>, papers_struct array<{PAPER}>, sections map<string,string>"
ROSTER = "name string, career string, department string, cn_url string, college_id int, site_id int"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a JSON array, or of JSON lines, as they are; a file that can't be read gives no rows."""
    rows = spark.read.schema(f"{RAW}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken IS NULL").drop("_broken")


def with_order(df: DataFrame) -> DataFrame:
    """df with ord, the place of a row in its input; ascending, with gaps between partitions."""
    return df.withColumn("ord", F.monotonically_increasing_id() + 1)


def load_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities: trimmed fields, '' for missing ones, the first address there is, distinct keywords, papers with a title."""
    raw = with_order(raw_records(spark, path))
    plain = [T.strip(c).alias(c) for c in ("name", "department", "career")]
    rest = [T.strip(c).alias(c) for c in ("research_direction", "personal_intro", "papers_text")]
    words = F.array_distinct(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: T.squeeze(w)), lambda w: w != ""))
    titled = F.filter(F.coalesce("papers_struct", F.array().cast(f"array<{PAPER}>")), lambda p: F.coalesce(p["title"], F.lit("")) != "")
    address = T.strip(F.coalesce(F.nullif("cn_url", F.lit("")), F.nullif("url", F.lit(""))))
    return raw.select("ord", *plain, address.alias("url"), *rest, words.alias("profile_keywords"), titled.alias("papers_struct"))


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text, ord) of the text files of a folder: cleaned bodies, ordered by path, named by their stem."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/+", "/"))
    docs = files.select(path.alias("path"), T.clean_corpus_text("raw").alias("text")).orderBy("path")
    return with_order(docs).select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("doc_id"), "path", "text", "ord")


def load_document_numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id int, file string").option("sep", "\t").csv(path)


def existing_records(spark: SparkSession, path: str, version: int | None = 2) -> DataFrame:
    """The last record of each address, of one parser version; None: of any."""
    rows = with_order(raw_records(spark, path)).where("coalesce(cn_url, url) IS NOT NULL")
    rows = rows if version is None else rows.where(F.col("parser_version") == version)
    return rows.groupBy(T.normalize_url(F.coalesce("cn_url", "url")).alias("key")).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "ord"]), "ord").alias("r")).select("key", "r.*")


def load_roster(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages of a list service: the rows of their data arrays, in order."""
    pages = spark.read.schema(f"page int, data array<struct<{', '.join(f'{n}:{t}' for n, t in (p.split() for p in ROSTER.split(', ')))}>>").json(path)
    return pages.select("page", F.posexplode("data").alias("at", "r")).select("r.*", (F.col("page").cast("long") * 1_000_000 + F.col("at")).alias("ord"))


def load_colleges(spark: SparkSession, path: str) -> DataFrame:
    """The colleges of a metadata file."""
    meta = spark.read.schema("colleges array<struct<collegeId:int,collegeName:string,count:int,fullDepartName:string,departCategoryId:string>>").option("multiLine", True).json(path)
    return meta.select(F.inline("colleges"))


def decode_bytes(content: bytes | None, declared: str | None = None) -> str:
    """Text of a page: by the declared character set, the one that its head names, UTF-8, then GB 18030; the first with two
    replacement characters at most."""
    content = content or b""
    named = re.search(rb"charset=[\"']?([\w-]+)", content[:3072], re.IGNORECASE)
    for name in (declared, named and named[1].decode("ascii"), "utf-8", "gb18030"):
        try:
            text = content.decode(name) if name else None
        except (LookupError, UnicodeDecodeError):
            continue
        if text is not None and text.count("�") <= 2:
            return text
    return content.decode("utf-8", "ignore")


def decoded(content: Column | str, content_type: Column | str) -> Column:
    """decode_bytes as a column, with the character set of a content type."""
    declared = F.nullif(F.regexp_extract(T.col(content_type), r"(?i)charset=([\w-]+)", 1), F.lit(""))

    def run(contents: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decode_bytes(c, n) for c, n in zip(contents, names, strict=True)], dtype="object")

    return F.pandas_udf(run, "string")(content, declared)
