"""Queries of jobs that write: an index that follows changes, work that is taken up again, and a file for each row, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.resume import Job
from quernstone.operators.tables import shared_dir
from quernstone.plans.retrieval import table
from quernstone.plans.texts import _BODY, _cleaned
from quernstone.sources import sinks
from quernstone.sources.files import RowFiles
from quernstone.streaming.versions import SegmentedIndex

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _new_folder(spark, name: str) -> str:
    """A folder in the shared one, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'again word' WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' newterm' || doc_id % 7 ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 12 = 0 OR doc_id % 6 <> 0),
tf AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d))
SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM d) / (1 + count(*))), 6) AS idf FROM tf GROUP BY term""")
def index_versions(spark, sf_dir):
    """Document frequencies after three batches of changes to all documents: most of them, then new and changed ones, then removals and some that come back."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    index = SegmentedIndex(spark, _new_folder(spark, "segments"))
    batches = [
        docs.where("doc_id % 4 <> 3").select("doc_id", text.alias("text")),
        docs.where("doc_id % 4 = 3 OR doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit(" newterm"), (F.col("doc_id") % 7).cast("string"))).otherwise(text).alias("text")),
        docs.where("doc_id % 6 = 0").select("doc_id", F.when(F.col("doc_id") % 12 == 0, F.lit("again word")).alias("text")),
    ]
    for number, batch in enumerate(batches):
        index.apply(batch.withColumn("seq", F.lit(number)), number)
        if number == 1:
            index.compact()
    return index.terms().withColumn("idf", F.round("idf", 6))


@query(f"WITH k AS (SELECT doc_id, {_cleaned(_BODY)} AS l FROM documents) SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10))) AS body FROM k")
def resumed_job(spark, sf_dir):
    """Cleaned documents, of a job that stops after three of its sixteen parts and is taken up again."""
    job = Job(_new_folder(spark, "job"), "doc_id", lambda rows: rows.select("doc_id", F.md5(T.clean_corpus_text("text").cast("binary")).alias("body")), parts=16)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    job.run(docs, most=3)
    job.run(docs, at_once=16)
    return job.results(spark)


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS doc_id, s_name, 'nation ' || s_nationkey % 10 AS department FROM supplier)
SELECT lpad(CAST(doc_id AS VARCHAR), 4, '0') || '_' || regexp_replace(s_name, '[/<>:"|?*\\\\]', '_', 'g') || '_' || department || '.txt' AS file,
  md5('doc_id: ' || doc_id || chr(10) || 'name: ' || s_name || chr(10) || 'career: ' || chr(10) || 'department: ' || department || chr(10) || 'college_id: 0' || chr(10) || 'url: ' || chr(10) || '---' || chr(10) || s_name || ' é') AS content FROM n""".replace("\\\\\\\\", "\\\\"))
def corpus_files(spark, sf_dir):
    """The corpus that an index is made of as files, written by the tasks and read again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.concat(F.lit("nation "), (F.col("s_nationkey") % 10).cast("string")).alias("department"), F.lit("").alias("career"), F.lit(0).alias("college_id"), F.lit("").alias("url"), F.concat("s_name", F.lit(" é")).alias("corpus_text"))
    folder = _new_folder(spark, "files")
    spark.dataSource.register(RowFiles)
    sinks.artifacts(rows).select("doc_id", "file", "content").write.format("row_files").mode("overwrite").save(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), F.md5("content").alias("content"))
