"""Jobs that write: what a failure leaves, what a second run does, and an index that follows its documents."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernstone.operators import index
from quernstone.operators.resume import Job
from quernstone.sources.files import CONTENTS, MANIFEST, RowFiles
from quernstone.streaming.versions import SegmentedIndex, follow


def files_of(folder):
    return {p.name: p.read_text(encoding="utf-8") for p in Path(folder).rglob("*.txt")}


def save(df, folder, mode="overwrite"):
    df.sparkSession.dataSource.register(RowFiles)
    df.write.format("row_files").option("column", "body").mode(mode).save(str(folder))


def test_files_are_whole_or_absent(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}_é.txt", f"text {i}\n" if i % 9 else None) for i in range(40)], "id long, file string, body string").repartition(3)
    target = tmp_path / "corpus"
    save(rows, target)
    want = {f"{i}_é.txt": f"text {i}\n" if i % 9 else "" for i in range(40)}
    assert files_of(target) == want
    parts = [json.loads(x) for x in (target / MANIFEST).read_text().splitlines()]
    assert sum(p["files"] for p in parts) == 40 and sum(p["bytes"] for p in parts) == sum(len(t) for t in want.values())
    contents = [json.loads(x) for p in parts for x in (target / p["part"] / CONTENTS).read_text(encoding="utf-8").splitlines()]
    assert sorted(c["id"] for c in contents) == list(range(40)) and all((target / c["file"]).exists() for c in contents)
    bad = rows.withColumn("file", F.when(F.col("id") == 39, F.lit("a/b")).otherwise(F.col("file")))
    for broken in (bad, rows.unionByName(rows).coalesce(1), rows.withColumn("file", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            save(broken, target)
        assert files_of(target) == want and os.listdir(tmp_path) == ["corpus"]
    save(rows.where("id < 2").withColumn("file", F.concat(F.lit("more_"), "file")), target, "append")
    assert len(files_of(target)) == 42 and sum(json.loads(x)["files"] for x in (target / MANIFEST).read_text().splitlines()) == 42
    save(rows.limit(0), target)
    assert files_of(target) == {}


def test_job_is_taken_up_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * i) for i in range(200)], "id long, x long").repartition(4)
    target, seen = str(tmp_path / "job"), []

    def work(limit):
        def run(df):
            seen.append(sorted(r["id"] for r in df.collect()))
            return df.select("id", (F.when(F.col("x") < limit, F.col("x")).otherwise(F.raise_error(F.lit("too large"))) + 1).alias("y"))

        return run

    ok = F.col("y") % 2 == 0
    with pytest.raises(Exception, match="too large"):
        Job(target, "id", work(39_000), parts=8, ok=ok).run(rows, at_once=1)
    finished = Job(target, "id", work(0), parts=8, ok=ok).done(spark)
    again = Job(target, "id", work(10**9), parts=8, ok=ok)
    before = len(seen)
    progress = again.run(rows, at_once=2).first()
    assert tuple(progress) == (8, 8, 0, 200, 100, 100)
    assert sorted(map(tuple, again.results(spark).collect())) == [(i, i * i + 1) for i in range(200)]
    assert sum(len(x) for x in seen[before:]) == 200 - sum(len(x) for x in seen[: before - 1]) and len(finished) < 8
    assert again.run(rows).first()["left"] == 0 and len(seen) == before + -(-(8 - len(finished)) // 2)
    with pytest.raises(ValueError):
        Job(target, "id", work(1), parts=9).run(rows)


def test_job_without_results(spark, tmp_path):
    job = Job(str(tmp_path / "none"), "id", lambda df: df.where("id < 0"), parts=3)
    assert job.progress(spark).first()["left"] == 3 and job.results(spark) is None
    assert tuple(job.run(spark.range(10)).first()) == (3, 3, 0, 0, 0, 0) and job.results(spark) is None


TEXTS = {1: "a b b", 2: "b c", 3: "", 4: "c c d"}
CHANGES = [
    [(i, t, 0) for i, t in TEXTS.items()],
    [(1, "a e", 0), (2, None, 0), (5, "f b", 0), (5, "g b", 1), (6, None, 0), (4, None, 0), (4, "c d", 1)],
    [(2, "b again", 5), (3, "x", 0), (1, None, 0), (7, "q", 2), (7, None, 3)],
]


def state(changes):
    out = {}
    for batch in changes:
        for i in {c[0] for c in batch}:
            out[i] = max((c for c in batch if c[0] == i), key=lambda c: (c[2], c[1] is not None, c[1] or ""))[1]
    return {i: t for i, t in out.items() if t is not None}


def rows_of(made):
    return (
        sorted(tuple(r) for r in made.frequencies.select("doc_id", "term", "tf").collect()),
        sorted((r.term, r.df, round(r.idf, 9)) for r in made.terms.collect()),
        sorted((r.doc_id, round(r.norm, 9)) for r in made.norms.collect()),
        made.documents,
    )


@pytest.mark.parametrize("compact_after", [(), (0,), (1, 2)])
def test_segments_like_a_rebuild(spark, tmp_path, compact_after):
    found = SegmentedIndex(spark, str(tmp_path / "index"))
    assert found.index().documents == 0
    for number, batch in enumerate(CHANGES):
        changes = spark.createDataFrame(batch, "doc_id long, text string, seq int")
        found.apply(changes, number)
        found.apply(changes, number)  # tried again
        if number in compact_after:
            found.compact()
            found.compact()
            found.drop_dead()
        docs = spark.createDataFrame(list(state(CHANGES[: number + 1]).items()), "doc_id long, text string")
        assert rows_of(found.index()) == rows_of(index.build_index(docs)), number


def test_a_stream_of_changes(spark, tmp_path):
    folder, found = str(tmp_path / "changes"), SegmentedIndex(spark, str(tmp_path / "index"))
    for batch in CHANGES:
        spark.createDataFrame(batch, "doc_id long, text string, seq int").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("doc_id long, text string, seq int").parquet(folder)
        follow(stream, found, str(tmp_path / "checkpoint")).awaitTermination()
    docs = spark.createDataFrame(list(state(CHANGES).items()), "doc_id long, text string")
    assert rows_of(found.index()) == rows_of(index.build_index(docs))
