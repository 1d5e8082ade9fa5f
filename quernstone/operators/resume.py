"""Jobs that are taken up where they stopped: work on a table in parts, and a manifest of the parts that are done.

Rows are dealt to parts by a hash of their key. A part's results are one folder of the target, and its line in the manifest, written after
them, has its totals; so a part is done or not there, whatever is lost meanwhile. A run works on the parts that the manifest lacks,
`at_once` of them at a time, which is how much a failure costs; within that, Spark tries lost tasks again by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Job:
    """work: what is made of rows, a row-wise or key-wise DataFrame transformation; ok: whether a result counts as done, for the totals.

    The manifest also has a mark of the job (parts and `version`); a target that another job began is refused."""

    def __init__(self, target: str, key: str, work: Callable[[DataFrame], DataFrame], *, parts: int = 64, version: str = "1", ok: Column | None = None):
        self.target, self.key, self.work, self.parts = target.rstrip("/"), key, work, parts
        self.mark, self.ok = f"{version}/{key}/{parts}", F.lit(True) if ok is None else ok

    def manifest(self, spark: SparkSession) -> DataFrame | None:
        """(part, total, ok, failed, mark) of the parts that are done; None before the first one is."""
        store, path = _folder(spark, f"{self.target}/manifest")
        if not store.exists(path):
            return None
        return spark.read.schema("part int, total long, ok long, failed long, mark string").json(f"{self.target}/manifest/*")

    def done(self, spark: SparkSession) -> set[int]:
        found = self.manifest(spark)
        rows = found.select("part", "mark").collect() if found else []  # a row for each part
        if any(r["mark"] != self.mark for r in rows):
            raise ValueError(f"{self.target} belongs to another job")
        return {r["part"] for r in rows}

    def run(self, rows: DataFrame, *, at_once: int = 8, most: int | None = None) -> DataFrame:
        """Works on what is left, at most `most` parts of it, and gives progress()."""
        spark = rows.sparkSession
        left = sorted(set(range(self.parts)) - self.done(spark))[:most]
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))
        for k in range(0, len(left), at_once):
            now = left[k : k + at_once]
            for part in now:  # a folder without its line is of a run that stopped
                store, path = _folder(spark, f"{self.target}/data/part={part}")
                store.delete(path, True)
            batch = dealt.where(F.col("_part").isin(now))
            made = self.work(batch.drop("_part")).withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))
            made.write.mode("append").partitionBy("part").parquet(f"{self.target}/data")
            asked, found = spark.createDataFrame([(p,) for p in now], "part int"), self._read(spark, now)
            counts = [F.lit(0).alias(c) for c in ("total", "ok")]
            if found is None:  # no results at all
                asked = asked.select("part", *counts)
            else:
                totals = found.groupBy("part").agg(F.count(F.lit(1)).alias("total"), F.count_if(self.ok).alias("ok"))
                asked = asked.join(totals, "part", "left").fillna(0)
            lines = asked.select("part", "total", "ok", (F.col("total") - F.col("ok")).alias("failed"), F.lit(self.mark).alias("mark"))
            lines.coalesce(1).write.mode("overwrite").json(f"{self.target}/manifest/batch-{now[0]}-{now[-1]}-{len(now)}")
        return self.progress(spark)

    def _read(self, spark: SparkSession, parts: list[int]) -> DataFrame | None:
        """Results of some parts; None if none of them gave any."""
        folders = [f"{self.target}/data/part={p}" for p in parts]
        there = [f for f in folders if (found := _folder(spark, f))[0].exists(found[1])]
        return spark.read.option("basePath", f"{self.target}/data").parquet(*there) if there else None

    def results(self, spark: SparkSession) -> DataFrame | None:
        """The results of the parts that are done; None if there are none."""
        found = self._read(spark, sorted(self.done(spark)))
        return found.drop("part") if found is not None else None

    def progress(self, spark: SparkSession) -> DataFrame:
        """(parts, done, left, total, ok, failed) in one row."""
        found = self.manifest(spark)
        found = spark.createDataFrame([], "part int, total long, ok long, failed long") if found is None else found
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "ok", "failed")]
        return found.agg(F.count(F.lit(1)).alias("done"), *sums).select(F.lit(self.parts).alias("parts"), "done", (F.lit(self.parts) - F.col("done")).alias("left"), "total", "ok", "failed")
