"""Cutting a plan's lineage at tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most; a larger one is left to the planner.
BATCH = 10_000


def small(df: DataFrame, most: int = BATCH) -> DataFrame:
    """df to be broadcast, if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df



def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, a local master gets a folder of its own, and a
    cluster, whose machines would each write to their own disk, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder, from which later work restarts."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the session's JVM ends: later reads are pruned to the columns
    and row groups that they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
