"""What several of the operators need: tables in the shared folder, token lists, stable splits.

Null texts are read as empty ones throughout; an operator that treats them apart says so.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {ord(c): c.lower() for c in ASCII_UPPER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The words of a text with A-Z in lower case."""
    return WORD.findall((text or "").translate(_LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a folder of its own,
    and a cluster, whose machines would each write to their own disk, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: later work restarts there,
    not at the input, when an executor is lost. The folder goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of texts whose words are told apart by white space, and whose A-Z count as a-z, as hashed_words takes them.
PLAIN = bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that are hashed at once, with some 40 bytes of memory for each.
PIECE = 250_000
_BYTES = np.random.default_rng(41).integers(0, 1 << 64, 256, dtype=np.uint64)
_RATIO = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE - 1, np.uint64(pow(_RATIO, -1 if inverse else 1, 1 << 64)))])


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each text) for texts whose words are separated by spaces: a polynomial of each word's bytes,
    from sums that run over PIECE bytes at once."""
    data = b" ".join([*texts, b""])
    flat = np.frombuffer(data, np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(data):
        b = data.rfind(b" ", a, a + PIECE) + 1
        if b:
            piece = flat[a:b]
            edge = np.diff((piece != 32).view(np.int8), prepend=0)
            first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            total = np.r_[np.uint64(0), np.cumsum(_BYTES[piece] * _powers(False)[: len(piece)], dtype=np.uint64)]
            starts.append(first + a)
            hashes.append(mixed((total[end] - total[first]) * _powers(True)[first]))
        else:  # one word longer than a piece
            b = data.find(b" ", a + PIECE) + 1
            starts.append(np.array([a]))
            hashes.append(np.array([xxhash.xxh3_64_intdigest(data[a : b - 1])], np.uint64))
        a = b
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor: the split that training and held-out rows are told apart by."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor)).cast("int")


def slices(column: pa.Array, most_bytes: int = 2_000_000, most_rows: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, end, texts) of runs of an Arrow batch's texts with about most_bytes and at most most_rows each: of a batch
    of long texts, or of very many, only one run at a time is turned into Python strings and arrays."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "left")) + 1)
        end = min(end, len(ends), start + most_rows)
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(df: DataFrame, text_col: str, compute: Callable[[list[str | None]], list[pa.Array]], fields: list[tuple[str, DataType]], most_bytes: int = 2_000_000, most_rows: int = 1 << 20) -> DataFrame:
    """df with further columns that compute makes from the texts, in one pass over Arrow batches.

    compute gets a run of whole texts with about most_bytes bytes, and most_rows texts at most, and returns an array for each field.
    """
    out = StructType([*df.schema.fields, *[StructField(name, kind) for name, kind in fields]])
    names, at = out.names, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(at), most_bytes, most_rows):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *compute(texts)], names)

    # by place: names may hold dots, which mapInArrow takes for fields
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, out)


def below_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least `share` of all; exact for shares far below one in a million as well."""
    return F.lit(True) if share >= 1 else h < F.lit(int(share * 2**64) - 2**63)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of about `most` labelled rows that aren't held out, or of all if there are fewer: a row is in by the
    hash of its id. The sampled ids, at most a few MB by that bound, are broadcast, so that texts don't move. An id with
    several labels has the greatest; of equal texts the one with the least id counts (of several texts of an id, each), so that
    the sample is the same however the rows are dealt out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).where(~held_out)
    ids = known.where(below_share(F.xxhash64("id"), most / max(known.count(), 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    one = rows.groupBy("text").agg(F.min(F.struct("id", "label")).alias("least"))
    return stored(one.select("least.id", "text", "least.label"), "sample")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the least node that can be reached.

    Large-star and small-star steps in turn: every node's larger neighbours, then its smaller ones, are tied to the least of
    them all, until only stars are left. Minima are combined before they are shuffled, and each round's edges are written
    to the shared folder."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        heads = edges.select(F.col("b").alias("a")).distinct()
        if edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and edges.join(heads, "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
