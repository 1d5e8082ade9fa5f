"""An index of texts by sampled grams of characters, for looking up long phrases without reading every text.

Of every WINDOW consecutive grams of GRAM characters the one whose hash is least is kept (the last one, of equal ones), so that a stretch of
GRAM + WINDOW - 1 characters has the same kept grams wherever it stands. The index has (gram, doc_id) for each kept gram of a text, some
two for WINDOW characters, in order of grams, how many texts have each gram, and the texts in order of ids. A phrase of that length or more
is looked up by the rarest of its own kept grams; texts that have it are read and compared. Shorter phrases go through the stored texts with
one automaton for all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import occurrences
from quernstone.operators.phrases import phrase_counts
from quernstone.operators.tables import small, stored

GRAM, WINDOW = 8, 24
#: Candidate texts of a batch up to which their ids are a filter where texts are read.
LISTED = 10_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def kept_grams(text: str) -> np.ndarray:
    """Hashes of the distinct grams that a text keeps; of a text with fewer than WINDOW grams, none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed = (hashed ^ codes[k : k + n]) * _MULTIPLIER
        hashed ^= hashed >> np.uint64(29)
    windows = np.lib.stride_tricks.sliding_window_view(hashed[::-1], WINDOW)  # from the end, so that argmin finds the last
    kept = np.unique(windows.argmin(axis=1) + np.arange(n - WINDOW + 1))
    return np.unique(hashed[::-1][kept]).view(np.int64)


def _with_grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram) of a column's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [kept_grams(x or "") for x in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.empty(0, np.int64), *grams]))], ["key", "gram"])

    read = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"key {read.schema['key'].dataType.simpleString()}, gram long").withColumnRenamed("key", key)


@dataclass
class GramIndex:
    """postings(gram, doc_id), frequencies(gram, df), texts(doc_id, hay)."""

    postings: DataFrame
    frequencies: DataFrame
    texts: DataFrame


def gram_index(texts: DataFrame) -> GramIndex:
    """The stored index of texts (doc_id, hay), which are normalised as the phrases will be."""
    kept = stored(texts.select("doc_id", "hay").repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    postings = stored(_with_grams(kept, "doc_id", "hay").repartitionByRange("gram", "doc_id").sortWithinPartitions("gram"))
    return GramIndex(postings, stored(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))), kept)


def look_up(index: GramIndex, phrases: DataFrame) -> DataFrame:
    """(doc_id, needle, n) of every text that holds a phrase (needle): what phrases.phrase_counts gives."""
    needles = stored(phrases.select("needle").where("needle <> ''").distinct())
    long = F.length("needle") >= GRAM + WINDOW - 1
    asked = _with_grams(needles.where(long), "needle", "needle").join(index.frequencies, "gram", "left")
    # a gram that no text has says that no text holds the phrase
    rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("x")).select("needle", "x.*").where("df > 0")
    met = stored(index.postings.join(small(rarest.select("needle", "gram")), "gram").select("doc_id", "needle"))
    ids = [r["doc_id"] for r in met.select("doc_id").distinct().limit(LISTED + 1).collect()]
    texts = index.texts.where(F.col("doc_id").isin(ids)) if len(ids) <= LISTED else index.texts
    found = texts.join(small(met, LISTED), "doc_id").where("contains(hay, needle)").select("doc_id", "needle", occurrences(F.col("hay"), F.col("needle")).alias("n"))
    short = needles.where(~long)
    return found if short.isEmpty() else found.unionByName(phrase_counts(index.texts, short))
