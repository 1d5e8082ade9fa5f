"""Which phrases of a batch each text contains, and how often.

A few phrases are looked for one after the other, in the JVM. Beyond FEW they go into one automaton, which passes over each
text once, however many they are; the batch is broadcast, and at most BATCH phrases at a time, so a larger one takes more passes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import occurrences

FEW, BATCH = 64, 100_000


def first_phrases(texts: DataFrame, phrases: DataFrame, *, batch: int = BATCH) -> DataFrame:
    """(doc_id, place): for each text (doc_id, hay) that holds a phrase (needle, place), the least place of those that it holds. One row for each
    text leaves a task, however many phrases it holds."""
    return _held(texts, phrases, batch, per_place=False).groupBy("doc_id").agg(F.min("place").alias("place"))


def first_texts(texts: DataFrame, phrases: DataFrame, *, batch: int = BATCH) -> DataFrame:
    """(place, at): for each phrase (needle, place) that a text (at, hay) holds, the least `at` of those texts. One row for each phrase and batch
    of rows leaves a task."""
    found = _held(texts.select(F.col("at").alias("doc_id"), "hay"), phrases, batch, per_place=True)
    return found.groupBy("place").agg(F.min("doc_id").alias("at"))


def with_first_phrase(texts: DataFrame, hay: str, phrases: DataFrame, name: str, *, batch: int = BATCH) -> DataFrame:
    """texts without the column hay, and with the least place of the phrases (needle, place) that it holds under a new name; other rows go. What
    first_phrases finds, without moving the texts to it."""
    wanted = phrases.select("needle", F.col("place").cast("long").alias("place")).where("needle <> '' AND place IS NOT NULL")
    parts = -(-wanted.count() // batch)
    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(max(parts, 1)))).groupBy("part", "needle").agg(F.min("place").alias("place"))
    out = texts.withColumn(name, F.lit(None).cast("long"))
    at, last, schema = out.columns.index(hay), len(out.columns) - 1, out.schema

    def of_part(df: DataFrame, k: int) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast([(r["needle"], r["place"]) for r in dealt.where(F.col("part") == k).collect()])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for needle, place in shared.value:
                automaton.add_word(needle, place)
            if len(automaton):
                automaton.make_automaton()
            for rows in batches:
                least = [min((p for _, p in automaton.iter(x.as_py() or "")), default=None) if len(automaton) else None for x in rows.column(at)]
                before = rows.column(last).to_pylist()
                found = [min((p for p in both if p is not None), default=None) for both in zip(before, least, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:last], pa.array(found, pa.int64())], names=rows.schema.names)

        return df.mapInArrow(find, schema)

    return reduce(of_part, range(parts), out).where(F.col(name).isNotNull()).drop(hay)


def _held(texts: DataFrame, phrases: DataFrame, batch: int, *, per_place: bool) -> DataFrame:
    """(doc_id, place) of texts and the phrases that they hold: of each text the least place, or, per_place, of each place the least
    text in a batch of rows."""
    wanted = phrases.select("needle", F.col("place").cast("long").alias("place")).where("needle <> '' AND place IS NOT NULL")
    n = wanted.count()
    read = texts.select("doc_id", "hay")
    kind = read.schema["doc_id"].dataType.simpleString()
    if not n:
        return read.select("doc_id", F.lit(0).cast("long").alias("place")).limit(0)
    parts = -(-n // batch)
    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts)))

    def of_part(k: int) -> DataFrame:
        named: dict[str, list[int]] = {}
        for r in dealt.where(F.col("part") == k).select("needle", "place").collect():
            named.setdefault(r["needle"], []).append(r["place"])
        shared = texts.sparkSession.sparkContext.broadcast([(x, places if per_place else [min(places)]) for x, places in named.items()])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for needle, places in shared.value:
                automaton.add_word(needle, places)
            if not len(automaton):  # a part without phrases
                return
            automaton.make_automaton()
            for rows in batches:
                ids, first_row, first_place = rows.column(0), {}, {}
                for i, hay in enumerate(rows.column(1)):
                    for p in {p for _, places in automaton.iter(hay.as_py() or "") for p in places}:
                        first_place[i] = min(p, first_place.get(i, p))
                        if per_place and (v := ids[i].as_py()) is not None and (p not in first_row or v < first_row[p][0]):
                            first_row[p] = v, i
                pairs = [(i, p) for p, (_, i) in first_row.items()] if per_place else list(first_place.items())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([p for _, p in pairs], pa.int64())], ["doc_id", "place"])

        return read.mapInArrow(find, f"doc_id {kind}, place long")

    return reduce(DataFrame.unionByName, [of_part(k) for k in range(parts)])


def phrase_counts(texts: DataFrame, phrases: DataFrame, *, few: int = FEW, batch: int = BATCH, prepare: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, needle, n) for texts (doc_id, hay) and phrases (needle), both normalised: n occurrences without overlap, at least one.
    prepare: normalises texts that aren't; then few phrases are looked for as many are."""
    needles = phrases.select("needle").where("needle <> ''").distinct()
    n = needles.count()
    if not n:
        return texts.select("doc_id", F.lit("").alias("needle"), F.lit(0).alias("n")).limit(0)
    if n <= few and prepare is None:
        return texts.select("doc_id", "hay").join(F.broadcast(needles), F.expr("contains(hay, needle)")).select("doc_id", "needle", occurrences(F.col("hay"), F.col("needle")).alias("n"))
    parts = -(-n // batch)
    dealt = needles.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts)))
    return reduce(DataFrame.unionByName, [_by_automaton(texts, dealt.where(F.col("part") == k), prepare) for k in range(parts)])


_BLANKS = b" \t\n\x0b\x0c\r"
#: First bytes of the white space beyond ASCII, and all white space that functions.text knows.
_FAR, _SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Letters whose lower case the JVM knows and Python may not, of Unicode 16; and the bytes that they begin with.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_NEWER_BYTES = re.compile(rb"\xe1\xb2\x89|\xea\x9f[\x8b\x8c\x9a\x9c]|\xf0\x90\xb5")


def normalized(text: str) -> str:
    """What text.normalize_text gives."""
    raw = text.encode()
    if _NEWER_BYTES.search(raw):
        text = text.translate(_NEWER)
        raw = text.encode()
    if _FAR.search(raw):
        return _SPACE.sub("", text).lower()
    return raw.translate(None, _BLANKS).decode().lower()


class _Heads:
    """Whether a text may hold one of many phrases, by their first 16 bytes, or 8 of shorter ones: what is left goes through the automaton."""

    SHORT, RUN, MIX = 16, 1 << 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, needles: Iterable[str]):
        found = [x.encode() for x in needles]
        self.short = [x for x in found if len(x) < 8]
        self.wanted = {x[:16] if len(x) >= 16 else x[:8] for x in found if len(x) >= 8}
        heads = np.array([int.from_bytes(x[:8], "little") for x in self.wanted], np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(heads * self.MIX) >> np.uint64(48)] = True

    def may(self, text: str) -> bool:
        raw = text.encode()
        if len(self.short) > self.SHORT or any(x in raw for x in self.short):
            return True
        for a in range(0, len(raw) - 7, self.RUN):
            words = np.ndarray(min(self.RUN, len(raw) - 7 - a), "<u8", raw, a, (1,))  # the eight bytes from each place on
            for i in np.flatnonzero(self.table[(words * self.MIX) >> np.uint64(48)]).tolist():
                if raw[a + i : a + i + 16] in self.wanted or raw[a + i : a + i + 8] in self.wanted:
                    return True
        return False


def counts_in_texts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase_counts of texts (doc_id, text) as they are: tasks normalise them, and look closer at those that have the head of a phrase."""
    return phrase_counts(texts.select("doc_id", F.col("text").alias("hay")), phrases, prepare=normalized)


def _by_automaton(texts: DataFrame, needles: DataFrame, prepare: Callable[[str], str] | None = None) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast([r["needle"] for r in needles.select("needle").collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for needle in shared.value:
            automaton.add_word(needle, needle)
        if not len(automaton):  # a part without phrases
            return
        automaton.make_automaton()
        heads = _Heads(shared.value)
        for batch in batches:
            at, needle, n = [], [], []
            for i, hay in enumerate(batch.column(1)):
                text = hay.as_py() or ""
                text = prepare(text) if prepare else text
                if not heads.may(text):
                    continue
                for x in {found for _, found in automaton.iter(text)}:
                    at.append(i)
                    needle.append(x)
                    n.append(text.count(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(needle, pa.string()), pa.array(n, pa.int32())], ["doc_id", "needle", "n"])

    read = texts.select("doc_id", "hay")
    return read.mapInArrow(find, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, needle string, n int")
