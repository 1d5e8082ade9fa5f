"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A word's symbols form a linked list, its adjacent pairs a heap by (rank, place). The lowest pair is popped
and merged until none is left; the count is the initial symbols less the merges, and no identifier of a token is
made. Words repeat, so each worker keeps the counts of words it has met, in a table of bounded size.

Defined results
  null or empty text: no bytes, no tokens, not over the limit.
  a special token's string inside a text: one token, as the library has it by default.
  very long texts and words: whole; a word's heap holds its pairs. Ties of rank go to the leftmost pair, as in the library.
  repeated rows: one result row each; ids of any type, null ones too, are kept; an empty table gives an empty result; the
  columns besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table

#: Words whose counts a worker keeps; at this number it starts afresh. Longer words aren't kept.
KEPT_WORDS, KEPT_LENGTH = 300_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, and the
    other bytes in order for the letters from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens under the merges, word pattern and special tokens of one vocabulary file."""

    def __init__(self, content: bytes, pattern: str):
        spec = json.loads(content)
        letters = byte_letters()
        names = {letter: b for b, letter in enumerate(letters)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (names.setdefault(x, len(names)) for x in (a, b))
            self.merges.setdefault((left, right), (rank, names.setdefault(a + b, len(names))))
        self.find = regex.compile(pattern).findall
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.kept: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        symbols = list(word.encode("utf-8"))
        n = len(symbols)
        if n < 2:
            return n
        merges, last = self.merges, n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= last or (m := merges.get((symbols[i], symbols[j]))) is None or m[0] != rank:
                continue  # one of the two has gone into another merge since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            merged += 1
            if k < last:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return n - merged

    def count_plain(self, text: str) -> int:
        kept, total = self.kept, 0
        for word in self.find(text):
            n = kept.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.count_plain(x) for x in parts if x)


@lru_cache(maxsize=2)
def _counter(content: bytes, pattern: str) -> MergeCounter:
    return MergeCounter(content, pattern)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. vocabulary: path of a byte-level BPE file on the driver,
    whose content (1.5 MB, the same for any input) is broadcast. One pass, no shuffle."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in batches:
            n = pa.array([counter.count(x.as_py()) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    counted = read.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
