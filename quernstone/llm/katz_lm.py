"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts over all words.

p(w|h) is the discounted relative count of the pair (h, w) where training has it, else alpha(h) p(w): the recursion ends
with the discounted share of the word, and one kind of unseen word has what the discounts leave. alpha(h) spreads what is
left of a history over exactly the words that it wasn't seen with, so all words and the unseen one add up to 1.
The end of a text is a word, and the history of a text's first word.

Every pair of words is counted, and every token has its pair looked up, in tables that are partitioned by history. Two kinds of words
differ only in how they are stored. The HEAD most frequent ones have short numbers, which are broadcast with their counts.
Their pairs are gathered by history (those of the FRONT most frequent histories by pair) together with the rows
that have them, so that counting and looking up need one shuffle. A rarer word carries its neighbours: its group has
its own count and those of the pairs on both sides. Pairs of two of the FRONT words are looked up in a broadcast block.
So a key that is shuffled is a word or pair with at most one FRONT-th of all tokens, however frequent a word is.

Defined results
  null or empty text: the end token alone. No training text: every word is unseen, with probability 1.
  A history with reliable counts alone leaves the unseen pairs one count more than it has.
  Good-Turing discounts that come out beyond (0, 1), as with few counts, are replaced by (r - 0.5) / r.
  null and repeated ids: each row is scored; ids may be of any type; a null train mark counts as false.
  an empty table gives an empty result; columns besides the id, the text and the mark aren't read, whatever their names.
  very long texts: whole; all their tokens are held at once (8 bytes each, some times over).
  Words are told apart by 62 bits of a hash; ties of equal counts have no bearing on scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quernstone.llm.common import PLAIN, hashed_words, mixed, remainder, slices, stored, table

#: Words that are broadcast at most (36 bytes each), and the most frequent ones of them, whose pairs are a block of
#: FRONT * FRONT * 4 bytes = 16 MB; neither bounds a count or changes a score.
HEAD, FRONT = 1 << 19, 2_048
#: Counts up to this are discounted.
LEAST_RELIABLE = 5
#: Bytes of texts whose n-grams a task sums up at once.
CHUNK = 4_000_000
#: Tokens for each bucket of pairs, which a task gathers at once.
BUCKET_TOKENS, LEAST_BUCKETS = 2_000_000, 256
#: Keys of words have this bit; numbers of broadcast words are below 2^SHIFT.
RARE, SHIFT = 1 << 62, 21
END_WORD = RARE | 1
_COUNTS = [f"n{r}" for r in range(1, LEAST_RELIABLE + 2)]


def word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each token, tokens of each text); A-Z count as a-z, and every text ends with END_WORD."""
    word, n = hashed_words([(x or "").encode("utf-8", "replace").translate(PLAIN) for x in texts])
    keys = np.empty(len(word) + len(n), np.int64)
    last = np.cumsum(n + 1) - 1
    keys[last] = END_WORD
    inner = np.ones(len(keys), bool)
    inner[last] = False
    keys[inner] = np.maximum((word >> np.uint64(2)).astype(np.int64) | RARE, END_WORD + 1)
    return keys, n + 1


def discounts(n: dict[int, int], most: int = LEAST_RELIABLE) -> list[float]:
    """Good-Turing discounts of the counts 1 to most, from the numbers n of n-grams with each count (Katz's form)."""
    out = []
    first = n.get(1, 0)
    beyond = (most + 1) * n.get(most + 1, 0) / first if first else 1.0
    for r in range(1, most + 1):
        d = 0.0
        if n.get(r, 0) and n.get(r + 1, 0) and beyond < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.r_[0.0, d, 1.0][np.minimum(c, len(d) + 1)] * c


def _discounted_column(c: Column, d: list[float]) -> Column:
    return F.when(c <= len(d), F.get(F.array(*map(F.lit, d)), (c - 1).cast("int")) * c).otherwise(c.cast("double"))


def left_over(n: np.ndarray, kept: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, log10 of alpha) of histories: n is the count, kept the discounted counts of the words seen after it, p the
    sum of those words' own probabilities. A seen pair has factor times its discounted count."""
    n, kept, left = np.maximum(n, 1), np.maximum(kept, 1e-300), 1 - p
    none, reliable = left < 1e-12, kept >= n * (1 - 1e-12)
    factor = np.where(none, 1 / kept, np.where(reliable, 1 / (n + 1), 1 / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.log10((1 - factor * kept) / left)
    return factor, np.where(none, 0.0, alpha)


class Words:
    """The broadcast words by number (the more frequent, the smaller) with their counts and probabilities, and totals over all words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, d: list[float], unseen: float, front: int):
        order = np.lexsort((keys, -counts))
        self.counts, self.tokens, self.distinct, self.discounts, self.unseen = counts[order], tokens, distinct, d, unseen
        place = np.argsort(keys[order])
        self.keys, self.number = keys[order][place], place.astype(np.int64)
        self.end = int(self.number[np.searchsorted(self.keys, END_WORD)])
        self.p = _discounted(self.counts, d) / max(tokens, 1)
        self.front = min(front, len(keys))
        self.base_least = -np.log10(tokens + 0.5 * (distinct + 1))

    def log_p(self) -> np.ndarray:
        return np.log10(np.where(self.p > 0, self.p, self.unseen if self.unseen > 0 else 1.0))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or else key of each token, the same of the token before, tokens of each text)."""
        keys, n = word_keys(texts)
        one, inverse = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, one), len(self.keys) - 1)
        word = np.where(self.keys[at] == one, self.number[at], one)[inverse]
        return word, np.r_[self.end, word[:-1]][: len(word)], n


def count_words(texts: DataFrame, head: int = HEAD, front: int = FRONT) -> Words:
    """Counts all words of the column text; the most frequent ones, `head` at most, come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, rows in slices(batch.column(0), CHUNK):
                keys, n = np.unique(word_keys(rows)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "c"])

    counted = stored(texts.mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    # counts in classes, exact up to 64 and then some to each power of two: a few hundred rows for any input
    kind = F.when(F.col("c") <= 64, F.col("c")).otherwise(64 + F.floor(F.log2(F.col("c") / 64) * 8)).cast("long")
    classes = sorted(((r["kind"], r["v"], r["n"]) for r in counted.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()), reverse=True)
    tokens, distinct = sum(n for _, _, n in classes), sum(v for _, v, _ in classes)
    d = discounts({k: v for k, v, _ in classes if k <= 64})
    unseen = 1.0 - sum(_discounted(np.array([k]), d)[0] * v if k <= LEAST_RELIABLE else n for k, v, n in classes) / max(tokens, 1)
    least, room = classes[0][0] + 1 if classes else 0, min(head, (1 << SHIFT) - 2)
    for k, v, _ in classes:
        if v > room:
            break
        least, room = k, room - v
    found = counted.where((kind >= least) & (F.col("key") != END_WORD)).toArrow()
    end = counted.where(F.col("key") == END_WORD).first()
    keys, counts = (np.r_[found[c].to_numpy(), x].astype(np.int64) for c, x in (("key", END_WORD), ("c", end["c"] if end else 0)))
    return Words(keys, counts, tokens, distinct, d, max(unseen, 0.0) if tokens else 1.0, front)


def _split(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def pair_table(read: DataFrame, shared, buckets: int) -> DataFrame:
    """(key, c, first, row, k) for (row, train, text): each pair of broadcast words with its count in training and, unless
    both are of the FRONT, each row that has it, and how often; first marks one row of each pair."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for a, b, texts in slices(batch.column(2), CHUNK, 1 << 20):
                ids = np.r_[batch.column(0).to_numpy()[a:b], 0]
                train = np.r_[batch.column(1).to_numpy(zero_copy_only=False)[a:b], True]
                word, before, n = words.numbers(texts)
                owner = np.repeat(np.arange(b - a), n)
                front = (word < words.front) & (before < words.front)
                keep = (word < RARE) & (before < RARE) & (~front | train[owner])
                owner[front] = b - a  # no row of its own
                bits = int(b - a).bit_length()
                found, k = np.unique((before[keep] << SHIFT | word[keep]) << bits | owner[keep], return_counts=True)
                key, owner = found >> bits, found & ((1 << bits) - 1)
                history = key >> SHIFT
                bucket = (mixed(np.where(history < words.front, key, history).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) * 2 + train[owner]
                order = np.argsort(bucket, kind="stable")
                group, cuts = np.unique(bucket[order], return_index=True)
                cuts = np.r_[cuts, len(order)]
                lists = [_split(x[order], cuts) for x in (key, ids[owner], k.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(group // 2), pa.array(group % 2 == 1), *lists], ["bucket", "train", "key", "row", "k"])

    def gather(group: pa.Table) -> pa.Table:
        lists = [group.column(c).combine_chunks() for c in ("key", "row", "k")]
        key, row, k = (x.flatten().to_numpy() for x in lists)
        train = np.repeat(group.column("train").to_numpy(), lists[0].value_lengths().to_numpy())
        order = np.argsort(key, kind="stable")
        key, row, k, train = key[order], row[order], k[order], train[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        at = np.flatnonzero(first)
        c = np.repeat(np.add.reduceat(np.where(train, k, 0), at), np.diff(np.r_[at, len(key)])) if len(at) else np.empty(0, np.int64)
        front = shared.value.front
        keep = first | (key >> SHIFT >= front) | ((key & (1 << SHIFT) - 1) >= front)
        return pa.table([pa.array(x[keep]) for x in (key, c.astype(np.int64), first, row, k.astype(np.int32))], ["key", "c", "first", "row", "k"])

    dealt = read.mapInArrow(blocks, "bucket long, train boolean, key array<long>, row array<long>, k array<int>")
    return dealt.groupBy("bucket").applyInArrow(gather, "key long, c long, first boolean, row long, k int")


def rare_table(read: DataFrame, shared) -> DataFrame:
    """(x, before, after, row, train, p_after, c, c_in, c_out, first_in, first_out) for every token x that isn't broadcast: its neighbours,
    the probability of the one after it if that is broadcast, its count in training and those of the pairs that it's in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for a, b, texts in slices(batch.column(2), CHUNK, 1 << 20):
                word, before, n = words.numbers(texts)
                at = np.flatnonzero(word >= RARE)
                owner = np.repeat(np.arange(a, b), n)[at]
                after = word[at + 1]
                p = np.where(after < RARE, words.p[np.where(after < RARE, after, 0)], 0.0)
                train = batch.column(1).to_numpy(zero_copy_only=False)[owner].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word[at], before[at], after, batch.column(0).to_numpy()[owner], train, p)], ["x", "before", "after", "row", "train", "p_after"])

    found = read.mapInArrow(run, "x long, before long, after long, row long, train int, p_after double")
    # dealt by word once: the windows by word and neighbour need no further shuffle
    found = found.withColumn("c", F.sum("train").over(Window.partitionBy("x")))
    for side, name in (("before", "in"), ("after", "out")):
        pair = Window.partitionBy("x", side)
        found = found.withColumn(f"c_{name}", F.sum("train").over(pair)).withColumn(f"first_{name}", F.row_number().over(pair.orderBy("row")) == 1)
    return found


def _count_classes(c: Column) -> list[Column]:
    """How many pairs have each of the counts up to LEAST_RELIABLE + 1, and the sum of the other counts."""
    return [*[F.sum(F.when(c == r, 1).otherwise(0)).cast("double").alias(f"n{r}") for r in range(1, LEAST_RELIABLE + 2)], F.sum(F.when(c > LEAST_RELIABLE + 1, c).otherwise(0)).cast("double").alias("more")]


def _history_sums(pairs: DataFrame, shared) -> DataFrame:
    """(h, n1 ..., more, p) of the pairs of broadcast words, summed up batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            if batch.num_rows:
                key, c = (batch.column(i).to_numpy() for i in (0, 1))
                h, at = np.unique(key >> SHIFT, return_inverse=True)
                sums = [np.bincount(at, c == r, len(h)) for r in range(1, LEAST_RELIABLE + 2)]
                sums += [np.bincount(at, np.where(c > LEAST_RELIABLE + 1, c, 0), len(h)), np.bincount(at, words.p[key & (1 << SHIFT) - 1], len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, sums)], ["h", *_COUNTS, "more", "p"])

    kinds = ", ".join(f"{c} double" for c in [*_COUNTS, "more", "p"])
    return pairs.where("first AND c > 0").select("key", "c").mapInArrow(run, f"h long, {kinds}")


class KatzScores:
    """The tables of a corpus whose rows with a true mark are learnt from, and the scores of all its rows."""

    def __init__(self, docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", head: int | None = None, front: int | None = None):
        self.spark, self.id_col = docs.sparkSession, id_col
        read = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
        once = read.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty()
        whole = isinstance(read.schema["id"].dataType, IntegralType)
        self.read = read.withColumn("row", F.col("id").cast("long") if once and whole else F.xxhash64("id", "text"))
        self.words = count_words(read.where("train").select("text"), HEAD if head is None else head, FRONT if front is None else front)
        shared = self.spark.sparkContext.broadcast(self.words)
        tokens = self.read.select("row", "train", "text")
        size = self.words.tokens
        self.pairs = stored(pair_table(tokens, shared, max(LEAST_BUCKETS, -(-size // BUCKET_TOKENS))), "pairs", compression="zstd")
        self.rare = stored(rare_table(tokens, shared), "rare", compression="zstd")
        self.shared = shared
        self._weigh(shared)

    def _weigh(self, shared) -> None:
        """Sets the discounts of pairs and the factors and backoff weights of all histories: arrays for broadcast words, a table for rarer ones."""
        c_in, c_out, words = F.col("c_in"), F.col("c_out"), self.words
        p = F.when(F.col("c") > 0, _discounted_column(F.col("c"), words.discounts) / max(words.tokens, 1)).otherwise(words.unseen)
        before = self.rare.where("first_in AND c_in > 0").withColumn("p", p)
        sums = _history_sums(self.pairs, shared)
        into = before.where(F.col("before") < RARE).groupBy(F.col("before").alias("h")).agg(*_count_classes(c_in), F.sum("p").alias("p"))
        sums = sums.unionByName(into).groupBy("h").agg(*[F.sum(c).alias(c) for c in [*_COUNTS, "more", "p"]])
        sums = sums.select(F.col("h").cast("int").alias("h"), *[F.col(c).cast("int").alias(c) for c in _COUNTS], "more", "p")
        found = sums.toArrow()  # a row for each broadcast word
        after = stored(self.rare.where("first_out AND c_out > 0").groupBy("x").agg(F.first("c").alias("n"), *_count_classes(c_out), F.sum("p_after").alias("p")), "after")
        total = after.agg(*[F.sum(c) for c in _COUNTS]).first()
        classes = {r: int(found[c].to_numpy().sum(dtype=np.int64) + (total[r - 1] or 0)) for r, c in enumerate(_COUNTS, 1)}
        self.discounts = discounts(classes)
        h = found["h"].to_numpy()
        seen = {c: found[c].to_numpy() for c in [*_COUNTS, "more", "p"]}
        kept = sum(_discounted(np.array([r]), self.discounts)[0] * seen[c] for r, c in enumerate(_COUNTS, 1)) + seen["more"]
        factor, alpha = left_over(words.counts[h], kept, seen["p"])
        self.factor, self.alpha = np.zeros(len(words.counts)), np.zeros(len(words.counts))
        self.factor[h], self.alpha[h] = np.log10(factor), alpha
        del found, seen, kept, factor, alpha
        # of rarer histories: what rarer words after them have comes from those words' groups
        extra = before.where(F.col("before") >= RARE).groupBy(F.col("before").alias("x")).agg(F.sum("p").alias("extra"))
        kept = sum((F.col(c) * float(_discounted(np.array([r]), self.discounts)[0]) for r, c in enumerate(_COUNTS, 1)), F.col("more"))
        self.after = after.join(extra, "x", "left").select("x", "n", kept.alias("kept"), (F.col("p") + F.coalesce("extra", F.lit(0.0))).alias("p"))
        # pairs of the FRONT words
        size = words.front
        self.block = words.log_p()[:size].astype(np.float32) + self.alpha[:size, None].astype(np.float32)
        h, w = F.shiftright("key", SHIFT), F.col("key").bitwiseAND((1 << SHIFT) - 1)
        front = self.pairs.where((h < size) & (w < size)).select((h * size + w).cast("int").alias("at"), "c").toArrow()  # size * size at most
        at, score = front["at"].to_numpy(), np.log10(_discounted(front["c"].to_numpy(), self.discounts)).astype(np.float32)
        self.block.ravel()[at] = score + self.factor[at // size].astype(np.float32) if size else 0

    def _pair_scores(self, shared) -> DataFrame:
        """(row, score) of the pairs of broadcast words; sums are formed in the task before they move."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                key, c, row, k = (batch.column(i).to_numpy() for i in range(4))
                h, w = key >> SHIFT, key & (1 << SHIFT) - 1
                with np.errstate(divide="ignore"):
                    score = np.where(c > 0, np.log10(_discounted(c, m["discounts"])) + m["factor"][h], m["alpha"][h] + m["log_p"][w])
                keep = (h >= m["front"]) | (w >= m["front"])
                yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array((score * k)[keep])], ["row", "score"])

        return self.pairs.select("key", "c", "row", "k").mapInArrow(run, "row long, score double")

    def _rare_scores(self, shared) -> DataFrame:
        """(row, known, base, score) of the rarer words and the pairs that they're in."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                x = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
                inner, outer = x["before"] < RARE, x["after"] < RARE
                before, after = np.where(inner, x["before"], 0), np.where(outer, x["after"], 0)
                factor, alpha = left_over(x["n"], x["kept"], x["p"])
                with np.errstate(divide="ignore"):
                    p = np.log10(np.where(x["c"] > 0, _discounted(x["c"], m["word_discounts"]) / max(m["tokens"], 1), m["unseen"] if m["unseen"] > 0 else 1.0))
                    seen_in, seen_out = (np.log10(_discounted(x[c], m["discounts"])) for c in ("c_in", "c_out"))
                # a pair of two rarer words: what is known of the history is added in the history's group, the rest here
                score = np.where(x["c_in"] > 0, np.where(inner, seen_in + m["factor"][before], 0.0), np.where(inner, m["alpha"][before], 0.0) + p)
                score = score + np.where(x["c_out"] > 0, seen_out + np.log10(factor), np.where(x["n"] > 0, alpha, 0.0) + np.where(outer, m["log_p"][after], 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(x["row"]), pa.array((x["c"] > 0).astype(np.int64)), pa.array(np.log10(x["c"] + 0.5) + m["base_least"]), pa.array(score)], ["row", "known", "base", "score"])

        zero = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n", "kept", "p")]
        every = self.rare.select("x", "before", "after", "row", "c", "c_in", "c_out").join(self.after, "x", "left").select("before", "after", "row", "c", "c_in", "c_out", *zero)
        return every.mapInArrow(run, "row long, known long, base double, score double")

    def scores(self) -> DataFrame:
        """(id, n_tokens, n_known, base_score, score) for every row."""
        w = self.words
        arrays = {"discounts": self.discounts, "word_discounts": w.discounts, "factor": self.factor, "alpha": self.alpha, "log_p": w.log_p(), "front": w.front, "tokens": w.tokens, "unseen": w.unseen, "base_least": w.base_least}
        shared = self.spark.sparkContext.broadcast(arrays)
        counted, pairs_of_front = self.shared, self.spark.sparkContext.broadcast(self.block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, block = counted.value, pairs_of_front.value
            base = np.log10(words.counts + 0.5) + words.base_least
            for batch in batches:
                for a, b, texts in slices(batch.column(2)):
                    word, before, n = words.numbers(texts)
                    at = np.r_[0, np.cumsum(n)[:-1]]
                    number = np.where(word < RARE, word, 0)
                    front = (word < words.front) & (before < words.front)
                    known = (word < RARE) & (words.counts[number] > 0)
                    sums = known.astype(np.int64), np.where(word < RARE, base[number], 0.0), np.zeros(len(word))
                    sums[2][front] = block[before[front], word[front]]
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), *[pa.array(np.add.reduceat(x, at)) for x in sums]], ["row", "id", "n_tokens", "known", "base", "score"])

        id_type = self.read.schema["id"].dataType.simpleString()
        sums = self.read.select("row", "id", "text").mapInArrow(run, f"row long, id {id_type}, n_tokens long, known long, base double, score double")
        none = [F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("n_tokens")]
        pairs = self._pair_scores(shared).select("row", *none, F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
        rare = self._rare_scores(shared).select("row", *none, "known", "base", "score")
        every = sums.unionByName(pairs).unionByName(rare)
        total = every.groupBy("row").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("copies"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
        # equal rows have one sum over all of them, of which each has its part
        total = total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return total.select(F.col("id").alias(self.id_col), "n_tokens", F.expr("known div copies").alias("n_known"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    found = KatzScores(table(spark, sf_dir, "documents"), ~apart)
    return found.scores().select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", F.lit(found.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op7_lm_scores": op7_lm_scores}
SQL: dict[str, str] = {}
