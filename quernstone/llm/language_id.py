"""Language identification by nearest centroids.

A text is a TF-IDF vector of hashed runs of three bytes (letters in lower case, all else a space), of length 1. Each language has
several centroids, clustered by spherical k-means over a bounded sample of its texts; a text has the language of
the centroid with the greatest cosine. A text that is farther from it than nearly all training texts of that
language and length were is rejected, whatever its length.

Defined results
  null text, or one without a letter: `und`, score 0, rejected. A text all of whose runs are unknown: the first language, score 0, rejected.
  no training text: every language is `und`. Ties: the language that comes first in order.
  a null language isn't learnt. Repeated rows: one result each, and each counts in training; an empty table gives an empty result.
  very long texts: whole; a text's grams are counted at once, some 20 bytes for each of its bytes.
  with_language keeps all columns; a new one whose name is taken gets an underscore in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from quernstone.llm.common import append_columns, fresh, remainder, slices, stored, table

BITS = 12
#: Sampled texts and centroids of each language, rounds of clustering.
TEXTS, CENTROIDS, ROUNDS = 1_500, 4, 6
#: A text is rejected beyond its language's distance at this quantile of the sample, and somewhat more. Bands of lengths up to
#: SHORT_BANDS, of which the sample has few texts, and longer ones with fewer than ENOUGH texts, reject below a share of the
#: cosine that nearly all texts had, in the short bands when they were cut to that length.
REJECTED, MARGIN, SHORT_BANDS, ENOUGH = 0.999, 1.15, 8, 500
CUT_REJECTED, CUT_SHARE = 0.95, 0.5
#: Where no language has 20 sampled texts, all have this share of the bound of their texts together.
RARE_SHARE = 0.5
#: Bytes and number of texts that are held at once.
BYTES_AT_ONCE, TEXTS_AT_ONCE = 500_000, 1_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 0 for b in range(256)], np.uint32)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of counts for each text."""
    raw = [(x or "").lower().encode("utf-8", "replace") for x in texts]
    flat = np.frombuffer(b"  ".join([b"", *raw, b""]), np.uint8)
    owner = np.repeat(np.arange(len(raw) + 1), [2, *[len(x) + 2 for x in raw]])
    c = _LETTERS[flat]
    a, b, d = c[:-2], c[1:-1], c[2:]
    real = np.flatnonzero(b > 0)
    gram = ((a[real] << 16 | b[real] << 8 | d[real]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at = (owner[real + 1] - 1) << BITS | gram.astype(np.int64)
    return np.bincount(at, minlength=len(raw) << BITS).reshape(len(raw), 1 << BITS)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1, or 0."""
    x = np.sqrt(gram_counts(texts).astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _length_band(texts: list[str | None]) -> np.ndarray:
    return np.minimum(np.log2([len(x or "") + 1 for x in texts]).astype(int), 12) if texts else np.empty(0, int)


class LanguageModel:
    """Languages in order, their centroids, and the least cosine of each language and band of lengths."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.least = languages, idf, centroids, owner, least

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        language = self.owner[best]
        known = np.array([bool(x and _LETTER.search(x)) for x in texts])
        rejected = ~known | (score < self.least[language, _length_band(texts)]) | (score <= 0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(language, known, strict=True)], np.where(known, score, 0), rejected

    def with_language(self, docs: DataFrame, *, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
        """docs with three further columns; one pass, no shuffle. The model, a few hundred KB for each language, is broadcast."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def compute(texts: list[str | None]) -> list[pa.Array]:
            language, score, rejected = shared.value.identify(texts)
            return [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]

        return append_columns(docs, text_col, compute, list(zip(fresh(docs, *names), (StringType(), DoubleType(), BooleanType()), strict=True)), BYTES_AT_ONCE, TEXTS_AT_ONCE)


def _gram_weights(training: DataFrame) -> np.ndarray:
    """IDF over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, _, texts in slices(batch.column(0), BYTES_AT_ONCE, TEXTS_AT_ONCE):
                total += (gram_counts(texts) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.r_[n, total])], ["gram", "n"])

    df = np.zeros((1 << BITS) + 1)
    for r in training.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"] + 1] = r["n"]
    return np.log1p(df[0] / (df[1:] + 1)).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def sample_bound(texts: int, n: int) -> int:
    """The greatest 64-bit hash of a sample of about `texts` of n rows, or of all if there are no more."""
    return 2**63 - 1 if n <= texts else texts * 2**64 // n - 2**63


def fit_languages(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", texts: int = TEXTS, centroids: int = CENTROIDS) -> LanguageModel:
    """Learns from the rows of docs that have a language and a letter. Document frequencies are those of all of them; the centroids are
    fitted to about `texts` rows of each language, chosen by the hash of their id and text."""
    training = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted((r["lang"], r["n"]) for r in sizes.collect())
    names = [x for x, _ in languages]
    if not names:
        return LanguageModel([], np.zeros(1 << BITS), np.zeros((0, 1 << BITS)), np.zeros(0, int), np.zeros((0, 13)))
    idf = _gram_weights(training)
    spark = docs.sparkSession
    # a row for each language; from Arrow, as rows of Python would start Python workers on the executors
    bounds = pa.table({"lang": pa.array(names, pa.string()), "k": pa.array(range(len(names)), pa.int32()), "bound": pa.array([sample_bound(texts, n) for _, n in languages], pa.int64())})
    shares = F.broadcast(spark.createDataFrame(bounds))
    sample = training.join(shares, "lang").where(F.col("h") <= F.col("bound"))
    shared = spark.sparkContext.broadcast(idf)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in slices(batch.column(2), BYTES_AT_ONCE, TEXTS_AT_ONCE):
                x = vectors(rows, shared.value).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(_length_band(rows), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["k", "h", "band", "x"])

    points = stored(sample.select("k", "h", "text").mapInArrow(describe, "k int, h long, band int, x binary"), "points").coalesce(8)
    start = points.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "x"))).where(F.col("r") <= centroids).orderBy("k", "h").collect()
    owner = np.array([r["k"] for r in start])
    middle = _normal(np.stack([np.frombuffer(r["x"], np.float16) for r in start]).astype(np.float32))
    for _ in range(ROUNDS):
        middle = _moved(points, middle, owner)
    return LanguageModel(names, idf, middle, owner, _bounds(_least_when_cut(sample, idf, middle, owner, len(names)), _least_cosines(points, middle, owner, len(names))))


def _bounds(cut: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least cosine by language and band of lengths: that of cut texts up to SHORT_BANDS, beyond that of whole ones. A band that
    the sample hardly has takes the next shorter one's; cosines rise with length, so no band has a higher bound than a longer one.
    A language with too few texts for any bound of its own has the bound that three quarters of the others don't exceed; if there is no
    other, a share of that of all texts together, which is the last row of both."""
    out = np.hstack([cut[:, : SHORT_BANDS + 1], least[:, SHORT_BANDS + 1 :]])
    for band in range(1, out.shape[1]):
        out[:, band] = np.where(np.isnan(out[:, band]), out[:, band - 1], out[:, band])
    few = np.isnan(np.hstack([cut[:-1, 1 : SHORT_BANDS + 1], least[:-1, SHORT_BANDS + 1 :]])).all(axis=1)
    out, together = out[:-1], out[-1]
    out[few] = RARE_SHARE * together if few.all() else np.quantile(out[~few], 0.75, axis=0)
    return np.ascontiguousarray(np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1])


def _least_when_cut(sample: DataFrame, idf: np.ndarray, middle: np.ndarray, owner: np.ndarray, languages: int) -> np.ndarray:
    """The cosine below which a text is rejected, by language and band of lengths, from training texts cut to the least length of each
    band: texts of every length have a bound, although the sample has few short ones."""
    shared = sample.sparkSession.sparkContext.broadcast((idf, middle, owner))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, middle, owner = shared.value
        for batch in batches:
            for a, b, rows in slices(batch.column(1), BYTES_AT_ONCE, TEXTS_AT_ONCE):
                k = batch.column(0).to_numpy()[a:b]
                for band in range(1, SHORT_BANDS + 1):
                    size = (1 << band) - 1
                    long = [i for i, x in enumerate(rows) if len(x) >= size and _LETTER.search(x[:size])]
                    if long:
                        cosine = np.where(owner[None] == k[long, None], vectors([rows[i][:size] for i in long], idf) @ middle.T, -1).max(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(k[long]), pa.array(np.full(len(long), band, np.int32)), pa.array(cosine, pa.float64())], ["k", "band", "cosine"])

    far = sample.select("k", "text").mapInArrow(cosines, "k int, band int, cosine double").rollup("band", "k").agg(F.percentile_approx("cosine", 1 - CUT_REJECTED, 10_000).alias("least"), F.count(F.lit(1)).alias("n"))
    least = np.full((languages + 1, 13), np.nan)
    least[:, 0] = 0
    for r in far.where("band IS NOT NULL AND (k IS NULL OR n >= 20)").collect():
        least[languages if r["k"] is None else r["k"], r["band"]] = CUT_SHARE * max(0.0, r["least"])
    return least


def _nearest(batch: pa.RecordBatch, middle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = batch.column(0).to_numpy()
    x = np.stack([np.frombuffer(v, np.float16) for v in batch.column(3).to_pylist()]).astype(np.float32)
    cosine = np.where(owner[None] == k[:, None], x @ middle.T, -1)
    return k, x, cosine.argmax(axis=1), cosine.max(axis=1)


def _moved(points: DataFrame, middle: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One round: every text goes to its language's nearest centroid, which becomes the mean of its texts."""
    shared = points.sparkSession.sparkContext.broadcast((middle, owner))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, owner = shared.value
        total = np.zeros_like(middle)
        for batch in batches:
            if batch.num_rows:
                _, x, best, _ = _nearest(batch, middle, owner)
                np.add.at(total, best, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float32()))], ["c", "x"])

    total = np.zeros_like(middle)
    for r in points.mapInArrow(sums, "c long, x array<float>").toLocalIterator():
        total[r["c"]] += np.array(r["x"], np.float32)
    return np.where(total.any(axis=1, keepdims=True), _normal(total), middle)


def _least_cosines(points: DataFrame, middle: np.ndarray, owner: np.ndarray, languages: int) -> np.ndarray:
    """The cosine below which a text is rejected, by language and band of lengths (powers of two)."""
    shared = points.sparkSession.sparkContext.broadcast((middle, owner))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, _, _, cosine = _nearest(batch, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(2), pa.array(cosine, pa.float64())], ["k", "band", "cosine"])

    quantiles = F.percentile_approx("cosine", [1 - REJECTED, 1 - CUT_REJECTED], 10_000)
    far = points.mapInArrow(cosines, "k int, band int, cosine double").rollup("band", "k").agg(quantiles.alias("q"), F.count(F.lit(1)).alias("n"))
    least = np.full((languages + 1, 13), np.nan)
    for r in far.where("band IS NOT NULL AND (k IS NULL OR n >= 20)").collect():
        least[languages if r["k"] is None else r["k"], r["band"]] = max(0.0, 1 - MARGIN * (1 - r["q"][0]) if r["n"] >= ENOUGH else CUT_SHARE * r["q"][1])
    return least


def keep_known(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected."""
    names = fresh(docs, "_language", "_score", "_rejected")
    return model.with_language(docs, text_col=text_col, names=tuple(names)).where(~F.col(names[2])).drop(*names)


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, 4) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    found = model.with_language(docs.select("doc_id", "text"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
