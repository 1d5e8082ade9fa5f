"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon of words and word stems that is mined from the training labels, nearness of its words to
second-person words, capitals, punctuation, and obfuscation (letters mixed with digits or signs, drawn-out letters,
lexicon words that appear once such signs are undone).

Defined results
  null text: as empty; an empty text has all-zero features and is scored like any other.
  no labelled training row, or labels of one class only: every score is the share of label 1 among them (0 without any).
  a label that is null, or whose document is absent, isn't used; of several labels of an id the greatest is, of equal texts
  that with the least id. Repeated documents are scored each; an empty table gives an empty result.
  very long texts: whole, split into words at once. Ties: equal features have equal scores; of lexicon words that are equally
  telling the first in order counts.
  with_toxicity keeps all columns; a new one whose name is taken gets an underscore in front. score_toxicity reads no others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quernstone.llm.common import append_columns, fresh, labelled_sample, remainder, slices, stored, table

#: Labelled rows that the trees and the lexicon learn from, in expectation.
TRAINING_ROWS = 20_000
#: Words or stems of the lexicon at most, toxic documents that one must be in, and candidates that are counted.
LEXICON_SIZE, LEXICON_DOCS, CANDIDATES = 600, 5, 40_000
STEMS = range(4, 9)
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
UNDO = str.maketrans("013457@$!€", "oieastasie")
FEATURES = ["hits", "hit_density", "distinct_hits", "weight", "near_second", "second_density", "upper", "all_caps", "punctuation", "exclamation", "question", "mixed", "drawn_out", "undone_hits", "words", "word_length", "signs"]
_LEX, _SECOND, _CAPS, _MIXED, _DRAWN, _UNDONE = 1, 2, 4, 8, 16, 32


def features_of_word(word: str) -> Iterable[str]:
    """The word, and its first letters for several lengths with a star."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def bare(token: str) -> str:
    return token.lower().strip(".,;:!?\"'()[]{}<>«»„“”‚‘’…-*#%&$|_")


class WordClasses:
    """What each token is, looked up in the lexicon once and then kept in a table of bounded size."""

    def __init__(self, lexicon: dict[str, float], most: int = 150_000):
        self.lexicon, self.most = lexicon, most
        self.kept: dict[str, int] = {}
        self.weight: dict[str, float] = {}

    def in_lexicon(self, word: str) -> float:
        return max((self.lexicon.get(x, 0.0) for x in features_of_word(word)), default=0.0)

    def classify(self, token: str) -> int:
        word, found = bare(token), 0
        if weight := self.in_lexicon(word):
            found |= _LEX
        if word in SECOND_PERSON:
            found |= _SECOND
        if len(word) > 1 and token.upper() == token and token.lower() != token:
            found |= _CAPS
        if any(map(str.isalpha, word)) and not word.replace("-", "").replace("'", "").isalpha():
            found |= _MIXED
        if any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            found |= _DRAWN
        if not found & _LEX and found & (_MIXED | _DRAWN):
            plain = "".join(c for c in word.translate(UNDO) if c.isalpha())
            short = "".join(c for c, d in zip(plain, " " + plain) if c != d)
            if weight := self.in_lexicon(plain) or self.in_lexicon(short):
                found |= _UNDONE
        if weight:
            self.weight[token] = weight
        self.kept[token] = found
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        if len(self.kept) >= self.most:  # between texts, so that a text's words all have their weights
            self.kept.clear()
            self.weight.clear()
        get, classify = self.kept.get, self.classify
        kinds = np.array([k if (k := get(t)) is not None else classify(t) for t in tokens], np.int64)
        n = len(tokens)
        hit = np.flatnonzero(kinds & (_LEX | _UNDONE))
        second = np.flatnonzero(kinds & _SECOND)
        words = [tokens[i] for i in hit]
        near = 0
        if len(hit) and len(second):
            at = np.searchsorted(second, hit)
            left = hit - second[np.maximum(at - 1, 0)]
            right = second[np.minimum(at, len(second) - 1)] - hit
            near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
        chars = len(text)
        letters = sum(map(len, tokens))
        signs = sum(map(text.count, "#$%&*|@_~^"))
        return [
            float(np.log1p(len(hit))), len(hit) / n, float(np.log1p(len({bare(w) for w in words}))), float(sum(self.weight.get(w) or self.in_lexicon(bare(w)) for w in words) / n), near / n, len(second) / n,
            _upper_share(text), int((kinds & _CAPS > 0).sum()) / n, sum(map(text.count, ".,;:-")) / chars, text.count("!") / chars, text.count("?") / chars,
            int((kinds & _MIXED > 0).sum()) / n, int((kinds & _DRAWN > 0).sum()) / n, int((kinds & _UNDONE > 0).sum()) / n, float(np.log1p(n)), letters / n, signs / chars,
        ]


def _upper_share(text: str) -> float:
    lower = text.lower()
    if len(lower) != len(text):
        return sum(map(str.isupper, text)) / len(text)
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, lower))
    return float((a != b).mean())


def mine_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems with their log-odds, from (text, label): those that toxic documents have far more often than others."""

    def counts(label: int, wanted=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for text in (t for batch in batches for _, _, texts in slices(batch.column(0)) for t in texts):
                have = {f for w in {bare(t) for t in text.split()} if len(w) > 1 for f in features_of_word(w)}
                found.update(have if wanted is None else have & wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

        rows = sample.where(F.col("label") == label).select("text").mapInArrow(run, "feature string, n long")
        return rows.groupBy("feature").agg(F.sum("n").alias("n"))

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = {r["feature"]: r["n"] for r in counts(1).where(F.col("n") >= LEXICON_DOCS).orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    if not toxic or not size.get(0.0):
        return {}
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))
    other = {r["feature"]: r["n"] for r in counts(0, wanted).collect()}
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    scored = [(float(odds(k, size[1.0]) - odds(other.get(f, 0), size[0.0])), k, f) for f, k in toxic.items() if k / (k + other.get(f, 0) + 3) >= 0.6]
    return {f: weight for weight, _, f in sorted(scored, key=lambda x: (-x[1] * x[0], x[2]))[:LEXICON_SIZE]}


class ToxicityModel:
    """A lexicon of bounded size, boosted trees and a calibration, or one share where no trees could be fitted."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, share: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def with_features(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.lexicon)
        kept: list[WordClasses] = []

        def compute(texts: list[str | None]) -> list[pa.Array]:
            if not kept:
                kept.append(WordClasses(shared.value))
            return [pa.array([kept[0].features(t) for t in texts], pa.list_(pa.float64()))]

        return append_columns(df, text_col, compute, [(out, ArrayType(DoubleType()))])

    def with_toxicity(self, df: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """df with a column of scores from 0 to 1. One pass, no shuffle."""
        (out,) = fresh(df, out)
        if self.trees is None:
            return df.withColumn(out, F.lit(float(self.share)))
        raw, vector, p, *rest = fresh(df.withColumn(out, F.lit(0)), "_features", "_vector", "_margin", "_raw", "_probability", "_prediction", "_calibrated")
        scored = self.with_features(df, text_col, raw).withColumn(vector, array_to_vector(raw)).drop(raw)
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(rest[0]).setProbabilityCol(rest[1]).setPredictionCol(rest[2])
        scored = trees.transform(scored).withColumn(p, F.get(vector_to_array(rest[1]), F.lit(1)))
        scored = self.calibration.copy().setFeaturesCol(p).setPredictionCol(rest[3]).transform(scored)
        return scored.withColumn(out, F.least(F.greatest(F.col(rest[3]), F.lit(0.0)), F.lit(1.0))).drop(vector, p, *rest)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learns from about most_rows labelled rows for which held_out (over the column id) is false: four fifths of them
    give the lexicon and the trees, the rest the calibration."""
    sample = labelled_sample(docs, labels, label, F.lit(False) if held_out is None else held_out, most_rows, id_col, text_col)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)))
    fitting = sample.where("fold > 0")
    seen = {r["label"]: r["n"] for r in fitting.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = seen.get(1.0, 0) / max(1, sum(seen.values()))
    if not 0 < share < 1:
        return ToxicityModel({}, share=share)
    model = ToxicityModel(mine_lexicon(fitting))
    ready = stored(model.with_features(sample, "text", "features").select("id", "label", "fold", "features"), "toxicity")
    # most_rows rows of a few numbers, in one order: the trees don't depend on how the rows are dealt out
    ready = ready.repartition(1).sortWithinPartitions("id", "features").withColumn("features", array_to_vector("features")).cache()
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=17).fit(ready.where("fold > 0"))
    held = trees.transform(ready.where("fold = 0")).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    if held.select("label").distinct().count() < 2:
        held = trees.transform(ready).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    ready.unpersist()
    return ToxicityModel(model.lexicon, trees, calibration, share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted) for every row."""
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = model.with_toxicity(read, "_text", "score")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out=remainder(F.col("id"), 5) == 0)
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
