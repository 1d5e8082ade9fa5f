"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, runs of 64 words. Each passage is described by shares of byte classes, word lengths and
repetitions, and encoded by a small layer; gated attention, learnt from the labels of documents alone, weighs the
passages, and the weighted sum of their encodings gives the score.

Defined results
  null text: as empty; an empty text is one passage whose features are all 0 and is scored like any other.
  no labelled training row, or labels of one class only: every score is the share of label 1 among them (0 without any).
  a label that is null, or whose document is absent, isn't used; of several labels of an id the greatest is, of equal texts
  that with the least id. Repeated documents are scored each, equal texts alike; an empty table gives an empty result.
  very long texts: whole, with as many passages as they have; all features of a text are held at once.
  with_quality keeps all columns; a new one whose name is taken gets an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quernstone.llm.common import append_columns, below_share, fresh, labelled_sample, remainder, slices, stored, table

PASSAGE = 64
#: Labelled rows and characters of theirs that are learnt from, in expectation; this bounds what the driver fits (5 bytes a character).
TRAINING_ROWS, TRAINING_CHARS, STEPS, CODES, GATES = 6_000, 50_000_000, 300, 16, 8
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "mark": b"!?", "bar": b"|", "sign": b"#$%&*@^~_=+<>\\/{}[]", "quote": b"'\"()-", "line": b"\n", "blank": b" \t\r\x0b\x0c"}
_CLASS = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _i
_CLASS[128:] = len(_CLASSES) + 1
#: Besides the classes of bytes (lower-case letters are the class left over): per passage.
FEATURES = ["lower", *_CLASSES, "beyond", "word_bytes", "spread", "longest", "short", "distinct", "again", "words"]


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of passages of each text); every text has one passage at least."""
    raw = [(x or "").encode("utf-8", "replace") for x in texts]
    split = [x.split() for x in raw]
    n = np.array([len(w) for w in split])
    parts = np.maximum(1, -(-n // PASSAGE))
    first = np.r_[0, np.cumsum(parts)]
    out = np.zeros((first[-1], len(FEATURES)))
    if not n.sum():
        return out, parts
    word = np.concatenate([np.arange(k) for k in n])
    passage = np.repeat(first[:-1], n) + word // PASSAGE
    size = np.fromiter((len(w) for s in split for w in s), np.int64, n.sum())
    hashed = np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), np.uint64, n.sum())
    count = np.bincount(passage, minlength=first[-1])
    some = np.maximum(count, 1)
    # bytes: those of words by their passage, and white space by that of the text's last word before it
    flat = np.frombuffer(b"".join(raw), np.uint8)
    kinds = _CLASS[flat]
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    begins = np.r_[~blank[0], blank[:-1] & ~blank[1:]]
    edges = np.cumsum([len(x) for x in raw])[:-1]
    edges = edges[edges < len(flat)]
    begins[edges] = ~blank[edges]
    of = passage[np.maximum(np.cumsum(begins) - 1, 0)]
    classes = len(_CLASSES) + 2
    shares = np.bincount(of * classes + kinds, minlength=first[-1] * classes).reshape(-1, classes)
    out[:, :classes] = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)
    mean = np.bincount(passage, size, first[-1]) / some
    order = np.lexsort((hashed, passage))
    new = np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    same = np.r_[False, (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])]
    longest = np.zeros(first[-1])
    np.maximum.at(longest, passage, size)
    rest = [mean / 10, np.sqrt(np.maximum(0, np.bincount(passage, size**2.0, first[-1]) / some - mean**2)) / 10, np.log1p(longest) / 5, np.bincount(passage, size <= 3, first[-1]) / some, np.bincount(passage[order], new, first[-1]) / some, np.bincount(passage, same, first[-1]) / some, count / PASSAGE]
    out[:, classes:] = np.stack(rest, axis=1)
    return out, parts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class QualityModel:
    """The weights of the encoder, the gates and the classifier, or one share where nothing could be learnt."""

    def __init__(self, share: float, scale: tuple[np.ndarray, np.ndarray] | None = None, weights: dict[str, np.ndarray] | None = None):
        self.share, self.scale, self.weights = share, scale, weights

    def _forward(self, x: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, np.r_[0, np.cumsum(parts)[:-1]]
        x = (x - self.scale[0]) / self.scale[1]
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), parts))
        a = e / np.repeat(np.add.reduceat(e, at), parts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["bias"])}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return self._forward(*passage_features(texts))["p"] if texts else np.empty(0)

    def attention(self, text: str | None) -> np.ndarray:
        """The weight of each passage of a text."""
        return self._forward(*passage_features([text]))["a"]

    def _gradients(self, x: np.ndarray, parts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, parts)
        at = np.r_[0, np.cumsum(parts)[:-1]]
        d = (f["p"] - y) / len(y)
        dz = np.repeat(np.outer(d, w["out"]), parts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), parts))
        dtg = np.outer(de, w["attend"])
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        found = {"out": f["z"].T @ d, "bias": np.array(d.sum()), "attend": (f["t"] * f["g"]).T @ de, "value": f["h"].T @ dt, "gate": f["h"].T @ dg, "encode": f["x"].T @ dh, "encode_bias": dh.sum(axis=0)}
        return {k: g + 1e-4 * w[k] for k, g in found.items()}

    def fit(self, x: np.ndarray, parts: np.ndarray, y: np.ndarray, steps: int) -> None:
        rng = np.random.default_rng(5)
        self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        shape = {"encode": (x.shape[1], CODES), "encode_bias": (CODES,), "value": (CODES, GATES), "gate": (CODES, GATES), "attend": (GATES,), "out": (CODES,)}
        self.weights = {k: rng.normal(0, 0.5 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"bias": np.array(np.log(y.mean() / (1 - y.mean())))}
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            for k, g in self._gradients(x, parts, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def with_quality(self, docs: DataFrame, *, text_col: str = "text", out: str = "score") -> DataFrame:
        """docs with a column of scores from 0 to 1; one pass, no shuffle. The model, a few KB, is broadcast."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        return append_columns(docs, text_col, lambda texts: [pa.array(shared.value.scores(texts), pa.float64())], [(fresh(docs, out)[0], DoubleType())], 1_000_000)


def fit_quality(docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAINING_ROWS) -> QualityModel:
    """Learns from about most_rows labelled rows for which held_out (over the column id) is false."""
    sample = labelled_sample(docs, labels, label, F.lit(False) if held_out is None else held_out, most_rows, id_col, text_col)
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    sample = sample.where(below_share(F.xxhash64("id", F.lit(3)), TRAINING_CHARS / max(chars, 1)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1), 1_000_000):
                x, parts = passage_features(texts)
                ends = np.cumsum(parts)
                rows = [x[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(rows, pa.binary())], ["id", "label", "features"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = stored(sample.mapInArrow(describe, f"id {kind}, label double, features binary"), "quality").orderBy("id", "features").collect()
    y = np.array([r["label"] for r in rows])
    model = QualityModel(float(y.mean()) if len(y) else 0.0)
    if 0 < model.share < 1:
        bags = [np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES)) for r in rows]
        model.fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), y, STEPS)
    return model


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), held_out=remainder(F.col("id"), 5) == 0)
    scored = model.with_quality(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
