"""Encoding, decoding and counting against the libraries, and language-model scores against the recursion written out."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quernstone.llm import common
from quernstone.llm import katz_lm as K
from quernstone.llm import sentencepiece_codec as S
from quernstone.llm import token_counts as C

PIECES, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
ODD = [None, "", " ", "  two  spaces ", "▁▁ marks ▁", "aaaaaaaaaaaaaaaaaaaa", "日本語テキスト", "emoji 👩‍👩‍👧 é", "\t tab\nline\r\n", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "x" * 5000, "the quick " * 3000, "﻿bom \u0000 nul", "ﬁ ligature ½", "don't we'll I'M"]


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop  \n.,!▁éßñ中文字0123456789'ABC👍"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, data):
    real = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(120).collect()]
    return ODD + random_texts(3, 150) + real + real[:3]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS id", "'y' AS n_tokens")


def test_pieces_like_the_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(spark, texts)
    ids = {r.doc_id: r.ids for r in S.encode_texts(docs, PIECES).collect()}
    back = {r.doc_id: r.text for r in S.decode_ids(S.encode_texts(docs, PIECES), PIECES).collect()}
    rows = {r.doc_id: r for r in S.piece_digests(docs, PIECES).collect()}
    for i, t in enumerate(texts):
        want = model.encode(t or "")
        assert ids[i] == want and back[i] == model.decode(want), t
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(model.decode(want).encode()).hexdigest()
    assert len(rows) == len(texts) and S.piece_digests(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("long", [2, 512])
def test_long_words_like_the_library(monkeypatch, long):
    monkeypatch.setattr(S, "LONG", long)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as file:
        codec = S.PieceCodec(file.read())
    rng = random.Random(12)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ABCab01+/", 20_000), ("中文字日本語", 9_000), ("a", 5_000), ("ab", 3_000))]
    texts += ["".join(rng.choice("aabcdeflnorst ▁.é") for _ in range(rng.choice([3, 50, 600]))) for _ in range(100)]
    for text in texts:
        want = model.encode(text)
        assert codec.encode(text) == want and codec.decode(want) == model.decode(want)
    assert [(n, d) for n, _, d in codec.digests(texts)] == [(len(ids), hashlib.sha256(model.decode(ids).encode()).hexdigest()) for ids in map(model.encode, texts)]


def test_a_megabyte_without_spaces():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as file:
        codec = S.PieceCodec(file.read())
    rng = random.Random(13)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    assert codec.encode(text) == model.encode(text)


def test_vocabularies_that_are_not_carried_over(monkeypatch):
    monkeypatch.setattr(S.PieceCodec, "split", lambda self, text: [text.lower()] if text else [])
    with open(PIECES, "rb") as file, pytest.raises(ValueError):
        S.PieceCodec(file.read())


def test_counts_like_the_library(spark, texts):
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    library.no_padding()
    rows = {r.doc_id: r for r in C.count_tokens(frame(spark, texts), BYTES, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert rows[i].n_bytes == len((t or "").encode()) and rows[i].over_limit == (rows[i].n_tokens > 1024)


def katz(training, texts, vocabulary):
    """The recursion, token by token, with dictionaries."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    words = Counter(x for t in training for x in tokens(t))
    total = sum(words.values())
    d1 = K.discounts(Counter(words.values()))
    cut = lambda c, d: d[c - 1] * c if c <= len(d) else c
    p1 = {w: cut(c, d1) / total for w, c in words.items()}
    unseen = 1 - sum(p1.values())
    by_count = sorted((w for w in words if w is not None), key=lambda w: (-words[w], w))
    head = set(by_count[:vocabulary])
    of = lambda w: w if w is None or w in head else "rare"
    class_p = {w: p1[w] for w in head | {None}}
    class_p["rare"] = max(1 - sum(class_p.values()), unseen)
    pairs = Counter((of(a), of(b)) for t in training for a, b in zip([None, *tokens(t)], tokens(t)))
    d2 = K.discounts(Counter(pairs.values()))
    history = Counter()
    for (a, _), c in pairs.items():
        history[a] += c

    def p2(a, b):
        a, b = of(a), of(b)
        after = {y: c for (x, y), c in pairs.items() if x == a}
        if not after:
            return class_p[b]
        n, kept, left = history[a], sum(cut(c, d2) for c in after.values()), 1 - sum(class_p[y] for y in after)
        if left < 1e-12:
            return cut(after[b], d2) / kept
        scale = n / (n + 1) if kept >= n * (1 - 1e-12) else 1
        return scale * cut(after[b], d2) / n if b in after else (1 - scale * kept / n) / left * class_p[b]

    def p(a, b):
        return p2(a, b) * (1 if of(b) != "rare" else p1.get(b, unseen) / class_p["rare"])

    base = lambda t: sum(math.log10((words[x] + 0.5) / (total + 0.5 * (len(words) + 1))) for x in tokens(t))
    score = lambda t: sum(math.log10(p(a, b)) for a, b in zip([None, *tokens(t)], tokens(t)))
    return words, p, [(len(tokens(t)), sum(x in words for x in tokens(t)), base(t), score(t)) for t in texts]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(K, "LEAST_BUCKETS", 3)


TRAINING = ["a b a b c", "a b d A", "c a b", "e f a b c c", "a a b", None, "", "a b c d e f g h", "a b " * 12, "h g f x y z", "a c"]


def scored(spark, training, texts, **sizes):
    """The rows of texts, whose ids follow those of the training texts."""
    every = [(i, t, i < len(training)) for i, t in enumerate([*training, *texts])]
    docs = spark.createDataFrame(every, "doc_id long, text string, mark boolean").selectExpr("*", "1 AS row", "2 AS key")
    rows = {r.doc_id - len(training): r for r in K.KatzScores(docs, K.F.col("mark"), **sizes).scores().collect()}
    assert len(rows) == len(every)
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize("sizes", [{"head": 0, "front": 0}, {"head": 3, "front": 2}, {"head": 100, "front": 3}, {}])
def test_katz_like_the_recursion(spark, sizes):
    texts = [*TRAINING, "q", "q q a b zz", "b a", "g h i j", "a b c", "x y z", "z y x", "f g zz h", "y y y"]
    words, p, want = katz(TRAINING, texts, 1_000)
    for (n, known, base, score), r in zip(want, scored(spark, TRAINING, texts, **sizes), strict=True):
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-5)
    for h in (None, b"a", b"c", b"x", b"never"):
        assert sum(p(h, w) for w in words) + p(h, b"never seen") == pytest.approx(1, abs=1e-9)


def test_katz_on_real_texts(spark, texts):
    training, others = texts[::2], texts[1::2]
    want = katz(training, others, 1_000_000)[2]
    for (n, known, base, score), r in zip(want, scored(spark, training, others, head=50, front=20), strict=True):
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5)


def test_word_keys(monkeypatch):
    texts = [None, "", " a  B\ta\n", "x" * 300 + " y", "b", "é É", "a" * 99 + " " + "a" * 100]
    keys, n = K.word_keys(texts)
    assert n.tolist() == [1, 1, 4, 3, 2, 3, 3]
    assert keys[2] == keys[4] and keys[3] == keys[9] and len(set(keys.tolist())) == 9
    monkeypatch.setattr(common, "PIECE", 64)
    common._powers.cache_clear()
    again, m = K.word_keys(texts)
    common._powers.cache_clear()
    assert m.tolist() == n.tolist() and len(set(again.tolist())) == 9 and again[2] == again[4] == keys[2]


def test_katz_odd_tables(spark):
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in scored(spark, [], ["a b"])] == [(3, 0, 0.0, 0.0)]
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (2, None), ((1 << 62), "a"), (-5, "a")]
    one = [round(r.score, 5) for r in scored(spark, TRAINING, ["a b", "c", None, "a"])]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i, t, False) for i, t in rows] + [(1000 + i, t, True) for i, t in enumerate(TRAINING)], "doc_id long, text string, mark boolean").selectExpr(f"CAST(doc_id AS {kind}) doc_id", "text", "mark")
        model = K.KatzScores(docs, K.F.col("mark"))
        got = sorted((r.doc_id is None, int(r.doc_id or 0), r.n_tokens, round(r.score, 5)) for r in model.scores().collect() if not 1000 <= int(r.doc_id or 0) < 2000)
        assert got == sorted([(False, 1, 3, one[0]), (False, 1, 3, one[0]), (False, 1, 2, one[1]), (True, 0, 3, one[0]), (False, 2, 1, one[2]), (False, 1 << 62, 2, one[3]), (False, -5, 2, one[3])])
    assert K.KatzScores(docs.limit(0), K.F.col("mark")).scores().count() == 0


def test_lm_query(spark, data):
    rows = K.op7_lm_scores(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and len({r.train_tokens for r in rows}) == 1
