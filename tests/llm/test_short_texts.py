"""Short texts in no known language are rejected, short ones in a known language are not."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.llm import language_id as L

TABLES = "/root/testdata"
FOREIGN = [
    "Ieri mattina siamo andati al mercato vicino alla stazione per comprare verdura fresca, pane e qualche formaggio, poi abbiamo bevuto qualcosa in piazza con gli amici che arrivavano dalla montagna.",
    "Wczoraj rano poszliśmy na targ w pobliżu dworca, żeby kupić świeże warzywa, chleb i trochę sera, a potem wypiliśmy kawę na rynku z przyjaciółmi, którzy przyjechali z gór na kilka dni.",
    "Вчера утром мы пошли на рынок рядом с вокзалом, чтобы купить свежие овощи, хлеб и немного сыра, а потом выпили кофе на площади с друзьями, которые приехали с гор.",
    "Eilen aamulla menimme aseman lähellä olevalle torille ostamaan tuoreita vihanneksia, leipää ja vähän juustoa, ja sitten joimme kahvia aukiolla ystävien kanssa, jotka tulivat vuorilta.",
    "xqzv wkjp zzgh qqrt vbnm ploik wqaz xswe dcvf rtgb nhyu jmki olpq azxs wedc vfrt gbnh yujm kiol pqaz mwnx bvcq zlkj hgfd sapo iuyt rewq mnbv cxzl kjhg fdsa poiu ytre wqmn bvcx",
]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_short_texts(spark, sf):
    docs = spark.read.parquet(f"{TABLES}/{sf}/documents.parquet")
    model = L.fit_languages(docs.where(~L.held_out(F.col("doc_id"))))
    for size in (60, 100, 160, 200, 250, 400, 1000):
        assert model.identify([(f"{x} " * 6)[:size] for x in FOREIGN])[2].all(), size
    clean = [r.text for r in docs.where(L.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect() if r.text]
    for size in (40, 60, 120, 200, 300, 600, 10**9):
        cut = [x[:size] for x in clean if len(x) >= min(size, 600)]
        assert model.identify(cut)[2].mean() <= (0.02 if size < 10**9 else 0.01), size


def test_identify_by_hand(spark):
    """The same languages, scores and rejections with one dictionary for each text."""
    docs = spark.read.parquet(f"{TABLES}/sf0.001/documents.parquet")
    model = L.fit_languages(docs)
    texts = [r.text for r in docs.limit(40).collect()] + [None, "", "12 34", "Ça va ?", *FOREIGN]
    for text, language, score, rejected in zip(texts, *model.identify(texts), strict=True):
        raw, grams = (text or "").lower().encode("utf-8", "replace"), Counter()
        letters = [0, 0, *[b if b > 127 or chr(b).isalpha() else 0 for b in raw], 0, 0]
        for a, b, c in zip(letters[1:], letters[2:], letters[3:]):
            if b:
                grams[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 32 - L.BITS] += 1
        x = {g: math.sqrt(n) * float(model.idf[g]) for g, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        cosine = [sum(v / norm * float(c[g]) for g, v in x.items()) for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        if not any(c.isalpha() for c in text or ""):
            assert (language, score, bool(rejected)) == ("und", 0, True)
            continue
        band = min(int(math.log2(len(text) + 1)), 12)
        assert language == model.languages[model.owner[best]] and score == pytest.approx(cosine[best], abs=1e-4)
        if abs(score - model.least[model.owner[best], band]) > 1e-4:
            assert bool(rejected) == (cosine[best] < model.least[model.owner[best], band])


def test_share_of_many_rows():
    for n in (1_500, 10**7, 10**10, 10**13):
        bound = L.sample_bound(1_500, n)
        assert (bound + 2**63) / 2**64 * n == pytest.approx(1_500, rel=1e-3)


@pytest.mark.parametrize("n", [1, 5, 15])
def test_rare_language(spark, n):
    """A language with very few texts rejects what is foreign to it as the others do, and keeps its own."""
    docs = spark.read.parquet(f"{TABLES}/sf0.01/documents.parquet").where("text IS NOT NULL")
    train = docs.where(~L.held_out(F.col("doc_id")))
    few = train.where("lang = 'fr' AND length(text) > 200").orderBy(F.xxhash64("text")).limit(n)
    model = L.fit_languages(train.where("lang IN ('de', 'en')").unionByName(few))
    own = [r.text for r in docs.where("lang = 'fr' AND length(text) > 200").collect()]
    for size in (60, 100, 200, 400, 1000, 4000):
        assert model.identify([(f"{x} " * 40)[:size] for x in FOREIGN])[2].all(), size
        language, _, rejected = model.identify([x[:size] for x in own])
        assert sum(x == "fr" and not r for x, r in zip(language, rejected)) >= 0.98 * len(own), size


def test_only_rare_languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the weather of today is fine and the children play outside all day", "en"), ("das Wetter von heute ist gut und die Kinder spielen den ganzen Tag", "de")] * 3)]
    model = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not model.identify([t for _, t, _ in rows])[2].any()
    assert model.identify([x[:150] for x in FOREIGN])[2].all()
