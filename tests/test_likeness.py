"""The likeness join against all pairs, and searches that use it."""

import random

import pytest

from quernstone.functions.fuzzy import partial_ratio
from quernstone.operators.likeness import alike, least_shared
from quernstone.plans.retrieval import QUERIES


def by_hand(lefts, rights, threshold):
    return sorted((a, b, s) for a in {x for x in lefts if x} for b in {x for x in rights if x} if (s := partial_ratio(a, b)) >= threshold)


def found(spark, lefts, rights, threshold):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    return sorted(map(tuple, alike(one(lefts), one(rights), threshold).collect()))


@pytest.mark.parametrize("threshold", [1, 50, 70, 90, 100])
def test_random_texts(spark, threshold):
    rng = random.Random(threshold)
    text = lambda n: "".join(rng.choice("aabcde é一") for _ in range(rng.randrange(n)))
    lefts = [text(12) for _ in range(25)] + ["a", "", None, "x" * 40, "👍👍a"]
    rights = [text(90) for _ in range(25)] + [x[1:] + "b" for x in lefts[:10]] + ["", None, "a", "xx", "a👍👍"]
    assert found(spark, lefts, rights, threshold) == by_hand(lefts, rights, threshold)


@pytest.mark.parametrize("threshold", [50, 70, 90])
def test_names_of_the_tables(spark, data, threshold):
    read = lambda t, c: [r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).distinct().collect()]
    parts = read("part", "p_name")
    lefts = read("customer", "c_name")[:60] + [p[:-2] + p[-1] for p in parts]
    assert found(spark, lefts, parts, threshold) == by_hand(lefts, parts, threshold)


def test_no_nested_loop_and_no_texts(spark):
    one = spark.createDataFrame([("abc",), ("abd",)], "text string")
    pairs = alike(one, one, 60)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert alike(one.limit(0), one, 60).count() == 0 and alike(one, one.limit(0), 60).count() == 0


def test_bound_is_never_too_high():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        s = partial_ratio(a, b)
        if s:
            shared = max(sum(min(short.count(c), w.count(c)) for c in set(short)) for i in range(len(long)) for w in [long[i : i + len(short)]])
            assert shared >= least_shared(len(short), s)
        assert partial_ratio(a, b, s) == s and partial_ratio(a, b, min(s + 1, 100)) in (0, s)  # what rounds down may still be given


def test_queries_like_all_pairs(spark, data):
    parts = {r.p_name: min(x.p_partkey for x in g) for r, g in ((rows[0], rows) for rows in by_name(spark, data).values())}
    spelled = {i: (drop(p), p) for p, i in parts.items()}
    scores = {i: sorted(((-partial_ratio(q, p), p) for p in parts), key=lambda x: x) for i, (q, _) in spelled.items()}
    want = {(i, k, -s, p) for i, ranked in scores.items() for k, (s, p) in enumerate([x for x in ranked if -x[0] >= 70][:5], 1)}
    assert {tuple(r) for r in QUERIES["fuzzy_search"](spark, data).collect()} == want
    rows = {r.threshold: r for r in QUERIES["threshold_sweep"](spark, data).collect()}
    for t, r in rows.items():
        hits = [[p for s, p in scores[i] if -s >= t][:10] for i in spelled]
        assert (r.cases, r.hit_at_1_count, r.hit_at_k_count) == (len(spelled), sum(h[:1] == [p] for h, (_, p) in zip(hits, spelled.values())), sum(p in h for h, (_, p) in zip(hits, spelled.values())))


def by_name(spark, data):
    out = {}
    for r in spark.read.parquet(f"{data}/part.parquet").select("p_name", "p_partkey").collect():
        out.setdefault(r.p_name, []).append(r)
    return out


def drop(text):
    return "".join(c for k, c in enumerate(text) if k % 5 != 4)
