"""URL filters and document fingerprints, and the registered queries of this subpackage with their SQL."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from quernstone.llm import fingerprints as P
from quernstone.llm import url_filters as U
from quernstone.llm.registry import QUERIES, SQL


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in rules:
        zone, _, prefix = rule.partition("/")
        if (host == zone or host.endswith("." + zone)) and path.startswith("/" + prefix):
            best = max(best, (len(rule), len(zone), rule, verdict)) if best else (len(rule), len(zone), rule, verdict)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def test_urls_like_brute_force(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "ab", "en", "x1"])
    rules = sorted({(".".join(part() for _ in range(rng.choice([1, 2]))) + "/" + "/".join(part() for _ in range(rng.choice([0, 1, 2]))), "block") for _ in range(25)})
    rules = [(r, rng.choice(["allow", "block"])) for r, _ in rules]
    urls = [None, "", "no scheme", "http://", "://a/b", "HTTP://A.b/En?q#f", "http://a?x=/y", "http://a.b#z", "a://b://c/d", "http://x.a/" + "en/" * 2000]
    urls += ["http://" + ".".join(part() for _ in range(rng.choice([1, 2, 3]))) + "/" + "/".join(part() for _ in range(rng.choice([0, 1, 2, 3]))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None), (None, "http://a/b")], "page_id long, url string").selectExpr("page_id", "url", "'h' AS host", "1 AS id", "2 AS rule")
    got = [tuple(r) for r in U.judge_urls(pages, U.rule_table(spark, rules), rows_per_zone=20).collect()]
    want = [(i, *judge(u, rules)) for i, u in enumerate(urls)] + [(0, *judge(None, rules)), (None, *judge("http://a/b", rules))]
    key = lambda r: tuple((x is None, x or "") for x in map(lambda v: v if v is None else str(v), r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = U.rule_table(spark, U.RULES).limit(0)
    assert U.judge_urls(pages, none).first()["verdict"] == "allow"
    assert U.judge_urls(pages.limit(0), U.rule_table(spark, U.RULES)).count() == 0


TEXTS = [(1, "one two three four five six"), (2, "one two three four five six"), (3, ""), (4, None), (5, "é👍 x"), (6, "six five four three two one"), (7, "w " * 40_000), (9, "one  two three\nfour five six"), (12, "a")]


def test_fingerprints(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS id", "2 AS bucket", "3 AS sig")
    rows = {r.doc_id: r for r in P.compare_with_next(docs, rows_per_bucket=2).collect()}
    order = [i for i, _ in sorted(TEXTS, reverse=True)]
    text = {i: t or "" for i, t in TEXTS}
    for k, i in enumerate(order):
        other = text[order[(k + 1) % len(order)]]
        n = len(text[i])
        half = n // 2
        edited = text[i][: n - half] + other[:half]
        assert rows[i].n_chars == n and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        assert rows[i].near_next == 1 if text[i].split() == other.split() else True
    assert rows[1].fingerprint == rows[2].fingerprint == rows[9].fingerprint != rows[6].fingerprint and rows[3].fingerprint == rows[4].fingerprint == ""
    alone = P.fingerprint_texts(docs).collect()
    assert {r.doc_id: r.fingerprint for r in alone} == {i: r.fingerprint for i, r in rows.items()}


def test_likeness_follows_edits(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    versions = [(n, " ".join(words[: 600 - n] + [f"n{i}" for i in range(n)])) for n in (0, 30, 150, 400)]
    swapped = " ".join(words[300:] + words[:300])
    rows = spark.createDataFrame([*versions, (999, swapped)], "doc_id long, text string")
    signed = {r.doc_id: set(r.sig) for r in P.with_signature(rows, "text", "sig").select("doc_id", "sig").collect()}
    likeness = [len(signed[0] & signed[n]) for n, _ in versions]
    assert likeness == sorted(likeness, reverse=True) and likeness[0] == 64 and len(signed[0] & signed[999]) < 64


def chained(*values):
    """Spark's xxhash64 of longs and, as the last of two, an int: each value's hash is the seed of the next."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest((v % 2 ** (8 * size)).to_bytes(size, "little"), seed)
    return seed


def order_min_hash(text):
    """The fingerprint by its definition, with dictionaries."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, bins = Counter(), {}
    for place in range(max(len(words) - 2, 1) if words else 0):
        kmer = chained(*[(w, 8) for w in words[place : place + 3]]) % 2**40
        member = chained((kmer, 8), (seen[kmer], 4)) % 2**40
        seen[kmer] += 1
        bins.setdefault(member >> 34, []).append((member, place))
    out = ""
    for b, members in sorted(bins.items()):
        least = sorted(sorted(members)[:2], key=lambda m: m[1])
        out += f"{b << 32 | chained(*[(m, 8) for m, _ in least]) % 2**32:010x}"
    return out


def test_fingerprints_by_hand(spark, data):
    texts = [t for _, t in TEXTS] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["a b a b a b c a b a b", "x x x x y x x x x"]
    rows = {r.doc_id: r.fingerprint for r in P.fingerprint_texts(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")).collect()}
    for i, text in enumerate(texts):
        assert rows[f"d{i}"] == order_min_hash(text), text


@pytest.mark.parametrize("stretches", [4096, 3])
def test_next_documents_by_rank(spark, monkeypatch, stretches):
    """Ids that are spread unevenly, and repeated, in many small stretches."""
    monkeypatch.setattr(P, "STRETCHES", stretches)
    monkeypatch.setattr(P, "FAN", 4)
    rng = random.Random(6)
    ids = [*range(40), *(10**15 + k * k * k for k in range(60)), -5, 2**62, *[7] * 9]
    texts = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(30)))) for i in ids]
    rows = P.compare_with_next(spark.createDataFrame(texts, "doc_id long, text string"), rows_per_bucket=3).collect()
    order = sorted(texts, key=lambda x: (-x[0], x[1]))
    want = []
    for (i, text), (_, other) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        a, b = (re.findall(".{10}", order_min_hash(x)) for x in (text, other))
        filled = len({x[:2] for x in a + b})
        want.append((i, hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest(), round(len(set(a) & set(b)) / filled if filled else 1.0, 9)))
    assert sorted((r.doc_id, r.edited_sha256, round(r.near_next, 9)) for r in rows) == sorted(want)


def test_fingerprints_of_odd_tables(spark):
    one = spark.createDataFrame([(5, "only one here")], "doc_id long, text string")
    assert P.compare_with_next(one).first()["near_next"] == 1
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c d e f"), (2, "x")], "doc_id long, text string")
    assert P.compare_with_next(rows).count() == 4 and P.compare_with_next(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
