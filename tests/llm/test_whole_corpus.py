"""Source divergence, suffix-array dedup and the Merkle manifest against brute force, on odd tables and with every way of dealing work out."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import divergence as D
from quernstone.llm import merkle as M
from quernstone.llm import ordering as O
from quernstone.llm import suffix_dedup as S

ROWS = "doc_id long, text string, lang string, source string, n_chars long, gram int, grp string"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(parts)


# divergence


def audit_by_hand(rows, least):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, s, terms in mine:
            count[s].update(t for t in terms if t in kept)
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = sorted((-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode(), o) for o in count if o != s)
            terms = sorted((-f(p(count[s], t), p(whole, t)), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t))
            for part, found in (("pair", pairs), ("term", terms[:10])):
                out += [(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def words(rng, n):
    return " ".join(rng.choice(["the", "The", "a", "é", "ünd", "x1y", "don't", "Ä", "rare%d" % rng.randrange(40), "zebra"]) for _ in range(n))


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "chunk": 3, "span": 2}, {"block": 1, "chunk": 1, "span": 1}])
def test_divergence_by_hand(spark, sizes):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 30)), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"]), 1) for i in range(150)]
    rows += [(1, None, "en", "silent", 0), (None, "", "xx", "alone", 0), (7, "9 8 7", "xx", "other", 0), rows[3], rows[3]]
    audit = D.Audit(rows_of(spark, rows), least=5, **sizes)
    got = audit.pairs().unionByName(audit.terms())
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, 5)


def test_divergence_exact_and_empty(spark, monkeypatch):
    counts, sizes = np.array([0, 10**12, 3 * 10**15]), np.array([5 * 10**15, 2 * 10**12, 4 * 10**15])
    assert D.shares(counts, sizes).tolist() == [1 + 10**9 * (int(c) + 2) // int(s) for c, s in zip(counts, sizes)]
    empty = D.Audit(rows_of(spark, [(1, "a", "en", "s", 1)]).limit(0))
    assert empty.pairs().count() == 0 and empty.terms().count() == 0
    monkeypatch.setattr(D, "PIECE", 50)
    text = ("Aa bb,c" * 40 + "d" * 200 + " e") * 3
    assert Counter(t for p in D._pieces(text.encode()) for t in p) == Counter(re.findall(rb"[a-z]+", text.lower().encode()))


# suffix arrays


def test_suffix_array_in_order():
    rng = random.Random(1)
    for alphabet in (b"ab", b"a", b"cb\0a", bytes(range(256))):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(6)]
        data, ends = b"\0".join([*texts, b""]), np.cumsum([len(t) + 1 for t in texts]) - 1
        array, _ = S.suffix_array(data, ends, 64)
        assert sorted(array.tolist()) == list(range(len(data)))
        own = {i: data[i : ends[np.searchsorted(ends, i)]] for i in array.tolist()}
        ordered = [own[i] for i in array.tolist()]
        assert ordered == sorted(ordered)


def without_by_hand(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = {k for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1 for k in range(i, i + length)}
        out.append((len(t), len(gone), sum(k - 1 not in gone for k in gone), bytes(b for k, b in enumerate(t) if k not in gone)))
    return out


@pytest.mark.parametrize("length, crowd, piece", [(20, 4000, 500_000), (20, 0, 500_000), (33, 2, 150), (8, 1, 100)])
def test_dedup_by_hand(spark, monkeypatch, length, crowd, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    rng = random.Random(length)
    word = lambda: rng.choice(["alpha ", "be ", "é", "gamma delta ", "\n", "\0", "zz"])
    line = "a common line of some length "
    texts = ["".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [a + line + b for a, b in zip(texts[:20], texts[20:])] + [texts[3]] * 5 + [texts[4] + "!", "", "x", "ab" * 200, "q" * 300]
    rows = [(i if i % 7 else None, t, "l", "s", 1) for i, t in enumerate(texts)] + [(3, None, "l", "s", 1), (9, texts[3], "l", "s", 1), (9, texts[3], "l", "s", 1)]
    got = S.without_repeats(rows_of(spark, rows), length=length, crowd=crowd).selectExpr("n_bytes", "removed", "kept").collect()
    found = sorted((r.n_bytes, sum(x.b - x.a for x in r.removed), len(r.removed), bytes(r.kept)) for r in got)
    assert found == sorted(without_by_hand([(r[1] or "").encode() for r in rows], length))


def test_dedup_of_nothing(spark):
    assert S.without_repeats(rows_of(spark, [(1, "a", "l", "s", 1)]).limit(0)).count() == 0
    assert S.without_repeats(rows_of(spark, [(1, "short", "l", "s", 1)])).first().kept == b"short"
    with pytest.raises(ValueError):
        S.repeated_spans(rows_of(spark, []), length=7)


def test_dedup_query_like_brute_force(spark, data):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {i: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, runs, kept) in zip(texts.items(), without_by_hand(list(texts.values()), 200))}
    assert {r.doc_id: tuple(r)[1:] for r in S.op12_suffix_dedup(spark, data).collect()} == want


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    return levels


def siblings_by_hand(levels, at, fan):
    out = []
    for level in levels[:-1]:
        first = at // fan * fan
        out += [x for k, x in enumerate(level[first : first + fan], first) if k != at]
        at //= fan
    return out


@pytest.mark.parametrize("fan, step, batch", [(2, 10, 10_000), (2, 1, 7), (3, 1, 5), (16, 2, 1000)])
def test_manifest_by_hand(spark, monkeypatch, fan, step, batch):
    monkeypatch.setattr(M, "STEP", step)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(fan)
    rows = [(i, f"text {i}", rng.choice(["en"] * 6 + ["fr", None, "", "é"]), "s", None if i % 11 == 0 else i) for i in range(230)]
    rows += [(None, None, "en", None, None), (5, "", "one", "s", 3), *[(9, "same", "en", "s", 4)] * 20]
    docs = rows_of(spark, rows, 5)
    leaf = M.hashed(*[F.col(c) for c in ("doc_id", "text")])
    claimed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(leaf)
    got = M.manifest(docs, leaf, F.col("lang"), claimed, fan=fan).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    write = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(((r[0] is not None, r[0] or 0, digest(write(r[0]), write(r[1]))) for r in rows if r[2] == g)) for g in langs}
    trees = {g: tree_by_hand([x[2] for x in own[g]], fan) for g in langs}
    top = tree_by_hand([trees[g][-1][0] for g in langs], fan)
    want = []
    for k, g in enumerate(langs):
        for at, (there, i, leaf) in enumerate(own[g]):
            proof = siblings_by_hand(trees[g], at, fan) + siblings_by_hand(top, k, fan)
            want.append((i if there else None, leaf, trees[g][-1][0], top[-1][0], digest(*proof), not (there and i % 5 == 0)))
    key = lambda x: tuple(map(str, x))
    assert sorted([(*tuple(r)[:5], r.verified) for r in got], key=key) == sorted(want, key=key)


def test_manifest_of_none_and_one(spark):
    docs = rows_of(spark, [(1, "a", None, "s", 2**63 - 1)])
    (row,) = M.manifest(docs, M.hashed(F.col("doc_id")), F.col("lang")).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest()
    assert M.manifest(docs.limit(0), M.hashed(F.col("doc_id")), F.col("lang")).count() == 0


def test_numbers(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i // 100 if i % 5 else None) for i in range(1000)], "g string, x int").repartition(7)
    got = [tuple(r) for r in O.numbered(rows, "g", ["x"], "place", "total").collect()]
    for g in "ab":
        mine = sorted((r for r in got if r[0] == g), key=lambda r: r[2])
        assert [r[2] for r in mine] == list(range(len(mine))) and {r[3] for r in mine} == {len(mine)}
        assert [r[1] for r in mine] == sorted([r[1] for r in mine], key=lambda x: (x is not None, x or 0))
