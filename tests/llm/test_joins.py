"""Near-copy join and benchmark search against brute force, with the cases that their docstrings define."""

import random
from collections import Counter

import pytest

from quernstone.llm import decontamination as D
from quernstone.llm import jaccard_join as J
from quernstone.llm.common import components


def brute(rows, words=4, percent=85):
    sets, inverted = [], {}
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for k, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.add((j, k))
                root[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], links


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(9)}" if rng.random() < 0.3 else f"x{rng.randrange(10**6)}" for _ in range(k)] for k in (3, 5, 8, 20, 40, 90, 200, 400)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(500)}"
        rows.append((k, " ".join(words)))
    return rows


def key(row):
    return tuple((x is None, x) for x in row)


EDGES = [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b"), (None, "a b"), (None, "only here"), (905, "same id"), (905, "another text of the id"), (906, "twice over and over again"), (906, "twice over and over again"), (907, "é É è " * 5), (908, "w " * 30_000)]


def test_components_like_brute_force(spark):
    rows = near_copies(5, 260) + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS key", "2 AS digest")
    got = [tuple(r) for r in J.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows)[0], key=key)


def test_hot_passage(spark):
    """A passage that a third of the texts share, with more or less around it, and copies of it alone."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage + "".join(f" u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 4, 8, 12, 300])))) for k in range(120)]
    rows += [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))) for k in range(120, 300)]
    assert sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(brute(rows)[0])


def test_links_are_all_there(spark):
    rows = near_copies(9, 120)
    join = J.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {}
    for k, (_, text) in enumerate(rows):
        first.setdefault(text, k)
    want = {(a, b) for a, b in brute(rows)[1] if first[rows[a][1]] == a and first[rows[b][1]] == b and rows[a][1] != rows[b][1]}
    assert {(r.a, r.b) for r in join.all_links().collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nearly_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in J.jaccard_components(docs).collect()] == [(i, 0, i) for i, _ in rows]
    assert J.one_of_each(docs).count() == len(rows)


def test_one_stays(spark):
    rows = near_copies(7, 150) + [(900, ""), (901, None), (902, "")]
    kept = {r.doc_id for r in J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()}
    assert kept == {c for _, n, c in brute(rows, 5, 80)[0] if n} | {900, 901, 902}


def test_one_of_equal_rows_stays(spark):
    text, other = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (1, text.upper(), "y"), (1, other, "z"), (2, text, "x"), (3, "", "e"), (3, "", "e"), (None, text, "n")], "doc_id long, text string, _digest string")
    kept = sorted((r.doc_id or 0, r.text.lower()) for r in J.one_of_each(rows, words=5, percent=80).collect())
    assert kept == [(1, text), (1, other), (3, ""), (3, "")] and J.one_of_each(rows).columns == rows.columns


def test_any_type_of_id_and_no_broadcast(spark, monkeypatch):
    rows = [(i, t) for i, t in near_copies(9, 120) if i is not None]
    want, _ = brute(rows, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "_bounded", lambda df, rows: df)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect())
    assert got == sorted(want)
    named = docs.selectExpr("lpad(doc_id, 12, '0') AS doc_id", "text", "1 AS id", "2 AS digest")
    got = sorted((int(r.doc_id), r.n_shingles, int(r.component_id)) for r in J.jaccard_components(named).collect())
    assert got == sorted(want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_benchmark_items_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 5, 6])))
    items = [(k, " ".join(word() for _ in range(rng.choice([15, 30, 60, 150])))) for k in range(30)] + [(90, ""), (91, None)]
    docs = [(k, " ".join(word() for _ in range(rng.choice([1, 20, 200, 900])))) for k in range(200)]
    want = set()
    for k in range(0, 60, 2):
        item = items[rng.randrange(30)]
        at = rng.randrange(len(docs[k][1].split()) + 1)
        words = docs[k][1].split()
        docs[k] = (k, " ".join(words[:at] + item[1].upper().split() + words[at:]))
        want.add((k, item[0]))
    docs += [(500, ""), (501, None), (502, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS id", "2 AS item_id", "3 AS _leak")
    index = D.LatentIndex(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in index.matches(frame).collect()} == want
    clean = index.keep_clean(frame)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_paraphrases_need_the_answer(spark):
    item = "the river bank holds seven copper lanterns while nobody counts every silver door beyond northern kepler"
    swapped = item.split()
    swapped[1], swapped[4], swapped[9], swapped[11] = "stream", "six", "sums", "golden"
    other = swapped[:12] + "that old quiet mill".split()
    filler = [(k, f"plain words number {k} about weather and bread") for k in range(10, 60)]
    docs = spark.createDataFrame([(1, " ".join(swapped)), (2, " ".join(other))] + filler, "doc_id long, text string")
    found = D.LatentIndex(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).matches(docs).collect()
    assert [r.doc_id for r in found] == [1]


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for items in ([], [(1, None)]):
        index = D.LatentIndex(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert index.matches(docs).count() == 0 and index.keep_clean(docs).count() == 1
    index = D.LatentIndex(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert index.matches(docs.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(a, b) == table[-1][-1]
