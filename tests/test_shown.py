"""What searches show over the tables: the filter by likeness, display rows and the form, against plain Python."""

from quernstone.functions.fuzzy import partial_ratio
from quernstone.plans.retrieval import QUERIES


def test_fuzzy_filter(spark, data):
    needle = "Custmr#000000149"
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    want = {(k, n) for k, n in names.items() if any(t in n.lower() for t in (needle.lower(), "custmr", "000000149")) or partial_ratio(needle, n) >= 92}
    got = {tuple(r) for r in QUERIES["fuzzy_filter"](spark, data).collect()}
    assert got == want and 0 < len(got) < len(names)


def parts_of(spark, data):
    out = {}
    for r in spark.read.parquet(f"{data}/part.parquet").collect():
        out.setdefault(r.p_name, []).append(r)
    return {n: (min(r.p_partkey for r in rs) + 1000, min(r.p_brand for r in rs), min(r.p_type for r in rs), max(r.p_type for r in rs)) for n, rs in out.items()}


def test_names_are_shown(spark, data):
    """A query for a part's name shows that part, with its fields on lines of their own."""
    rows = {(r.query_id, r.rank): r.text for r in QUERIES["display_results"](spark, data).collect()}
    for name, (ord_, brand, kind, most) in parts_of(spark, data).items():
        text = rows[1000 + 4 * ord_, 1]
        lines = text.split("\n")
        assert lines[0] == f"[1] {name}  |  {brand}" and f"研究方向: {kind}" in lines and f"简介: Works on {most}" in lines and f"主页: u/{ord_ - 1000}" in lines
        assert f"A study of the {name[::-1]}" in text


def test_form(spark, data):
    rows = [tuple(r) for r in QUERIES["form_results"](spark, data).collect()]
    parts = parts_of(spark, data)
    assert rows == sorted(rows, key=lambda r: (r[1], -r[4])) and all("bolt" in r[1] and "ECONOMY" in parts[r[1]][2:] for r in rows)
    found = {n for n, (_, _, kind, _) in parts.items() if kind == "ECONOMY" and "bolt" in n}
    assert {r[1] for r in rows} <= found | {n for n, p in parts.items() if "ECONOMY" in p[2:]}
