"""Repair of many records: equal ones are worked on once, and each row has what its own texts give."""

from pyspark.sql import functions as F

from quernstone.operators import repair
from quernstone.plans import records


def test_work_is_done_once_for_each_kind(spark):
    rows = spark.createDataFrame([(i, {"k": str(i % 3)} if i % 4 else None, None if i % 5 == 0 else "b") for i in range(600)], "id long, a map<string,string>, b string").coalesce(1)
    seen = []

    def work(kinds):
        seen.append((kinds.count(), kinds.rdd.getNumPartitions()))
        return kinds.withColumn("b", F.concat(F.coalesce(F.try_element_at("a", F.lit("k")), F.lit("-")), F.coalesce("b", F.lit("-"))))

    got = {r.id: (r.a, r.b) for r in repair.once_per_kind(rows, ["a", "b"], ["b"], work).collect()}
    assert got == {i: ({"k": str(i % 3)} if i % 4 else None, (str(i % 3) if i % 4 else "-") + ("-" if i % 5 == 0 else "b")) for i in range(600)}
    assert seen == [(8, 4)]  # three kinds of a or none, b or none


def test_records_without_a_key_of_their_own(spark):
    """A record's papers come of its own texts, also where its url is null or another record's."""
    first, _, third = records._fixed_records(spark).orderBy("url").collect()
    rows = [(url, *r[1:]) for url in (None, "u") for r in (first, third)]
    fixed = repair.batch_fix(spark.createDataFrame(rows, repair.RECORD)).select("url", "name", "papers_text").collect()
    assert sorted(map(tuple, fixed), key=str) == sorted([(url, name, papers) for url in (None, "u") for name, papers in ((first.name, records._TWO_PAPERS), (third.name, ""))], key=str)
