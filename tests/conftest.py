import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    from quernstone.session import spark_session

    session = spark_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


@pytest.fixture(scope="session")
def same_rows(spark, data, duck):
    def check(query, sql):
        df = query(spark, data)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
        assert got == want

    return check
