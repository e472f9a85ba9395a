"""Every query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

from tessellar.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "part embeddings events lineitem pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6
    return a == b


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert len(got) == len(expected)
    whole = lambda r: tuple((0, "") if x is None else (1, f"{x:.3f}") if isinstance(x, float) else (2, str(x)) for x in r)
    for a, b in zip(sorted(got, key=whole), sorted(expected, key=whole)):
        assert all(map(close, a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.euler == 0 and row.is_closed and row.is_manifold and row.is_oriented
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
