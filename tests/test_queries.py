from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="session")
def duck(data):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def test_entry(spark):
    assert entry.entry(spark).columns == ["media_id", "covered_ms", "duration_ms", "coverage"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = Counter(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
        assert got == want


@pytest.mark.parametrize("name", sorted(q for q in entry.queries() if not q[1:2].isdigit()))
def test_query_over_empty_tables(spark, data, tmp_path_factory, name):
    from pathlib import Path

    d = tmp_path_factory.getbasetemp() / "empty"
    if not d.exists():
        for p in Path(data).glob("*.parquet"):
            spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(f"{d}/{p.name}")
    entry.queries()[name](spark, str(d)).collect()
