"""Every query that has a DuckDB counterpart gives the same rows, on the smallest tables."""

import duckdb
import pytest

from spectrallake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    rel = duck.execute(registry.ORACLES[name])
    at = [x[0] for x in rel.description]
    assert sorted(at) == names
    theirs = sorted((tuple(plain(r[at.index(n)]) for n in names) for r in rel.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
