"""Every query against its SQL oracle in DuckDB, row by row."""

import duckdb
import numpy as np
import pytest

from tessellum.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | np.ndarray):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v else v
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(plain(x) for x in r) for r in df.collect()]
    sql = registry.oracles().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = ([names.index(c) for c in sorted(columns)] for names in (df.columns, columns))
    got = sorted(repr([r[i] for i in ours]) for r in rows)
    want = sorted(repr([plain(r[i]) for i in theirs]) for r in cursor.fetchall())
    assert got == want


def test_names():
    assert set(registry.oracles()) <= set(registry.queries())
