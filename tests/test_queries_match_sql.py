"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import re

import duckdb
import pytest

from sealmark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def _key(row):
    return tuple((v is None, str(type(v)), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == sorted((tuple(_norm(r[i]) for i in order) for r in found.fetchall()), key=_key)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert not any(re.match(r"op\d", n) for n in catalog.QUERIES)
