"""Every query of the library against its SQL, and against itself on other partitionings."""

import math

import duckdb
import pandas as pd
import pytest

from scorelake.plans import more  # noqa: F401
from scorelake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=lambda r: [(x is not None, str(type(x)), round(x, 2) if isinstance(x, float) else x) for x in r])


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    found = duck.sql(SQL[name])
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: types.get(t, t) for c, t in df.dtypes} == dict(zip(found.columns, map(str, found.types), strict=True))
    want = found.df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]
