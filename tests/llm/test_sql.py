"""The corpus queries that have SQL give the same rows as another engine on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandloom.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "N" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want
