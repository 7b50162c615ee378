"""Every registered query with SQL gives the same rows as another engine on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    return "N" if v is None else str(v)


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("set memory_limit = '2GB'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_same_rows(spark, other, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = other.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_features_have_all_components(spark):
    width = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    q = entry.queries()
    for name in ("long_features", "standard_scale", "importance_rank", "feature_means"):
        assert q[name](spark, DATA).select("feature").distinct().count() == width
    assert q["pearson_pairs"](spark, DATA).count() == width * (width - 1) // 2


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
