"""Queries over sequences work each sequence out where it is: no row for a position or a window, and no lambda over its characters."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.operators import arrays, neighbours, profiles, weighted_kmers

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["apaac", "paac", "pse_dnc", "parallel_factors", "spatial_autocorrelation", "dac", "dcc", "scale_autocorr", "ctdt", "fickett", "ksctriad", "autocorrelation_table", "kmer_graph", "pc_pse_dnc", "pse_knc", "sc_pse_dnc", "sc_pse_tnc"])
def test_one_scan_without_shuffle_and_lambdas(spark, name):
    p = plan(entry.queries()[name](spark, DATA))
    assert p.count("FileScan") == 1 and "Exchange" not in p and "lambda" not in p and p.count("regexp_replace") <= 2


def test_autocorrelations_by_pairs_of_residues(spark):
    """Six scales cost no more passes over the sequence than one."""
    one = {c: float(i) for i, c in enumerate("ACDE")}
    s = spark.createDataFrame([(i, t) for i, t in enumerate(["ACDEACDEAA", "AAAA", None, "CCCCCCC", "AXDCÿE"])], "seq_id long, seq string")
    got = {(r.seq_id, r.scale, r.lag): r for r in arrays.autocorrelations(s, {"one": one, "two": {c: -3 * v for c, v in one.items()}}, 2).collect()}
    mean, dev = 1.5, 1.25**0.5
    for i, t in ((0, "ACDEACDEAA"), (4, "AXDCÿE")):
        v = [(one[c] - mean) / dev if c in one else 0.0 for c in t]
        m, n = sum(v) / len(v), len(v)
        q = sum((x - m) ** 2 for x in v)
        for lag in (1, 2):
            r = got[i, "one", lag]
            pairs = list(zip(v, v[lag:], strict=False))
            assert abs(r.nmbroto - sum(a * b for a, b in pairs) / (n - lag)) < 1e-5
            assert abs(r.moran - sum((a - m) * (b - m) for a, b in pairs) / (n - lag) / (q / n)) < 1e-5
            assert abs(r.geary - sum((a - b) ** 2 for a, b in pairs) / (2 * (n - lag)) / (q / (n - 1))) < 1e-5
    assert got[1, "two", 2].moran is None and got[3, "one", 1].geary is None


@pytest.mark.parametrize("blank", ["-", "A"])
def test_sliding_summary(spark, blank):
    s = spark.createDataFrame([(0, "AABBCA-CAAB"), (1, "ABC"), (2, None), (3, "-----A---"), (4, "ÿAÿAB"), (5, "")], "seq_id long, seq string").repartition(1)
    found = arrays.sliding_shares(s, 4, blank).groupBy("seq_id", "residue").agg(F.count("*"), F.max("share"), F.round(F.sum("share"), 9)).collect()
    got = arrays.sliding_summary(s, 4, blank).select("seq_id", "residue", "n_windows", "largest", F.round("total", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, found))


def test_written_tracks_are_cut_before_they_are_rows(spark):
    states = {1: "HHECCHEEHC", 2: "EEE", 3: "CCCC"}
    spans = spark.createDataFrame([("a", 1, 2, 6), ("b", 2, 1, 3), ("c", 3, None, None), ("d", 4, 1, 2)], "pep_id string, seq_id long, begin int, end int")
    long = spark.createDataFrame([(i, p, "t", c) for i, t in states.items() for p, c in enumerate(t, 1)], "seq_id long, pos int, track string, value string")
    written = spark.createDataFrame([(i, "t", t) for i, t in states.items()], "seq_id long, track string, states string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(profiles.written_matrix(spans, written)) == rows(profiles.track_matrix(spans, long))
    assert rows(profiles.written_shares(spans, written, ["H", "E"])) == rows(profiles.track_shares(spans, long, ["H", "E"]))


def test_class_sums_beside_and_by_shuffle(spark):
    s = spark.createDataFrame([(i, "xy"[i % 2], t) for i, t in enumerate(["ACGTACG", "AACC", "", "GGGÿ", None, "A"])], "seq_id long, label string, seq string")
    rows = lambda most: sorted(map(tuple, weighted_kmers.information_difference(s, (1, 3), most).collect()))
    assert rows(1000) == rows(3) and len(rows(1000)) == 14


def test_nearest_by_products(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(700, 6)) * 3, 1)
    v[100:140] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(rows, rows, 5, block_rows=300).collect():
        got.setdefault(r.id, []).append((r.k, r.other))
    for i in range(len(v)):
        d = np.round(((v - v[i]) ** 2).sum(axis=1), 9)
        want = [int(j) for j in np.lexsort((np.arange(len(v)), d)) if j != i][:5]
        assert [j for _, j in sorted(got[i])] == want
    assert neighbours.CHUNK_ROWS < 700


def test_nearest_copies_and_rounds(spark, monkeypatch):
    """Blocks follow from the largest group, and rounds give what one pass gives."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 7, rng.normal(size=3).tolist()) for i in range(700)], "id long, label int, v array<double>").repartition(2).cache()
    whole = sorted(map(tuple, neighbours.nearest(rows, rows, 3, by=["label"]).collect()))
    assert whole == sorted(map(tuple, neighbours.nearest(rows, rows, 3, by=["label"], block_rows=20, round_blocks=2).collect())) and len(whole) == 2100
    count = lambda k: lambda a, b: pa.table([pa.array([len(a)]), pa.array([len(b)]), pa.array([0.0])], neighbours._NEAR)
    monkeypatch.setattr(neighbours, "_nearest", count)
    got = neighbours.nearest(rows, rows, 100, by=["label"], block_rows=300).collect()
    assert sum(r.id for r in got) == sum(r.other for r in got) == 700
