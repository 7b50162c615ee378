"""k-mer graphs, helical arcs, correlations of scales and evaluation tables against the rules written out."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.residues import EISENBERG
from strandloom.operators import arrays, correlations, evaluation, features, graphs, peptides, sequences

rng = random.Random(12)
SEQS = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (4, 9, 40, 300)] + ["AAAA", "ACACAC", "", None, "AC"]
PROTEINS = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (1, 5, 17, 18, 19, 60)] + ["AAAAAAAAAAAAAAAAAAAAAA", "LLLL", "", None]


def test_graph_metrics(spark):
    s = spark.createDataFrame(list(enumerate(SEQS)), "seq_id long, seq string").repartition(2)
    got = {r.seq_id: r for r in graphs.graph_metrics(s, 2).collect()}
    for i, t in enumerate(SEQS):
        edges = {frozenset((t[p : p + 2], t[p + 1 : p + 3])) for p in range(len(t or "") - 2)}
        edges = {e for e in edges if len(e) == 2}
        if not edges:
            assert i not in got
            continue
        near: dict = {}
        for a, b in map(tuple, edges):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        linked = {v: sum(frozenset(p) in edges for p in itertools.combinations(n, 2)) for v, n in near.items()}
        wedges = sum(math.comb(len(n), 2) for n in near.values())
        r = got[i]
        assert (r.nodes, r.edges, r.max_degree, r.triangles) == (len(near), len(edges), max(map(len, near.values())), sum(linked.values()) // 3)
        assert r.transitivity == pytest.approx(sum(linked.values()) / wedges if wedges else 0, abs=1e-6)
        assert r.mean_clustering == pytest.approx(sum(linked[v] / math.comb(len(n), 2) for v, n in near.items() if len(n) > 1) / len(near), abs=1e-6)
        assert r.density == pytest.approx(2 * len(edges) / (len(near) * (len(near) - 1)), abs=1e-6)
    assert set(got) == {0, 1, 2, 3, 5}


def longest_arc(window):
    """Degrees, place after place, of a window (True, False; fewer than 18) around the helix."""
    x = [1 if i < len(window) and window[i] else 0 if i < len(window) else 2 for i in (0, 11, 4, 15, 8, 1, 12, 5, 16, 9, 2, 13, 6, 17, 10, 3, 14, 7)]
    arcs, arc = [], 0
    for n in range(18):
        if x[n] == 0:
            arcs.append(arc)
            arc = 0
        elif x[n] == 1:
            arc += 20
        else:
            before = x[n - 1] if x[n - 1] != 2 else x[n - 2]
            if n == 17:
                after = x[0]
            else:
                after = x[n + 1] if x[n + 1] != 2 else x[0] if n == 16 else x[n + 2]
            arc += 10 * (before == 1) + 10 * (after == 1)
    if not arcs:
        return arc
    arcs[0] += arc
    return max(arcs)


def test_helical_arcs(spark):
    s = spark.createDataFrame(list(enumerate(PROTEINS)), "seq_id long, seq string")
    groups = {"apolar": "ACFGILMVWY", "basic": "KRH"}
    got = {(r.seq_id, r.feature): r for r in arrays.helical_arcs(s, groups).collect()}
    for i, t in enumerate(PROTEINS):
        for name, members in groups.items():
            if t:
                has = [c in members for c in t]
                windows = [has[j : j + 18] for j in range(len(has) - 18)] if len(has) > 18 else [has]
                want = [longest_arc(w) for w in windows]
                assert got[i, name].largest == max(want) and got[i, name]["mean"] == pytest.approx(sum(want) / len(want))
    assert len(got) == 2 * sum(bool(t) for t in PROTEINS)


def test_correlations_of_scales(spark):
    s = spark.createDataFrame([(i, t) for i, t in enumerate(PROTEINS)], "seq_id long, seq string")
    other = {c: i / 3 for i, c in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    got = {(r.seq_id, r.lag): r.value for r in arrays.scale_correlations(s, {"e": EISENBERG, "o": other}, 4).collect()}
    long = [i for i, t in enumerate(PROTEINS) if t and len(t) > 4]
    assert set(got) == set(itertools.product(long, range(4)))
    for i, lag in got:
        t = PROTEINS[i]
        assert got[i, lag] == pytest.approx(sum(EISENBERG[a] * other[b] for a, b in zip(t, t[lag:])) / (len(t) - lag))


def test_autocorrelations_of_many_scales(spark):
    s = spark.createDataFrame([*enumerate(PROTEINS), (5, PROTEINS[5]), (99, "ACDZZ*" * 5)], "seq_id long, seq string").withColumn("scale", F.lit("x")).repartition(2)
    other = {c: i / 3 for i, c in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    rows = arrays.autocorrelations(s, {"e": EISENBERG, "o": other}, 4).collect()
    got = {(r.seq_id, r.scale, r.lag): r for r in rows}
    long = [i for i, t in enumerate(PROTEINS) if t and len(t) > 4] + [99]
    assert set(got) == set(itertools.product(long, "eo", range(1, 5))) and len(rows) == len(got) + 8
    for (i, scale, lag), r in got.items():
        if i == 99:
            continue
        table = EISENBERG if scale == "e" else other
        mean = sum(table.values()) / 20
        deviation = (sum((x - mean) ** 2 for x in table.values()) / 20) ** 0.5
        v = [(table[c] - mean) / deviation for c in PROTEINS[i]]
        n, m = len(v), sum(v) / len(v)
        assert r.nmbroto == pytest.approx(sum(a * b for a, b in zip(v, v[lag:])) / (n - lag), abs=1e-5)
        square = sum((x - m) ** 2 for x in v)
        if len(set(PROTEINS[i])) == 1:
            assert r.moran is None and r.geary is None
        else:
            assert r.moran == pytest.approx(sum((a - m) * (b - m) for a, b in zip(v, v[lag:])) / (n - lag) / (square / n), abs=1e-5)
            assert r.geary == pytest.approx(sum((a - b) ** 2 for a, b in zip(v, v[lag:])) / (2 * (n - lag)) / (square / (n - 1)), abs=1e-5)
    one = {(r.seq_id, r.lag): r for r in correlations.spatial_autocorrelation(s.where("seq_id < 5"), EISENBERG, 4).collect()}
    assert all(got[i, "e", lag].moran == pytest.approx(r.moran, abs=1e-5) for (i, lag), r in one.items())
    assert arrays.autocorrelations(s.where("seq is null"), {"e": EISENBERG}, 4).count() == 0


def test_instability_index(spark):
    s = spark.createDataFrame([(1, "ACAC"), (2, "A"), (3, ""), (4, None), (5, "GGG"), (6, "ACG")], "seq_id long, seq string")
    weights = spark.createDataFrame([("AC", 2.0), ("CA", -0.5), ("CG", None)], "pair string, weight double").withColumn("seq_id", F.lit(7))
    got = {r.seq_id: r.value for r in peptides.instability_index(s, weights).collect()}
    assert got == {1: pytest.approx(10 / 4 * 3.5), 2: 0.0, 5: 0.0, 6: pytest.approx(10 / 3 * 2)}
    learned = {r.pair: r.weight for r in peptides.pair_weights(s).collect()}
    # pairs AC x3, CA, GG x2, CG; A begins 3 of 7, C ends 3
    assert learned["AC"] == pytest.approx(math.log(3 * 7 / 9), abs=1e-6) and learned["CG"] == pytest.approx(math.log(7 / (2 * 3)), abs=1e-6) and set(learned) == {"AC", "CA", "CG", "GG"}
    assert peptides.instability_index(s.limit(0), weights).count() == 0


@pytest.mark.parametrize("cuts", [2, 7, 1024])
def test_ranks_in_buckets(spark, cuts):
    rows = [(i, rng.choice([None, 1.5, -2.0, 1e9, float(i)]), rng.choice(["a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double, g string").repartition(3)
    for by in (None, "g"):
        got = {r.id: r["rank"] for r in sequences.ranked(df, "v", "id", by, cuts=cuts).collect()}
        for g in {None} if by is None else {"a", "b", None}:
            own = sorted((r for r in rows if by is None or r[2] == g), key=lambda r: (r[1] is None, r[1] or 0, r[0]))
            assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert sequences.ranked(df.limit(0), "v", "id").count() == 0
    assert sequences.ranked(df.where("v is null"), "v", "id").agg(F.max("rank")).first()[0] == sum(r[1] is None for r in rows)


def test_recorded_matrix(spark):
    m = spark.createDataFrame([("1", "1", 2269), ("1", "0", 231), ("0", "0", 2293), ("0", "1", 207), ("All", "All", 5000), ("1", "All", 2500)], "real string, pred string, n long")
    r = evaluation.from_matrix(m, "1").first()
    assert (r.tp, r.tn, r.fp, r.fn) == (2269, 2293, 207, 231)
    assert r.acc == 0.9124 and r.gmean == pytest.approx(0.912387, abs=1e-6) and r.mcc == pytest.approx(0.824838, abs=1e-6)
    never = evaluation.from_matrix(m.where("pred = '0'"), "1").first()
    assert (never.tp, never.fp, never.mcc, never.f1, never.sn) == (0, 0, 0.0, 0.0, 0.0)
    assert evaluation.from_matrix(m.limit(0), "1").first().acc == 0


def test_table_of_folds(spark):
    rows = [(i % 3, int(rng.random() < 0.4), int(rng.random() < 0.5), round(rng.random(), 1)) for i in range(120)]
    got = evaluation.cv_table(spark.createDataFrame(rows, "fold int, real int, pred int, score double"), "fold").first()
    auc, acc = [], []
    for f in range(3):
        own = [r for r in rows if r[0] == f]
        pos, neg = ([r[3] for r in own if r[1] == y] for y in (1, 0))
        auc.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        acc.append(sum(r[1] == r[2] for r in own) / len(own))
    for name, x in (("auc", auc), ("acc", acc)):
        mean = sum(x) / 3
        assert got[f"mean_{name}"] == pytest.approx(mean, abs=1e-4) and got[f"std_{name}"] == pytest.approx((sum((v - mean) ** 2 for v in x) / 3) ** 0.5, abs=1e-4)
    assert got.folds == 3 and len(got) == 19


def test_pairs_with_missing_values(spark):
    rows = [(i, f, None if (i + k) % 5 == 0 else 1e6 + rng.random() * (k + 1) + i * k) for i in range(40) for k, f in enumerate("abc")] + [(i, "flat", 2.0) for i in range(40)]
    x = spark.createDataFrame(rows, "id long, feature string, value double")
    got = {(r.f1, r.f2): r.c for r in features.pearson_pairs(x).collect()}
    whole = x.where("feature <> 'flat'")
    both = whole.alias("x").join(whole.alias("y"), "id").where("x.feature < y.feature").groupBy(F.col("x.feature").alias("f1"), F.col("y.feature").alias("f2")).agg(F.corr("x.value", "y.value").alias("c"))
    for r in both.collect():
        assert got[r.f1, r.f2] == pytest.approx(r.c, abs=1e-5)
    assert len(got) == 6 and {c for k, c in got.items() if "flat" in k} == {None}
