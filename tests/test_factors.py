"""Property factors, weighted k-mers, tracks and their files against the rules written out."""

import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from strandloom.operators import profiles as P
from strandloom.operators import property_factors as R
from strandloom.operators import weighted_kmers as W
from strandloom.sources import profiles as IO

SEQS = {1: "ACGTACGGTTACGA", 2: "AAAA", 3: "", 4: None, 5: "GATTACAGATTACA" * 3, 6: "ACN"}
DI = {w: (i % 5 - 2.0, (i * 7 % 11) / 3) for i, w in enumerate(map("".join, product("ACGT", repeat=2)))}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t in SEQS.items()], "seq_id long, seq string, label string").repartition(2)


@pytest.fixture(scope="module")
def properties(spark):
    return spark.createDataFrame([(w, n, v) for w, vs in DI.items() for n, v in zip("ab", vs, strict=True)], "kmer string, property string, value double")


def value(t, i, u):
    return DI.get(t[i : i + 2], (0.0, 0.0))[u]


def test_factors(table, properties):
    got = {k: {(r.seq_id, r.lag, r.property, r.other): r.value for r in R.factors(table, properties, 2, k).collect()} for k in ("parallel", "first", "series", "auto", "cross")}
    long = [i for i, t in SEQS.items() if t and len(t) >= 4]
    for i in long:
        t = SEQS[i]
        for lag in (1, 2):
            m = len(t) - 2 - lag + 1
            squares = [sum((value(t, j, u) - value(t, j + lag, u)) ** 2 for u in (0, 1)) / 2 for j in range(m)]
            assert got["parallel"][i, lag, None, None] == pytest.approx(sum(squares) / m)
            assert got["first"][i, lag, None, None] == pytest.approx(sum(squares[: len(t) - 1 - 2]) / (len(t) - lag - 1))
            mean = [sum(value(t, j, u) for j in range(m)) / len(t) for u in (0, 1)]
            for u in (0, 1):
                n = "ab"[u]
                assert got["series"][i, lag, n, n] == pytest.approx(sum(value(t, j, u) * value(t, j + lag, u) for j in range(m)) / m)
                assert got["auto"][i, lag, n, n] == pytest.approx(sum((value(t, j, u) - mean[u]) * value(t, j + lag, u) for j in range(m)) / m)
                v = 1 - u
                assert got["cross"][i, lag, n, "ab"[v]] == pytest.approx(sum((value(t, j, u) - mean[u]) * (value(t, j + lag, v) - mean[v]) for j in range(m)) / m)
    assert {k[0] for k in got["series"]} == set(long) and R.factors(table.limit(0), properties, 2, "auto").count() == 0
    with pytest.raises(ValueError, match="no factors"):
        R.factors(table, properties, 2, "other")
    with pytest.raises(ValueError, match="one length"):
        R.table_values(properties.union(properties.sparkSession.createDataFrame([("AAA", "a", 1.0)], properties.schema)))


def test_general_pseudo_composition_and_bundle(table, properties):
    rows = R.general_pseudo_composition(table, properties, 2, 0.1, "series").where("seq_id = 1").collect()
    theta = {(r.lag, r.property): r.value for r in R.factors(table, properties, 2, "series").where("seq_id = 1").collect()}
    d = 1 + 0.1 * sum(theta.values())
    count = Counter(SEQS[1][i : i + 2] for i in range(13))
    want = {w: n / 13 / d for w, n in count.items()} | {f"theta_{lag}_{p}": 0.1 * x / d for (lag, p), x in theta.items()}
    assert {r.feature: r.value for r in rows} == pytest.approx(want, abs=1e-8)
    both = R.bundle({"p": R.general_pseudo_composition(table, properties, 1, 0.1), "q": R.general_pseudo_composition(table, properties, 1, 0.1, "parallel", 3)})
    wide = R.wide(both, [("p", "AC"), ("q", "ACG"), ("q", "none")]).where("seq_id = 1").first()
    assert wide.p_AC > 0 and wide.q_ACG > 0 and wide.q_none == 0


def test_binned_kmers(spark):
    rng = [0.5, 1.25, 3.0, 0.5, 2.0, 9.0, 4.0, 4.0, 0.25, 7.5, 1.0, 2.5]
    rows = [(i, "ACGTACGTACGT"[: n], rng[i % 5 :][:n] + rng[: max(0, n - len(rng[i % 5 :]))]) for i, n in ((1, 12), (2, 9), (3, 2), (4, 1), (5, 0))]
    s = spark.createDataFrame(rows, "seq_id long, seq string, numbers array<double>")
    for k, bins in ((2, 3), (3, 5), (1, 1)):
        means = sorted(sum(x[i : i + k]) / k for _, t, x in rows for i in range(len(t) - k))
        bounds = [means[max(0, int(len(means) / bins * b) - 1)] for b in range(1, bins + 1)]
        want = Counter()
        for i, t, x in rows:
            for p in range(len(t) - k + 1):
                mean = sum(x[p : p + k]) / k
                want[i, next((b for b, y in enumerate(bounds) if mean <= y), bins - 1), t[p : p + k]] += 1
        assert {(r.seq_id, r.bin, r.kmer): r.cnt for r in W.binned_counts(s, k, bins).collect()} == want
        assert [r.bound for r in W.boundaries(W.track_words(s, k), bins).orderBy("bin").collect()] == pytest.approx(bounds)
    with pytest.raises(Exception, match="differ in length"):
        W.track_words(spark.createDataFrame([(1, "ACG", [1.0])], s.schema), 1).count()
    assert W.binned_counts(s.limit(0), 2, 3).count() == 0


def test_mismatch_and_norms(spark):
    counts = spark.createDataFrame([(1, "AC", 3), (1, "AA", 1), (2, "GG", 2)], "seq_id long, kmer string, cnt long")
    want = Counter()
    for i, w, n in ((1, "AC", 3), (1, "AA", 1), (2, "GG", 2)):
        want[i, w] += n
        for p, c in product((0, 1), "ACGT"):
            if w[p] != c:
                want[i, w[:p] + c + w[p + 1 :]] += 0.5 * n
    assert {(r.seq_id, r.kmer): r.cnt for r in W.mismatch_counts(counts, "ACGT", 0.5).collect()} == want
    norm = lambda how: {(r.seq_id, r.kmer): r.value for r in W.normalised(counts, how).collect()}
    assert norm("frequency") == {(1, "AC"): 0.75, (1, "AA"): 0.25, (2, "GG"): 1.0}
    assert norm("unitsphere") == pytest.approx({(1, "AC"): 3 / math.sqrt(10), (1, "AA"): 1 / math.sqrt(10), (2, "GG"): 1.0})
    assert norm("range") == {(1, "AC"): 1.0, (1, "AA"): 0.0, (2, "GG"): 0.0}


def test_information_difference(table):
    def d(v):
        n = sum(v.values())
        return n * math.log2(n) - sum(x * math.log2(x) for x in v.values() if x)

    grams = lambda t, k: Counter(t[p : p + k] for p in range(len(t or "") - k + 1))
    got = {(r.seq_id, r["class"], r.k): r.value for r in W.information_difference(table, (1, 3)).collect()}
    seen = 0
    for k in (1, 3):
        for cls in "xy":
            pooled = sum((grams(t, k) for i, t in SEQS.items() if (i % 2 == 1) == (cls == "x")), Counter())
            for i, t in SEQS.items():
                if t and len(t) >= k:
                    x = grams(t, k)
                    assert got[i, cls, k] == pytest.approx(d(x + pooled) - d(x) - d(pooled), abs=6e-4)
                    seen += 1
    assert seen == len(got)


def test_profile_files_and_encoders(spark, tmp_path):
    letters = IO.MATRIX_ORDER
    (tmp_path / "m").mkdir()
    head = "\n\nLast position-specific scoring matrix\n           " + "  ".join(letters) + "\n"
    seq = "MKVLA" * 500
    body = "".join(f"  {i} {c}  " + " ".join(str((i + j) % 7 - 3) for j in range(20)) + "  0.5 inf\n" for i, c in enumerate(seq, 1))
    (tmp_path / "m" / "prot1.pssm").write_text(head + body + "\n                      K         Lambda\nStandard Ungapped    0.1    0.2\n")
    m = IO.matrix_scan(spark, str(tmp_path / "m"))
    assert m.count() == 2500 * 20 and P.track_sequences(m).first()["seq"] == seq
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "prot1.ss2").write_text("# PSIPRED\n\n" + "".join(f"{i:4} {c} {'HEC'[i % 3]}   0.9 0.1 0.0\n" for i, c in enumerate(seq[:50], 1)))
    (tmp_path / "s" / "prot2.ss2").write_text("# header\n   1 A H\n   2 C -\n")
    tracks = IO.profile_scan(spark, str(tmp_path / "s"), {"ss": 2})
    proteins = P.track_sequences(tracks)
    peptides = spark.createDataFrame([("a", "prot1", "VLAMK"), ("b", "prot1", "WWW"), ("c", "prot2", "AC"), ("d", "none", "A"), ("e", "prot1", ""), ("f", "prot1", None)], "pep_id string, seq_id string, peptide string")
    spans = P.located(peptides, proteins)
    assert {(r.pep_id, r.begin, r.end) for r in spans.collect()} == {("a", 3, 7), ("b", None, None), ("c", 1, 2), ("d", None, None), ("e", None, None), ("f", None, None)}
    shares = {(r.pep_id, r.state): r.share for r in P.track_shares(spans, tracks, ["H", "E", "C"]).collect()}
    states = ["HEC"[i % 3] for i in range(3, 8)]
    assert shares == {("a", s): states.count(s) / 5 for s in "HEC"} | {("c", "H"): 0.5, ("c", "E"): 0.0, ("c", "C"): 0.0}
    assert {r.share for r in P.track_shares(spans.where("pep_id = 'c'"), tracks, ["H", "O"], other="O").collect()} == {0.5}
    wide = spark.createDataFrame([("p", "prot1", 1020, 1030)], "pep_id string, seq_id string, begin int, end int")
    got = {(r.place, r.track): r.value for r in P.track_matrix(wide, m).collect()}
    assert got == {(i - 1019, c): float((i + j) % 7 - 3) for i in range(1020, 1031) for j, c in enumerate(letters)}


def test_position_encoding(spark):
    s = spark.createDataFrame([(1, "AC-"), (2, ""), (3, None)], "seq_id long, seq string")
    got = {(r.seq_id, r.pos, r.component): r.value for r in P.position_encoding(s, P.indicators("AC"), ["A", "C"]).collect()}
    assert got == {(1, 1, "A"): 1.0, (1, 1, "C"): 0.0, (1, 2, "A"): 0.0, (1, 2, "C"): 1.0, (1, 3, "A"): 0.0, (1, 3, "C"): 0.0}


def test_tables_and_stored_descriptors(spark, tmp_path):
    (tmp_path / "t.txt").write_text("twist\t1.5\t-2\n\nroll, 0.25 ,3\n")
    t = IO.property_table_scan(spark, str(tmp_path / "t.txt"), ["AA", "AC"])
    assert {tuple(r) for r in t.collect()} == {("AA", "twist", 1.5), ("AC", "twist", -2.0), ("AA", "roll", 0.25), ("AC", "roll", 3.0)}
    with pytest.raises(Exception, match="wrong number"):
        IO.property_table_scan(spark, str(tmp_path / "t.txt"), ["AA"]).collect()
    made = []

    def maker(name, rows):
        def make():
            made.append(name)
            return spark.createDataFrame(rows, "seq_id long, feature string, value double")

        return make

    at = str(tmp_path / "cache")
    first = IO.cached(spark, at, {"nac": maker("nac", [(1, "A", 0.5), (2, "C", 0.25)])})
    assert first.count() == 2
    both = IO.cached(spark, at, {"nac": maker("nac", []), "dnc": maker("dnc", [(1, "AA", 1.0)])})
    assert made == ["nac", "dnc"] and both.count() == 3
    one = IO.load_descriptors(spark, at, ["dnc"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "descriptor" in plan.split("PartitionFilters: [")[1].split("]")[0]
    IO.store_descriptors(spark.createDataFrame([(9, "dnc", "CC", 2.0)], "seq_id long, descriptor string, feature string, value double"), at)
    left = {(r.seq_id, r.descriptor) for r in IO.load_descriptors(spark, at).collect()}
    assert left == {(1, "nac"), (2, "nac"), (9, "dnc")}
    IO.append_features(first.drop("descriptor"), str(tmp_path / "csv"))
    IO.append_features(first.drop("descriptor"), str(tmp_path / "csv"))
    again = IO.csv_scan(spark, str(tmp_path / "csv"), "seq_id long, feature string, value double")
    assert again.count() == 4 and again.agg(F.sum("value")).first()[0] == 1.5
    (tmp_path / "bad.csv").write_text("seq_id,feature,value\n1,A,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        IO.csv_scan(spark, str(tmp_path / "bad.csv"), "seq_id long, feature string, value double").collect()
