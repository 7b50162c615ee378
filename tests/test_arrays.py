"""Sequences as arrays against the rules written out."""

import cmath
import math
from collections import Counter

import pytest

from strandloom.functions.residues import EISENBERG
from strandloom.operators import arrays, descriptors, kmers, signals

SEQS = ["ACGTACGGTTAC", "A", "", None, "AAAAAAAA", "GATTACA-GATTACA", "éAéACé", "CC", "ACGTACGGTTAC" * 9]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(SEQS)], "seq_id long, seq string, label string").repartition(2)


@pytest.fixture(params=[1 << 20, 10])
def small(request, monkeypatch):
    monkeypatch.setattr(arrays, "SLICE", request.param)


def test_word_counts(table, small):
    shapes = [(0,), (0, 1, 2), (0, 3), tuple(range(14))]
    want = {}
    for i, t in enumerate(SEQS):
        for j, shape in enumerate(shapes):
            words = Counter("".join(t[p + o] for o in shape) for p in range(len(t or "") - shape[-1]))
            want |= {(i, j, w): (n, sum(words.values())) for w, n in words.items()}
    got = arrays.word_counts(table, shapes).collect()
    assert {(r.seq_id, r["shape"], r.word): (r.cnt, r.total) for r in got} == want and len(got) == len(want)
    assert arrays.word_counts(table.limit(0), shapes).count() == 0


def test_long_words_and_many_letters(spark):
    text = "".join(chr(65 + i * 7 % 26) for i in range(200)) * 2
    got = arrays.word_counts(spark.createDataFrame([(1, text)], "seq_id int, seq string"), [tuple(range(40))]).collect()
    want = Counter(text[p : p + 40] for p in range(len(text) - 39))
    assert {r.word: r.cnt for r in got} == want


def test_class_places(table):
    groups = {"p": ("A", "CG", "T"), "q": ("ACGT",)}
    got = {(r.seq_id, r.property, r.grp, r.q): (r.n, r["at"]) for r in arrays.class_places(table, groups, (0, 25, 50, 100)).collect()}
    for i, t in enumerate(SEQS):
        for name, gs in groups.items():
            for g, members in enumerate(gs, 1):
                places = [p + 1 for p, c in enumerate(t or "") if c in members]
                for q in (0, 25, 50, 100):
                    if t:
                        assert got[i, name, g, q] == (len(t), places[max(1, len(places) * q // 100) - 1] if places else None)
    assert {k[0] for k in got} == {i for i, t in enumerate(SEQS) if t}


@pytest.mark.parametrize("width", [1, 3, 11, 1000])
def test_scale_windows(table, small, width):
    scale = {"A": 0.5, "C": -1.25, "G": 2.0, "T": 0.1}
    for degrees in (None, 100.0):
        got = {r.seq_id: r for r in arrays.scale_windows(table, scale, width, degrees).collect()}
        assert set(got) == {i for i, t in enumerate(SEQS) if t}
        for i, r in got.items():
            t = SEQS[i]
            w = min(width, len(t))
            v = [scale.get(c, 0.0) for c in t]
            turn = 0 if degrees is None else math.radians(degrees)
            want = [sum(v[a + k] * cmath.exp(1j * turn * k) for k in range(w)) / w for a in range(len(t) - w + 1)]
            want = [x.real if degrees is None else abs(x) for x in want]
            assert r.every == pytest.approx(want, abs=1e-9) and r.n_windows == len(want)
            assert (r.largest, r.mean) == pytest.approx((max(want), sum(want) / len(want)), abs=1e-9)


def test_recorded_moment_and_mean(spark):
    s = spark.createDataFrame([(1, "GLFDIVKKVVGALGSL")], "seq_id long, seq string")
    assert arrays.scale_windows(s, EISENBERG, 1000, 100.0).first().largest == pytest.approx(0.48790226, abs=1e-8)
    assert arrays.scale_windows(s, EISENBERG, 1000).first().largest == pytest.approx(0.44875)


def test_sliding_shares(table, small):
    got = {(r.seq_id, r.start, r.residue): r.share for r in arrays.sliding_shares(table, 5).collect()}
    want = {}
    for i, t in enumerate(SEQS):
        for a in range(len(t or "") - 4):
            part = t[a : a + 5].replace("-", "")
            want |= {(i, a, c): part.count(c) / len(part) for c in part}
    assert got == pytest.approx(want)


def test_stepped_windows(spark):
    s = spark.createDataFrame([(1, "x", "A" * 100), (2, "x", "A" * 20), (3, "x", "A" * 61), (4, "x", "")], "seq_id long, label string, seq string")
    short = descriptors.stepped_composition(s, 30, 20, 3).collect()
    # starts 0, 20, 40, 60: the window from 60 ends less than a step before the end
    assert {(r.seq_id, r.k): r.cnt for r in short} == {(1, 1): 120, (1, 2): 116, (1, 3): 112, (2, 1): 20, (2, 2): 19, (2, 3): 18, (3, 1): 60, (3, 2): 58, (3, 3): 56}
    starts = lambda i, w, st: sorted(r.start for r in kmers.stretches(s.where(f"seq_id = {i}"), w, st).collect())
    assert starts(1, 30, 20) == [0, 20, 40, 60, 80] and starts(1, 50, 25) == [0, 25, 50] and starts(2, 30, 20) == [0] and starts(4, 30, 20) == []


def dft(x):
    n = len(x)
    return [sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(x)) for k in range(n)]


@pytest.mark.parametrize("channels,rule,plane", [(signals.BINARY, "plain", False), (signals.CURVES, "running", False), (signals.PLANE, "plain", True), (signals.numbers({"A": 70.0, "C": 58.0, "G": 78.0, "T": 66.0}), "plain", False)])
def test_spectra(table, channels, rule, plane):
    rows = {r.seq_id: r for r in signals.spectrum_summary(table, channels, rule, plane).collect()}
    assert len(rows) == len(SEQS) and rows[2].mean is None and rows[3].mean is None
    for i, t in enumerate(SEQS):
        if t:
            x = [[values.get(c, other) for c in t] for values, other in channels.values()]
            if rule == "running":
                x = [[sum(c[: k + 1]) for k in range(len(c))] for c in x]
            if plane:
                x = [[complex(a, b) for a, b in zip(*x, strict=True)]]
            spectra = [dft(c) for c in x]
            power = [sum(abs(s[k]) ** 2 for s in spectra) for k in range(len(t))]
            size = [sum(abs(s[k]) for s in spectra) for k in range(len(t))]
            third = len(t) // 3
            assert rows[i].mean == pytest.approx(sum(power) / len(t)) and rows[i].max == pytest.approx(max(power))
            if sum(power) / len(t) > 1e-9:
                assert rows[i].peak_amplitude == pytest.approx(size[third] / (sum(size) / len(t)), abs=1e-9)


def test_signals_and_padding(table):
    plain = {(r.seq_id, r.channel): r["values"] for r in signals.signals(table, signals.BINARY).collect()}
    assert plain[0, "A"] == [float(c == "A") for c in SEQS[0]] and (2, "A") not in plain
    curve = {(r.seq_id, r.channel): r["values"] for r in signals.signals(table, signals.CURVES, "running").collect()}
    assert curve[0, "x"][:4] == [1.0, 0.0, 1.0, 0.0]
    walk = {(r.seq_id, r.channel): r["values"] for r in signals.signals(table, signals.CORNERS, "halved").collect()}
    for i, t in enumerate(SEQS):
        if t:
            for c, (values, other) in signals.CORNERS.items():
                at, want = 0.0, []
                for x in t:
                    at = (at + values.get(x, other)) / 2
                    want.append(at)
                assert walk[i, c] == pytest.approx(want, abs=1e-15)
    x = signals.signals(table, signals.CURVES, "running")
    wide = signals.padded(x).collect()
    assert {len(r["values"]) for r in wide} == {len(SEQS[8])}
    assert all(r["values"][: len(SEQS[r.seq_id])] == curve[r.seq_id, r.channel] and not any(r["values"][len(SEQS[r.seq_id]) :]) for r in wide)
    assert {len(r["values"]) for r in signals.padded(x, 5).collect()} == {5}
    sums = {(r.channel, r.pos): (r.total, r.n) for r in signals.position_sums(x).collect()}
    columns = [r["values"] for r in wide if r.channel == "y"]
    for p in range(len(SEQS[8])):
        assert sums["y", p][0] == pytest.approx(sum(c[p] for c in columns), abs=1e-6)
    assert sums["y", 0][1] == len(columns)
