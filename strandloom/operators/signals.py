"""Sequences as numeric signals: mappings, cumulative curves, chaos game and power spectra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.arrays import Slice, by_slice


def mapped(values: dict[str, float], other: float) -> Column:
    """Array of the numbers that stand for the characters of seq."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.transform(F.split("seq", ""), lambda c: F.coalesce(table[c], F.lit(other)))


def signal_table(s: DataFrame, values: dict[str, float]) -> DataFrame:
    """(seq_id, n, total, energy) of the mapped signal: what later steps need is kept in the row's array."""
    v = s.where("length(seq) > 0").select("seq_id", mapped(values, values["G"]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    energy = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("seq_id", F.size("v").alias("n"), F.round(total, 4).alias("total"), F.round(energy, 4).alias("energy"))


def z_curve(s: DataFrame) -> DataFrame:
    """(seq_id, x, y, z) at the end of the curve: purine - pyrimidine, amino - keto, weak - strong."""
    n = lambda c: F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))
    a, c, g, t = n("A"), n("C"), n("G"), n("T")
    return s.select("seq_id", (a + g - c - t).alias("x"), (a + c - g - t).alias("y"), (a + t - c - g).alias("z"))


def chaos_game(s: DataFrame) -> DataFrame:
    """(seq_id, x, y): where the walk half-way to each character's corner ends; sequences of 1 or more."""
    kind = "struct<x:double,y:double>"
    step = lambda p, c: F.struct(((p["x"] + F.when(c.isin("A", "G"), 1.0).otherwise(-1.0)) / 2).alias("x"), ((p["y"] + F.when(c.isin("A", "T"), 1.0).otherwise(-1.0)) / 2).alias("y")).cast(kind)
    end = F.aggregate(F.split("seq", ""), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).cast(kind), step)
    return s.where("length(seq) > 0").select("seq_id", end.alias("p")).select("seq_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


#: Channels of each mapping by name: a number for each character, and for any other one.
BINARY = {c: ({c: 1.0}, 0.0) for c in "ACTG"}
CURVES = {"x": ({"A": 1.0, "G": 1.0}, -1.0), "y": ({"A": 1.0, "C": 1.0}, -1.0), "z": ({"A": 1.0, "T": 1.0}, -1.0)}
CORNERS = {"x": ({"A": 1.0, "C": -1.0, "T": -1.0}, 1.0), "y": ({"A": 1.0, "C": -1.0, "T": 1.0}, -1.0)}
PLANE = {"re": ({"A": 1.0, "C": -1.0, "T": 1.0}, -1.0), "im": ({"A": 1.0, "C": 1.0, "T": -1.0}, -1.0)}
Channels = dict[str, tuple[dict[str, float], float]]


def numbers(values: dict[str, float]) -> Channels:
    """One channel of these numbers; other characters count as G, or as 0 where G has no number."""
    return {"x": (values, values.get("G", 0.0))}


def _running(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x)


_HALVES = 0.5 ** np.arange(1, 61)  # of a term 60 steps back a double no longer holds anything


def _halved(x: np.ndarray) -> np.ndarray:
    """y[i] = (x[i] + y[i - 1]) / 2 from 0 on."""
    return np.convolve(x, _HALVES)[: len(x)]


RULES = {"plain": None, "running": _running, "halved": _halved}


def _signals(part: Slice, channels: Channels, rule: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The row and channels of each sequence that is not empty."""
    looked_up = [part.looked_up(values, other) for values, other in channels.values()]
    step = RULES[rule]
    for r in np.flatnonzero(part.length).tolist():
        a, b = part.start[r], part.start[r] + part.length[r]
        yield r, [step(x[a:b]) if step else x[a:b] for x in looked_up]


def signals(s: DataFrame, channels: Channels, rule: str = "plain") -> DataFrame:
    """(seq_id, channel, values): the whole signal of each channel, a number at each position.

    rule: plain numbers, their running sums (cumulative curves), or "halved", where each step goes half-way from the point before to the
    character's corner (chaos game). A sequence costs its length. Empty sequences have no signal.
    """
    names = list(channels)

    def each(part: Slice) -> tuple[np.ndarray, list]:
        rows, which, values = [], [], []
        for r, x in _signals(part, channels, rule):
            rows += [r] * len(x)
            which += names
            values += x
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return np.array(rows, np.int64), [pa.array(which, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0)])))]

    return by_slice(s, ("seq_id",), "channel string, values array<double>", each)


def padded(x: DataFrame, length: int | None = None) -> DataFrame:
    """Signals of one length: zeros follow up to the longest of the table (one number is sent to all tasks), or up to `length`, at which
    longer ones are cut."""
    if length is not None:
        most, x = F.lit(length), x.withColumn("values", F.slice("values", 1, length))
        return x.withColumn("values", F.concat("values", F.array_repeat(F.lit(0.0), most - F.size("values"))))
    most = x.agg(F.max(F.size("values")).alias("most"))
    return x.join(F.broadcast(most)).withColumn("values", F.concat("values", F.array_repeat(F.lit(0.0), F.col("most") - F.size("values")))).drop("most")


def position_sums(x: DataFrame) -> DataFrame:
    """(channel, pos, total, n): sums over all signals at each position, and how many reach it; what padding adds is zeros, so only real
    positions are laid out."""
    return x.select("channel", F.posexplode("values").alias("pos", "v")).groupBy("channel", "pos").agg(F.round(F.sum("v"), 6).alias("total"), F.count("*").alias("n"))


NAMES = ("mean", "median", "max", "min", "peak", "peak_amplitude", "std_pop", "std", "p15", "p25", "p50", "p75", "range", "variance", "iqr", "semi_iqr", "cv", "skew", "kurtosis")


def _summary(power: np.ndarray, amplitude: np.ndarray) -> list[float | None]:
    n = len(power)
    mean, median = power.mean(), np.median(power)
    p10, p15, p25, p50, p75, p90 = np.percentile(power, [10, 15, 25, 50, 75, 90])
    std = power.std(ddof=1) if n > 1 else math.nan
    third = n // 3
    out = [mean, median, power.max(), power.min(), power[third] / mean if mean else math.nan, amplitude[third] / amplitude.mean() if mean else math.nan, power.std(), std, p15, p25, p50, p75, np.ptp(power), std * std, p75 - p25, (p75 - p25) / 2, power.std() / mean if mean else math.nan, 3 * (mean - median) / power.std() if power.std() else math.nan, (p75 - p25) / (2 * (p90 - p10)) if p90 > p10 else math.nan]
    return [float(x) if math.isfinite(x) else None for x in out]


def spectrum_summary(s: DataFrame, channels: Channels, rule: str = "plain", complex_plane: bool = False) -> DataFrame:
    """(seq_id, and nineteen statistics of the whole sequence's power spectrum): powers and amplitudes are summed over the channels; with
    `complex_plane` two channels are one signal's real and imaginary part. Empty sequences have nulls."""

    def each(part: Slice) -> tuple[np.ndarray, list]:
        rows = [[None] * len(NAMES)] * len(part.length)
        for r, x in _signals(part, channels, rule):
            if complex_plane:
                x = [x[0] + 1j * x[1]]
            sizes = [np.abs(np.fft.fft(c)) for c in x]
            rows[r] = _summary(sum(a * a for a in sizes), sum(sizes))
        return np.arange(len(part.length)), [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]

    return by_slice(s, ("seq_id",), ", ".join(f"{n} double" for n in NAMES), each)
