"""Correlations of properties along a sequence, summed up where the sequence is; nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.arrays import Lag, Slice, by_slice, counted, number


def _laid(parts: list[tuple[np.ndarray, ...]], some: np.ndarray) -> list[np.ndarray]:
    """Columns of parts, each part a row for each of `some`; single numbers stand for all its rows."""
    return [np.concatenate([np.broadcast_to(np.asarray(p[i]), some.shape) for p in parts]) for i in range(len(parts[0]))]


def _theta(part: Slice, table: dict, k: int, lags: int) -> np.ndarray:
    """(lags, rows): mean over positions and properties of the squared difference at each lag from 1."""
    values, out = part.word_values(table, k), []
    for lag in range(1, lags + 1):
        at = Lag(part, lag, k)
        total = np.zeros(at.many)
        for p in values:
            total = total + at.total((at.first(p) - at.then(p)) ** 2)
        out.append(total / len(values) / np.maximum(part.length - (k - 1) - lag, 1))
    return np.stack(out)


def parallel_factors(s: DataFrame, table: dict, k: int, lags: int) -> DataFrame:
    """(seq_id, lag, theta): mean over positions and properties of the squared difference at a lag."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some = np.flatnonzero(part.length >= k + lags)
        theta = _theta(part, table, k, lags)
        rows, lag, x = _laid([(some, j + 1, theta[j, some]) for j in range(lags)], some)
        return rows, [pa.array(lag.astype(np.int32)), number(x)]

    return by_slice(s, ("seq_id",), "lag int, theta double", rule)


def pseudo_composition(s: DataFrame, table: dict, k: int, lags: int, weight: float) -> DataFrame:
    """(seq_id, feature, value): k-mer shares and weighted factors over 1 + weight x sum of factors; too short: no rows. Rows without a
    seq_id have none either; repeated rows are worked out each."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some = np.flatnonzero(part.length >= k + lags)
        theta = _theta(part, table, k, lags)
        d = 1 + weight * sum(theta[j] for j in range(lags))
        row, _, words, count, total = counted(part, [tuple(range(k))])
        has = np.flatnonzero(part.length[row] >= k + lags)
        names = pa.array(np.repeat([f"theta{j + 1}" for j in range(lags)], len(some)).tolist(), pa.string())
        rows = np.concatenate([row[has], *[some] * lags])
        feature = pa.concat_arrays([words.take(pa.array(has)), names])
        share = np.concatenate([count[has] / total[has], np.full(len(some) * lags, np.nan)])
        factor = np.concatenate([np.full(len(has), np.nan), *[weight * theta[j, some] for j in range(lags)]])
        return rows, [feature, number(share), number(factor), number(d[rows])]

    found = by_slice(s.where("seq_id is not null"), ("seq_id",), "feature string, share double, factor double, d double", rule)
    return found.select("seq_id", "feature", F.round(F.coalesce(F.round("share", 9), "factor") / F.col("d"), 5).alias("value"))


def autocovariance(s: DataFrame, table: dict, k: int, lags: int) -> DataFrame:
    """(seq_id, lag, prop, value): mean of (p[i] - m) p[i + lag] with m the sum over the first factors by the length."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, parts = np.flatnonzero(part.length >= k + lags), []
        values = part.word_values(table, k)
        for lag in range(1, lags + 1):
            at = Lag(part, lag, k)
            m = np.maximum(part.length - (k - 1) - lag, 1)
            for u, p in enumerate(values):
                a, b = at.first(p), at.then(p)
                x = (at.total(a * b) - at.total(a) / np.maximum(part.length, 1) * at.total(b)) / m
                parts.append((some, lag, u, x[some]))
        rows, lag, prop, x = _laid(parts, some)
        return rows, [pa.array(lag.astype(np.int32)), pa.array(prop.astype(np.int32)), number(x)]

    return by_slice(s, ("seq_id",), "lag int, prop int, value double", rule).withColumn("value", F.round("value", 9))


def spatial_autocorrelation(s: DataFrame, scale: dict[str, float], lags: int) -> DataFrame:
    """(seq_id, lag, nmbroto, moran, geary) of a scale standardised over the residues, for sequences longer than `lags`."""
    mean = sum(scale.values()) / len(scale)
    dev = (sum((v - mean) ** 2 for v in scale.values()) / len(scale)) ** 0.5
    table = {c: ((v - mean) / dev,) for c, v in scale.items()}

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, parts = np.flatnonzero(part.length > lags), []
        (p,) = part.word_values(table, 1)
        n, many = part.length, len(part.length)
        off = p - (np.bincount(part.row, p, many) / np.maximum(n, 1))[part.row]
        square = np.bincount(part.row, off * off, many)
        for lag in range(1, lags + 1):
            at = Lag(part, lag)
            m = np.maximum(n - lag, 1)
            a, b = at.first(p), at.then(p)
            found = (at.total(a * b) / m, at.total(at.first(off) * at.then(off)) / m, at.total((a - b) ** 2) / m / 2)
            parts.append((some, lag, n[some], square[some], *[x[some] for x in found]))
        rows, lag, n, *rest = _laid(parts, some)
        return rows, [pa.array(lag.astype(np.int32)), pa.array(n), *map(number, rest)]

    p = by_slice(s, ("seq_id",), "lag int, n long, v double, product double, moran double, geary double", rule)
    r = lambda x, name: F.round(x, 5).alias(name)
    return p.select("seq_id", "lag", r(F.col("product"), "nmbroto"), r(F.try_divide("moran", F.col("v") / F.col("n")), "moran"), r(F.try_divide("geary", F.col("v") / (F.col("n") - 1)), "geary"))


def cross_covariance(s: DataFrame, table: dict, k: int, lags: int) -> DataFrame:
    """(seq_id, lag, prop, other, value) of all ordered pairs of two properties: mean of (p[i] - m) (q[i + lag] - w), m and w
    the sums over the first factors by the length."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, parts = np.flatnonzero(part.length >= k + lags), []
        values, n = part.word_values(table, k), np.maximum(part.length, 1)
        for lag in range(1, lags + 1):
            at = Lag(part, lag, k)
            m = np.maximum(part.length - (k - 1) - lag, 1)
            means = [at.total(at.first(p)) / n for p in values]
            tails = [at.total(at.then(p)) for p in values]
            for u, p in enumerate(values):
                for v, q in enumerate(values):
                    if u != v:
                        both, a, b = at.total(at.first(p) * at.then(q)), means[u], means[v]
                        # the first factors sum up to a n
                        x = (both - a * tails[v] - b * a * n + a * b * m) / m
                        parts.append((some, lag, u, v, x[some]))
        rows, lag, u, v, x = _laid(parts, some)
        return rows, [*(pa.array(i.astype(np.int32)) for i in (lag, u, v)), number(x)]

    return by_slice(s, ("seq_id",), "lag int, prop int, other int, value double", rule).withColumn("value", F.round("value", 9))


def lagged_products(s: DataFrame, table: dict[str, tuple[float, ...]], lags: range) -> DataFrame:
    """(seq_id, lag, prop, value): mean of p[i] p[i + lag], for sequences of more residues than any lag and than the number of lags."""
    least = max(lags.stop - 1, len(lags))

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, parts = np.flatnonzero(part.length > least), []
        values = part.word_values(table, 1)
        for lag in lags:
            at = Lag(part, lag)
            m = np.maximum(part.length - lag, 1)
            parts += [(some, lag, u, (at.total(at.first(p) * at.then(p)) / m)[some]) for u, p in enumerate(values)]
        rows, lag, prop, x = _laid(parts, some)
        return rows, [pa.array(lag.astype(np.int32)), pa.array(prop.astype(np.int32)), number(x)]

    return by_slice(s, ("seq_id",), "lag int, prop int, value double", rule)


def weighted_residues(s: DataFrame, table: dict[str, tuple[float, ...]], lags: int, weight: float, letters: str, kind: str) -> DataFrame:
    """(seq_id, feature, value): residue counts and weighted factors over 1 + weight x sum of factors, of sequences of more than `lags`
    residues. kind: "parallel": one factor a lag, as for parallel_factors(); "product": one for each lag and property, the mean product
    of neighbours at the lag. Rows without a seq_id have none; repeated rows are worked out each."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, parts = np.flatnonzero(part.length > lags), []
        if kind == "parallel":
            factors = {f"theta{j + 1}": t for j, t in enumerate(_theta(part, table, 1, lags))}
        else:
            values, factors = part.word_values(table, 1), {}
            for lag in range(1, lags + 1):
                at = Lag(part, lag)
                for u, p in enumerate(values):
                    factors[f"theta{lag}_{u}"] = at.total(at.first(p) * at.then(p)) / np.maximum(part.length - lag, 1)
        d = 1 + weight * sum(factors.values())
        code = part.looked_up({c: float(i) for i, c in enumerate(letters)}, float(len(letters))).astype(np.int64)
        size = len(letters) + 1
        counts = np.bincount(part.row * size + code, minlength=len(part.length) * size).reshape(-1, size)
        names = [*letters, *factors]
        for i, x in enumerate([*(counts[:, j].astype(float) for j in range(len(letters))), *(weight * t for t in factors.values())]):
            parts.append((some, i, x[some], d[some]))
        rows, name, x, d = _laid(parts, some)
        return rows, [pa.array(names, pa.string()).take(pa.array(name)), number(x), number(d)]

    found = by_slice(s.where("seq_id is not null"), ("seq_id",), "feature string, value double, d double", rule)
    return found.select("seq_id", "feature", F.round(F.col("value") / F.col("d"), 6).alias("value"))
