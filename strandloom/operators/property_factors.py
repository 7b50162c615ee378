"""Correlations along sequences of properties that a table gives: any k-mers, any properties, the user's own among them.

A property table has rows (kmer, property, value), all of one k. It is small by its nature (k-mers by properties, `MOST` rows at most)
and goes to all tasks; each sequence's factors are worked out where the sequence is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.arrays import Slice, by_slice, counted

MOST = 1_000_000  # rows of a property table


def table_values(table: DataFrame) -> tuple[int, list[str], dict[str, dict[str, float]]]:
    """k, the properties in order, and each one's values by k-mer."""
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a property table of more than {MOST} rows")
    lengths = {len(r["kmer"]) for r in rows}
    if len(lengths) != 1:
        raise ValueError("a property table has k-mers of one length")
    values: dict[str, dict[str, float]] = {}
    for r in rows:
        values.setdefault(r["property"], {})[r["kmer"]] = float(r["value"])
    return lengths.pop(), sorted(values), values


def _tracks(part: Slice, k: int, columns: list[np.ndarray], letters: str) -> np.ndarray:
    """(windows, properties): values at each character where a k-mer begins; 0 where the table has none."""
    code = part.looked_up({c: float(i) for i, c in enumerate(letters)}, -1.0).astype(np.int64)
    n = len(code) - k + 1
    at, known = np.zeros(max(n, 0), np.int64), np.ones(max(n, 0), bool)
    for i in range(k):
        c = code[i : i + n] if n > 0 else code[:0]
        at, known = at * len(letters) + c, known & (c >= 0)
    return np.stack([np.where(known, c[np.where(known, at, 0)], 0.0) for c in columns], axis=1)


def _factored(table: DataFrame, lags: int, kind: str) -> tuple[int, list[str], Callable[[Slice], list[np.ndarray]]]:
    """k, the table's properties, and what gives a slice's factors: row, lag, property, other (-1: none) and value."""
    if kind not in ("parallel", "first", "series", "auto", "cross"):
        raise ValueError(f"no factors of kind {kind}")
    k, names, values = table_values(table)
    letters = "".join(sorted({c for v in values.values() for w in v for c in w}))
    columns = []
    for name in names:
        column = np.zeros(len(letters) ** k)
        for w, x in values[name].items():
            column[reduce(lambda a, c: a * len(letters) + letters.index(c), w, 0)] = x
        columns.append(column)

    def found(part: Slice) -> list[np.ndarray]:
        p = _tracks(part, k, columns, letters)
        many = len(part.length)
        some = np.flatnonzero(part.length >= k + lags)
        out: list[list] = [[], [], [], [], []]

        def add(lag: int, u: int, v: int, x: np.ndarray) -> None:
            for column, more in zip(out, (some, np.full(len(some), lag), np.full(len(some), u), np.full(len(some), v), x[some]), strict=True):
                column.append(more)

        for lag in range(1, lags + 1):
            n = max(0, len(p) - lag)
            at = np.flatnonzero(part.row[:n] == part.row[lag + k - 1 : lag + k - 1 + n])
            row, m = part.row[at], np.maximum(part.length - k - lag + 1, 1).astype(float)
            total = lambda x, row=row: np.bincount(row, weights=x, minlength=many)
            a, b = p[at], p[at + lag]
            if kind == "parallel":
                add(lag, -1, -1, total(((a - b) ** 2).mean(axis=1)) / m)
            elif kind == "first":
                early = part.place()[at] < part.length[row] - 1 - lags
                add(lag, -1, -1, total(((a - b) ** 2).mean(axis=1) * early) / np.maximum(part.length - lag - 1, 1))
            elif kind == "series":
                for u in range(len(names)):
                    add(lag, u, u, total(a[:, u] * b[:, u]) / m)
            else:
                mean = [total(a[:, u]) / np.maximum(part.length, 1) for u in range(len(names))]
                for u in range(len(names)):
                    for v in range(len(names)) if kind == "cross" else (u,):
                        if kind == "auto":
                            add(lag, u, u, total((a[:, u] - mean[u][row]) * b[:, u]) / m)
                        elif u != v:
                            add(lag, u, v, total((a[:, u] - mean[u][row]) * (b[:, v] - mean[v][row])) / m)
        if not out[0]:
            return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, float)]
        return [np.concatenate(c) for c in out]

    return k, names, found


def factors(s: DataFrame, table: DataFrame, lags: int, kind: str) -> DataFrame:
    """(seq_id, lag, property, other, value) for lags from 1, of sequences that have k-mers at the largest lag.

    kind: "parallel": mean squared difference of k-mers at a lag, over positions and properties (one row a lag, no property); "first":
    the same over the positions that the largest lag leaves, by the length less lag and 1; "series": mean product of each property with
    itself; "auto": mean of (p - m) q of each property with itself, q at the lag; "cross": of (p - m) (q - m') of each two
    properties. m is the sum over the positions that the lag leaves, by the sequence's length.
    """
    _, names, found = _factored(table, lags, kind)

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        rows, lag, u, v, x = found(part)
        name = lambda i: pa.array(names, pa.string()).take(pa.array(i, mask=i < 0))
        return rows, [pa.array(lag.astype(np.int32)), name(u), name(v), pa.array(x)]

    return by_slice(s, ("seq_id",), "lag int, property string, other string, value double", rule)


def general_pseudo_composition(s: DataFrame, table: DataFrame, lags: int, weight: float, kind: str = "series", words: int | None = None) -> DataFrame:
    """(seq_id, feature, value): shares of k-mers and weighted factors over 1 + weight x sum of the factors. The k-mers are as long as the
    table's, or `words`; kind as for factors(). Words are counted where the factors are worked out, so nothing is shuffled; rows without a
    seq_id have none, repeated rows are worked out each."""
    own, names, found = _factored(table, lags, kind)
    k = words or own

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        rows, lag, u, _, x = found(part)
        d = 1 + weight * np.bincount(rows, x, len(part.length))
        row, _, kmers, count, total = counted(part, [tuple(range(k))])
        has = np.flatnonzero(np.bincount(rows, minlength=len(part.length))[row])
        # the names of all factors, a property after the other, and of none
        every = pa.array([f"theta_{j + 1}" + (f"_{n}" if n else "") for j in range(lags) for n in ("", *names)], pa.string())
        feature = pa.concat_arrays([kmers.take(pa.array(has)), every.take(pa.array((lag - 1) * (len(names) + 1) + u + 1))])
        at = np.concatenate([row[has], rows])
        return at, [feature, pa.array(np.concatenate([count[has] / total[has], weight * x]) / d[at])]

    both = by_slice(s.where("seq_id is not null"), ("seq_id",), "feature string, value double", rule)
    return both.withColumn("value", F.round("value", 9))


def covariances(s: DataFrame, table: DataFrame, lags: int, kinds: tuple[str, ...] = ("auto", "cross")) -> DataFrame:
    """(seq_id, lag, property, other, value): auto- and cross-covariances of the table's properties."""
    parts = [factors(s, table, lags, kind) for kind in kinds]
    return reduce(DataFrame.unionByName, parts).select("seq_id", "lag", "property", "other", F.round("value", 9).alias("value"))


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """(seq_id, descriptor, feature, value): descriptors (seq_id, feature, value) in one long table."""
    return reduce(DataFrame.unionByName, [p.select("seq_id", F.lit(name).alias("descriptor"), "feature", F.col("value").cast("double").alias("value")) for name, p in parts.items()])


def wide(long: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """A row for each seq_id with a column descriptor_feature for each of `columns`, 0 where it does not occur: one aggregation."""
    value = lambda d, f: F.coalesce(F.max(F.when((F.col("descriptor") == d) & (F.col("feature") == f), F.col("value"))), F.lit(0.0))
    return long.groupBy("seq_id").agg(*[value(d, f).alias(f"{d}_{f}") for d, f in columns])
