"""Graphs of k-mers: which follow each other in a sequence, and what the graph looks like."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.arrays import Lag, Slice, by_slice, word_counts

WEDGES = 1 << 22  # pairs of edges looked up at once


def transitions(s: DataFrame, k: int) -> DataFrame:
    """(seq_id, a, b, cnt): k-mers that begin one character after the other; each is a word of k + 1 characters, so they are counted as
    words are."""
    w = word_counts(s, [tuple(range(k + 1))])
    return w.select("seq_id", F.substring("word", 1, k).alias("a"), F.substring("word", 2, k).alias("b"), "cnt")


def _corners(low: np.ndarray, high: np.ndarray, keys: np.ndarray, many: int) -> np.ndarray:
    """How many triangles each node is in: pairs of edges that leave one node (low, sorted) for others (high) are looked up among all
    edges (keys, sorted), `WEDGES` at a time."""
    at = np.arange(len(low))
    later = np.searchsorted(low, low, "right") - 1 - at  # edges of the same node further on
    upto = np.cumsum(later)
    out, begin = np.zeros(many, np.int64), 0
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + WEDGES, "right")))
        n = later[begin:end]
        first = np.repeat(at[begin:end], n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        a, b = high[first], high[second]
        key = np.minimum(a, b) * many + np.maximum(a, b)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == key)
        for node in (low[first[hit]], a[hit], b[hit]):
            out += np.bincount(node, minlength=many)
        begin = end
    return out


def graph_metrics(s: DataFrame, k: int) -> DataFrame:
    """(seq_id, nodes, edges, mean_degree, max_degree, density, triangles, transitivity, mean_clustering) of each sequence's undirected
    graph of k-mers, without weights and loops.

    Graphs are made where the sequences are. Triangles come from wedges at their node of least degree (then name), so that a k-mer with very
    many neighbours opens few; transitivity is three times the triangles over all wedges, mean clustering the mean of each node's share of
    linked neighbours, 0 for nodes of one neighbour. Sequences of fewer than k + 1 characters, or of one k-mer only, have no rows; repeated
    rows are graphs of their own.
    """

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        node = np.unique(part.chars, return_inverse=True)[1].astype(np.int64)
        letters, own = node, int(node.max(initial=0)) + 1
        for i in range(1, k):
            node = np.unique(node[: len(letters) - i] * own + letters[i:], return_inverse=True)[1] if len(letters) > i else node[:0]
        at = Lag(part, 1, k)
        a, b = at.first(node), at.then(node)
        there = np.flatnonzero(at.there & (a != b))
        kinds = int(node.max(initial=0)) + 1
        ends = np.stack([np.minimum(a, b)[there], np.maximum(a, b)[there]]) + at.row[there] * kinds
        nodes, ends = np.unique(ends, return_inverse=True)
        ends, many = ends.reshape(2, -1), len(nodes)
        keys = np.unique(ends[0] * many + ends[1])
        a, b = keys // max(many, 1), keys % max(many, 1)
        degree = np.bincount(np.concatenate([a, b]), minlength=many)
        up = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
        low, high = np.where(up, a, b), np.where(up, b, a)
        order = np.argsort(low, kind="stable")
        t = _corners(low[order], high[order], keys, many)
        row = nodes // kinds
        size = len(part.length)
        per = lambda x: np.bincount(row, x, size)[some]
        count = np.bincount(row, minlength=size)
        some = np.flatnonzero(count)
        pairs = degree * (degree - 1) / 2
        share = np.where(pairs > 0, t / np.maximum(pairs, 1), 0.0)
        largest = np.maximum.reduceat(degree, np.flatnonzero(np.diff(row, prepend=-1))) if many else degree
        n, m, wedges, corners = count[some], per(degree) / 2, per(pairs), per(t)
        means = (2 * m / n, 2 * m / np.maximum(n * (n - 1), 1), np.where(wedges > 0, corners / np.maximum(wedges, 1), 0.0), per(share) / n)
        return some, [pa.array(x.astype(np.int64)) for x in (n, m, largest, corners // 3)] + [pa.array(x) for x in means]

    columns = "nodes long, edges long, max_degree long, triangles long, mean_degree double, density double, transitivity double, mean_clustering double"
    rounded = lambda *names: [F.round(c, 6).alias(c) for c in names]
    return by_slice(s, ("seq_id",), columns, rule).select("seq_id", "nodes", "edges", *rounded("mean_degree"), "max_degree", *rounded("density"), "triangles", *rounded("transitivity", "mean_clustering"))
