"""Helpers that the corpus operators share: word splitting, hashing and connected groups."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.storage import drop, saved, shared_dir  # noqa: F401

#: Bytes that end a word for the benchmark rule; A-Z becomes a-z, other ASCII but 0-9 and a-z becomes a blank.
_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32
    for b in range(256)
)


def give_back() -> None:
    """Returns memory that earlier tasks of this Python worker have freed to the system, where its C library can: workers live on
    from stage to stage, and what allocators keep for themselves counts beside the heap of the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at any ASCII character but letters and digits."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of anything but blank and U+0009 to U+000D, unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a 64-bit number for each byte
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 1 << 20
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hash of each run of bytes between blanks (U+0020, U+0009 to U+000D).

    A polynomial over the bytes' numbers: prefix sums give every word's in one pass; texts are read in slices that end at a
    blank, so memory does not grow with the text.
    """
    found, at = [], 0
    while at < len(data):
        end = at + _SLICE
        if end < len(data):
            while end < len(data) and not _BLANK[data[end]]:
                end += 1
        part = np.frombuffer(data[at:end], np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[part], [True]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        power, inverse = _powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=prefix[1:])
        found.append(mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def fold_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(_FOLD) if text else b""


def plain_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes: one per start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each connected group: (node, root) for every node of edges (a, b).

    Alternates two joins-free groupings (large star, small star) until the edges are stars. Each round costs two
    aggregations over the edges and a hot node's edges are split by a join that adaptive execution may cut up.
    Nulls and loops are ignored; an empty input gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # edges that have stopped changing are stars; their sum is taken as they are written
        seen = Observation()
        new = small.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        last, e = e, saved(new, "edges")
        drop(last)
        if (now := (seen.get["n"], seen.get["sum"])) == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("connected groups did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
