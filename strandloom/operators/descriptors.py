"""More descriptors of sequences: scores from counts, spaced triads, pseudo-composition of residues, couplings, covariances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.residues import CODING_CONTENT, CODING_POSITION
from strandloom.operators import correlations as C
from strandloom.operators.arrays import Slice, by_slice, counted
from strandloom.operators.kmers import SEVEN_GROUPS, grouped, kmer_counts, pair_counts, stretches, upto
from strandloom.operators.sequences import AMINO_ACIDS, NUCLEOTIDES


def zero_filled(s: DataFrame, k: int, alphabet: str) -> DataFrame:
    """(seq_id, kmer, cnt, total) for all k-mers of the alphabet, 0 for those that do not occur; shorter sequences have no rows."""
    words = [""]
    for _ in range(k):
        words = [w + c for w in words for c in alphabet]
    counts = kmer_counts(s, k).withColumnRenamed("cnt", "found")
    grid = s.where(F.length("seq") >= k).select("seq_id", (F.length("seq") - (k - 1)).cast("long").alias("total"), F.explode(F.array(*map(F.lit, words))).alias("kmer"))
    return grid.join(counts, ["seq_id", "kmer"], "left").select("seq_id", "kmer", F.coalesce("found", F.lit(0)).cast("long").alias("cnt"), "total")


def stepped_composition(s: DataFrame, width: int, step: int, k: int) -> DataFrame:
    """(seq_id, k, kmer, cnt, total): words of 1 to k characters inside windows of `width` that begin every `step`, until a window ends
    less than `step` before the sequence's end; total is the number of words of that length."""
    parts = stretches(s, width, step, "short").select("seq_id", F.col("kmer").alias("seq"))
    counts = upto(parts, k).groupBy("seq_id", "k", "kmer").agg(F.sum("cnt").alias("cnt"))
    total = counts.groupBy("seq_id", "k").agg(F.sum("cnt").alias("total"))
    return counts.join(total, ["seq_id", "k"]).select("seq_id", "k", "kmer", "cnt", "total")


def spaced_triads(s: DataFrame, gaps: range) -> DataFrame:
    """(seq_id, gap, triad, score): (count - least) / most over triads of seven residue groups with `gap` residues between neighbours.
    Scores are made where the words are counted; rows without a seq_id have none."""
    shapes = [(0, g + 1, 2 * g + 2) for g in gaps]

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        row, shape, words, count, _ = counted(part, shapes)
        many = len(part.length)
        at = shape.astype(np.int64) * many + row
        most, least = np.zeros(many * len(shapes), np.int64), np.full(many * len(shapes), np.iinfo(np.int64).max)
        np.maximum.at(most, at, count)
        np.minimum.at(least, at, count)
        least[np.bincount(at, minlength=len(least)) != 343] = 0
        return row, [pa.array(np.array(gaps, np.int32)[shape]), words, pa.array((count - least[at]) / most[at])]

    found = by_slice(grouped(s.where("seq_id is not null"), SEVEN_GROUPS), ("seq_id",), "gap int, triad string, score double", rule)
    return found.withColumn("score", F.round("score", 9))


def _count(c: str, text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def coding_score(s: DataFrame) -> DataFrame:
    """(seq_id, score): how much a sequence's bases prefer one of three codon places, and their shares, by published tables. All bases are
    counted in one pass."""

    def looked_up(value: np.ndarray, table: tuple, steps: list[float]) -> np.ndarray:
        out = np.full(len(value), table[len(steps) - 1], float)
        for i in range(len(steps) - 2, -1, -1):
            out[value >= steps[i]] = table[i]
        return out

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, size = np.flatnonzero(part.length), len(NUCLEOTIDES) + 1
        code = part.looked_up({c: float(i) for i, c in enumerate(NUCLEOTIDES)}, float(len(NUCLEOTIDES))).astype(np.int64)
        counts = np.bincount((part.row * 3 + part.place() % 3) * size + code, minlength=len(part.length) * 3 * size).reshape(-1, 3, size)[some]
        score = np.zeros(len(some))
        for i, base in enumerate(NUCLEOTIDES):
            own = counts[:, :, i]
            table, weight = CODING_POSITION["table"][base]
            score = score + looked_up(own.max(axis=1) / (own.min(axis=1) + 1), table, CODING_POSITION["steps"]) * weight
            table, weight = CODING_CONTENT["table"][base]
            score = score + looked_up(own.sum(axis=1) / part.length[some], table, CODING_CONTENT["steps"]) * weight
        return some, [pa.array(score)]

    return by_slice(s, ("seq_id",), "score double", rule).withColumn("score", F.round("score", 6))


def residue_pseudo_composition(s: DataFrame, table: dict[str, tuple[float, ...]], lags: int, weight: float) -> DataFrame:
    """(seq_id, feature, value): residue counts and weighted factors over 1 + weight x sum of factors; longer than `lags` only."""
    return C.weighted_residues(s, table, lags, weight, AMINO_ACIDS, "parallel")


def amphiphilic_pseudo_composition(s: DataFrame, table: dict[str, tuple[float, ...]], lags: int, weight: float) -> DataFrame:
    """The same with a factor for each property and lag: the mean product of neighbours at the lag."""
    return C.weighted_residues(s, table, lags, weight, AMINO_ACIDS, "product")


def _weighted(s: DataFrame, theta: DataFrame, weight: float) -> DataFrame:
    total = theta.groupBy("seq_id").agg((1 + weight * F.sum("theta")).alias("d"))
    counts = F.array(*[F.struct(F.lit(a).alias("feature"), _count(a, F.col("seq")).cast("double").alias("value")) for a in AMINO_ACIDS])
    f = s.select("seq_id", F.explode(counts).alias("x")).select("seq_id", "x.feature", "x.value")
    t = theta.select("seq_id", "feature", (weight * F.col("theta")).alias("value"))
    return f.unionByName(t).join(total, "seq_id").select("seq_id", "feature", F.round(F.col("value") / F.col("d"), 6).alias("value"))


def coupling_numbers(s: DataFrame, distances: DataFrame, lags: int) -> DataFrame:
    """(seq_id, lag, tau): sum of squared distances of residues at a lag over their number. distances: (a, b, d) of all ordered
    pairs of residues, a small table."""
    out = pair_counts(s, range(lags)).select("seq_id", (F.col("gap") + 1).alias("lag"), F.col("pair").alias("kmer"), "cnt")
    d = distances.select(F.concat("a", "b").alias("kmer"), "d")
    sums = out.join(F.broadcast(d), "kmer").groupBy("seq_id", "lag").agg(F.sum(F.col("cnt") * F.col("d") * F.col("d")).alias("t"), F.sum("cnt").alias("n"))
    return sums.select("seq_id", "lag", (F.col("t") / F.col("n")).alias("tau"))


def sequence_order(s: DataFrame, distances: DataFrame, lags: int, weight: float) -> DataFrame:
    """(seq_id, feature, value): residue counts and weighted coupling sums over 1 + weight x the sums of all lags; sequences longer
    than `lags` only."""
    long = s.where(F.length("seq") > lags)
    n = long.select("seq_id", F.length("seq").alias("n"))
    tau = coupling_numbers(long, distances, lags).join(n, "seq_id")
    return _weighted(long, tau.select("seq_id", F.concat(F.lit("tau"), F.col("lag").cast("string")).alias("feature"), (F.col("tau") * (F.col("n") - F.col("lag"))).alias("theta")), weight)


def find_slices(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(seq_id, peptide, start, slice): where each peptide (seq_id, peptide) first lies in its protein (seq_id, seq, track), and the
    part of the track (a character for each residue) beside it; peptides that are not found have no row."""
    at = F.instr("seq", F.col("peptide"))
    rows = peptides.join(proteins.select("seq_id", "seq", "track"), "seq_id").withColumn("start", at).where("start > 0")
    return rows.select("seq_id", "peptide", F.col("start").cast("int").alias("start"), F.substr("track", "start", F.length("peptide")).alias("slice"))
