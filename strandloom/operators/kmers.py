"""Windows over sequences and what is counted in them. Everything is long: a row for each feature that occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.arrays import word_counts

#: Residue groups; fixed values.
FIVE_GROUPS = {"G": "GAVLMI", "F": "FYW", "K": "KRH", "D": "DE", "S": "STCPNQ"}
SEVEN_GROUPS = {"1": "AGV", "2": "ILFP", "3": "YMTS", "4": "HNQW", "5": "RK", "6": "DE", "7": "C"}
#: Codons that encode each amino acid; fixed values.
CODONS = {"A": 4, "C": 2, "D": 2, "E": 2, "F": 2, "G": 4, "H": 2, "I": 3, "K": 2, "L": 6, "M": 1, "N": 2, "P": 4, "Q": 2, "R": 6, "S": 6, "T": 4, "V": 4, "W": 1, "Y": 2}


def grouped(s: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Replaces residues by the letter of their group."""
    source = "".join(groups.values())
    target = "".join(g * len(members) for g, members in groups.items())
    return s.withColumn("seq", F.translate("seq", source, target))


def window_array(k: int) -> tuple[Column, Column]:
    """Windows of seq read from one array of its characters: a substring would walk from the start each time."""
    found = F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.array_join(F.slice("chars", i + 1, k), ""))
    return F.split("seq", ""), F.when(F.length("seq") >= k, found).otherwise(F.array().cast("array<string>"))


def windows(s: DataFrame, k: int) -> DataFrame:
    chars, found = window_array(k)
    return s.withColumn("chars", chars).select("seq_id", "label", F.explode(found).alias("kmer"))


def bound(s: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns `keep`, and new ones that are worked out once for a row, however often later steps use them: a generator stands
    between, through which nothing is inlined."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return s.select(*keep, F.explode(F.array(row)).alias("x")).select(*keep, *[f"x.{name}" for name in columns])


def stretches(s: DataFrame, width: int, step: int, stop: str = "touch") -> DataFrame:
    """(seq_id, label, start, kmer): windows of `width` characters that begin every `step`, the last as short as what is left.

    stop="touch": the first window that touches the end is the last; stop="short": so is the first whose end lies less than `step`
    before the sequence's end. Empty sequences have none.
    """
    short = F.length("seq") - width - (step - 1 if stop == "short" else 0)
    last = step * F.ceil(F.greatest(short, F.lit(0)) / step).cast("int")
    cut = lambda i: F.struct(i.alias("start"), F.array_join(F.slice("chars", i + 1, width), "").alias("kmer"))
    rows = s.where("length(seq) > 0").withColumn("chars", F.split("seq", ""))
    return rows.select("seq_id", "label", F.explode(F.transform(F.sequence(F.lit(0), last, F.lit(step)), cut)).alias("x")).select("seq_id", "label", "x.start", "x.kmer")


def kmer_counts(s: DataFrame, k: int, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(seq_id, kmer, cnt); counted where the sequence is, nothing is shuffled."""
    return word_counts(s, [tuple(range(k))], keep).select(*keep, F.col("word").alias("kmer"), "cnt")


def shares(counts: DataFrame, *by: str) -> DataFrame:
    """Adds freq = cnt / sum of cnt over seq_id and `by`."""
    return counts.withColumn("freq", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("seq_id", *by)))


def kmer_shares(s: DataFrame, k: int, gap: int = 0, skip: str = "") -> DataFrame:
    """(seq_id, kmer, cnt, freq) over the sequence's number of windows. gap: characters left out after the first one; skip: what is
    written in their place."""
    shape = (0, *range(1 + gap, k + gap))
    word = F.concat(F.substring("word", 1, 1), F.lit(skip), F.substring("word", 2, k)) if skip else F.col("word")
    return word_counts(s, [shape]).select("seq_id", word.alias("kmer"), "cnt", (F.col("cnt") / F.col("total")).alias("freq"))


def composition(s: DataFrame, k: int, digits: int = 6, **how) -> DataFrame:
    """(seq_id, kmer, freq): counts over the number of windows, rounded."""
    return kmer_shares(s, k, **how).select("seq_id", "kmer", F.round("freq", digits).alias("freq"))


def upto(s: DataFrame, k: int) -> DataFrame:
    """Counts for every length from 1 to k: (seq_id, k, kmer, cnt, total), in one scan."""
    return word_counts(s, [tuple(range(i)) for i in range(1, k + 1)]).select("seq_id", (F.col("shape") + 1).alias("k"), F.col("word").alias("kmer"), "cnt", "total")


def canonical(c: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(c, F.reverse(F.translate(c, "ACGT", "TGCA")))


def canonical_counts(s: DataFrame, k: int) -> DataFrame:
    return kmer_counts(s, k).groupBy("seq_id", canonical(F.col("kmer")).alias("kmer")).agg(F.sum("cnt").alias("cnt"))


def canonical_upto(s: DataFrame, k: int) -> DataFrame:
    """(seq_id, k, kmer, cnt, total) of canonical k-mers of every length from 1 to k."""
    return upto(s, k).groupBy("seq_id", "k", "total", canonical(F.col("kmer")).alias("kmer")).agg(F.sum("cnt").alias("cnt"))


def _entropies(s: DataFrame, ks: tuple[int, ...], value) -> DataFrame:
    """(seq_id, k, entropy) for all k out of one scan; a sequence's words are summed up in the task that has counted them."""
    shape = F.element_at(F.array(*map(F.lit, ks)), F.col("shape") + 1)
    p = word_counts(s, [tuple(range(k)) for k in ks]).select("seq_id", shape.alias("k"), (F.col("cnt") / F.col("total")).alias("freq"))
    h = p.groupBy("seq_id", "k").agg(F.round(value, 6).alias("h"))
    return h.select("seq_id", "k", F.when(F.abs("h") > 0, F.col("h")).alias("entropy"))


def shannon(s: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(seq_id, k, entropy) in bits; null where it is zero; sequences shorter than k have no row."""
    return _entropies(s, ks, -F.sum(F.col("freq") * F.log2("freq")))


def tsallis(s: DataFrame, ks: tuple[int, ...], q: float) -> DataFrame:
    """(seq_id, k, entropy): (1 - sum p^q) / (q - 1); null where it is zero."""
    return _entropies(s, ks, (1 - F.sum(F.pow("freq", F.lit(q)))) / (q - 1))


def dipeptide_deviation(s: DataFrame) -> DataFrame:
    """(seq_id, kmer, dde): deviation of all 400 dipeptides' shares from what codon counts lead to expect; an absent one has a share
    of 0. Sequences of fewer than two residues have no rows."""
    codons = F.create_map(*[F.lit(x) for a, n in CODONS.items() for x in (a, n)])
    grid = s.where(F.length("seq") >= 2).select("seq_id", F.length("seq").alias("n"), F.explode(F.array(*[F.lit(a + b) for a in CODONS for b in CODONS])).alias("kmer"))
    f = grid.join(kmer_shares(s, 2), ["seq_id", "kmer"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    tm = codons[F.substring("kmer", 1, 1)] / 61.0 * codons[F.substring("kmer", 2, 1)] / 61.0
    return f.select("seq_id", "kmer", F.round((F.col("freq") - tm) / F.sqrt(tm * (1 - tm) / (F.col("n") - 1)), 6).alias("dde"))


def spaced_pairs(s: DataFrame, gaps: range) -> DataFrame:
    """(seq_id, gap, pair, freq) of residues with `gap` others between them."""
    return pair_counts(s, gaps).select("seq_id", "gap", "pair", F.round(F.col("cnt") / F.col("total"), 9).alias("freq"))


def pair_counts(s: DataFrame, gaps: range) -> DataFrame:
    """(seq_id, gap, total, pair, cnt) of residues with `gap` others between them; all gaps come out of one scan."""
    gap = F.element_at(F.array(*map(F.lit, gaps)), F.col("shape") + 1)
    return word_counts(s, [(0, g + 1) for g in gaps]).select("seq_id", gap.alias("gap"), "total", F.col("word").alias("pair"), "cnt")


def triad_scores(s: DataFrame) -> DataFrame:
    """(seq_id, kmer, score): (count - min) / max over all 343 triads of seven groups; min is 0 unless all occur."""
    c = kmer_counts(grouped(s, SEVEN_GROUPS), 3)
    w = Window.partitionBy("seq_id")
    least = F.when(F.count("*").over(w) == 343, F.min("cnt").over(w)).otherwise(F.lit(0))
    return c.select("seq_id", "kmer", F.round((F.col("cnt") - least) / F.max("cnt").over(w), 9).alias("score"))
