"""Global properties of proteins from residue counts, and class composition, transition and distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.residues import AMIDE_CTERM_PK, ENERGIES, FORMULAS, NEGATIVE_PK, POSITIVE_PK, WEIGHTS
from strandloom.operators.arrays import Lag, Slice, by_slice, class_places
from strandloom.operators.correlations import lagged_products
from strandloom.operators.kmers import bound, pair_counts

WATER = 18.015
AMIDE_LOSS = 0.98


def residue(c: str) -> Column:
    """How often a residue stands in seq: no rows are made for single positions."""
    return F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))


def _sum(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + residue(c) * F.lit(w)
    return out


def weight(amide: bool = False) -> Column:
    """Molecular weight: residues less the water of their bonds; three digits, as the weights have, so that nothing is rounded at a tie."""
    return F.round(_sum(WEIGHTS) - WATER * (F.length("seq") - 1) - (AMIDE_LOSS if amide else 0.0), 3)


def charge(ph: float = 7.4, amide: bool = True) -> Column:
    """Net charge at a pH: each group's share that is charged, to three digits."""
    out = F.lit(0.0)
    for c, pk in POSITIVE_PK.items():
        x = 10 ** (pk - ph)
        out = out + (F.lit(1) if c == "Nterm" else residue(c)) * F.lit(x / (x + 1))
    for c, pk in NEGATIVE_PK.items():
        x = 10 ** (ph - (AMIDE_CTERM_PK if amide and c == "Cterm" else pk))
        out = out - (F.lit(1) if c == "Cterm" else residue(c)) * F.lit(x / (x + 1))
    return F.round(out, 3)


def share(letters: str) -> Column:
    total = F.lit(0)
    for c in letters:
        total = total + residue(c)
    return total / F.length("seq")


def aliphatic() -> Column:
    return 100 * (residue("A") + 2.9 * residue("V") + 3.9 * (residue("I") + residue("L"))) / F.length("seq")


def boman() -> Column:
    return _sum(ENERGIES) / F.length("seq")


def global_properties(s: DataFrame, ph: float = 7.4, amide: bool = True) -> DataFrame:
    """A row for each sequence; empty sequences have nulls."""
    p = s.where("length(seq) > 0").select(
        "seq_id", F.length("seq").alias("len"), weight(amide).alias("mw"), charge(ph, amide).alias("charge"), F.round(share("FWY"), 6).alias("aromaticity"),
        F.round(aliphatic(), 6).alias("aliphatic_index"), F.round(boman(), 6).alias("boman_index"), F.round(share("ACFILMV"), 6).alias("hydrophobic_ratio"),
    )
    return s.select("seq_id").join(p.withColumn("charge_density", F.round(F.col("charge") / F.col("mw"), 10)), "seq_id", "left")


def classed(s: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Replaces residues by the number of their group, from 1."""
    return s.withColumn("seq", F.translate("seq", "".join(groups), "".join(str(i + 1) * len(g) for i, g in enumerate(groups))))


Properties = dict[str, tuple[str, ...]]


def _classes(s: DataFrame, properties: Properties, least: int) -> DataFrame:
    """(seq_id, n, c0, c1, ...): for each property the sequence as its residues' group numbers, worked out once."""
    translated = {f"c{j}": F.translate("seq", "".join(g), "".join(str(i + 1) * len(x) for i, x in enumerate(g))) for j, g in enumerate(properties.values())}
    return bound(s.where(F.length("seq") >= least), "seq_id", n=F.length("seq"), **translated)


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def class_composition(s: DataFrame, properties: Properties) -> DataFrame:
    """(seq_id, property, grp, share) of each group; counted within the row."""
    row = [F.struct(F.lit(name).alias("property"), F.lit(i + 1).alias("grp"), F.round(_occurrences(F.col(f"c{j}"), str(i + 1)) / F.col("n"), 9).alias("share")) for j, (name, g) in enumerate(properties.items()) for i in range(len(g))]
    return _classes(s, properties, 1).select("seq_id", F.explode(F.array(*row)).alias("x")).select("seq_id", "x.*")


def class_transition(s: DataFrame, properties: Properties) -> DataFrame:
    """(seq_id, property, pair, share) of neighbours in different groups, either way round, over length - 1, 0 where there are
    none. Pairs of residues are counted once, and all properties' shares follow from the counts."""
    letters = {c: float(i) for i, c in enumerate(sorted({c for g in properties.values() for x in g for c in x}))}
    size = len(letters) + 1
    names, pairs, columns = [], [], []
    for name, g in properties.items():
        group = np.zeros(size, np.int64)
        for i in range(len(g), 0, -1):
            group[[int(letters[c]) for c in g[i - 1]]] = i
        for a in range(1, len(g) + 1):
            for b in range(a + 1, len(g) + 1):
                both = np.outer(group == a, group == b)
                names.append(name)
                pairs.append(f"{a}{b}")
                columns.append((both | both.T).ravel())
    table = np.stack(columns, axis=1).astype(float)

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some, at = np.flatnonzero(part.length >= 2), Lag(part, 1)
        code = part.looked_up(letters, float(size - 1)).astype(np.int64)
        key = (at.row * size + at.first(code)) * size + at.then(code)
        counts = np.bincount(key[at.there], minlength=at.many * size * size).reshape(at.many, -1)[some]
        share = (counts @ table) / (part.length[some] - 1)[:, None]
        which = pa.array(np.tile(np.arange(len(names)), len(some)))
        return np.repeat(some, len(names)), [pa.array(names, pa.string()).take(which), pa.array(pairs, pa.string()).take(which), pa.array(share.ravel())]

    return by_slice(s, ("seq_id",), "property string, pair string, share double", rule).withColumn("share", F.round("share", 9))


def class_distribution(s: DataFrame, properties: Properties) -> DataFrame:
    """(seq_id, property, grp, q, place): 100 position / length of the first, and of the floor(q n)-th (at least first), occurrence
    of each group, q in 0, 25, 50, 75, 100; 0 for a group that does not occur. Positions are found within the row."""
    p = class_places(s, properties, (0, 25, 50, 75, 100))
    return p.select("seq_id", "property", "grp", "q", F.round(100.0 * F.coalesce("at", F.lit(0)) / F.col("n"), 6).alias("place"))


def scale_autocorrelation(s: DataFrame, scale: dict[str, float], lags: int) -> DataFrame:
    """(seq_id, lag, value): mean of scale[i] scale[i + lag], lags from 0, for sequences longer than `lags`; made where the sequence is."""
    found = lagged_products(s, {c: (v,) for c, v in scale.items()}, range(lags))
    return found.select("seq_id", "lag", F.round("value", 6).alias("value"))


def scale_mean(s: DataFrame, scale: dict[str, float]) -> DataFrame:
    return s.where("length(seq) > 0").select("seq_id", F.round(_sum(scale) / F.length("seq"), 6).alias("value"))


def instability_index(s: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq_id, value): 10 / length times the sum of the weights, which count to six digits, of neighbouring residues.

    weights: (pair, weight), a table of pairs of residues as the published one; pairs that it lacks or that weigh null count 0.
    A single residue has 0; empty and null sequences have no rows.
    """
    own = s.where(F.length("seq") > 0)
    pairs = pair_counts(own, range(1)).join(weights.select("pair", "weight"), "pair")
    sums = pairs.groupBy("seq_id").agg(F.sum(F.col("cnt") * F.col("weight").cast("decimal(18,6)")).cast("double").alias("sum"))
    return own.select("seq_id", F.length("seq").alias("n")).join(sums, "seq_id", "left").select("seq_id", (10 * F.coalesce("sum", F.lit(0.0)) / F.col("n")).alias("value"))


def pair_weights(s: DataFrame) -> DataFrame:
    """(pair, weight): natural logarithm, to six digits, of how often two residues are neighbours over how often their first and
    second places alone would make them so."""
    p = pair_counts(s, range(1)).groupBy("pair").agg(F.sum("cnt").alias("n")).select("pair", "n", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"))
    first = p.groupBy("a").agg(F.sum("n").alias("na"))
    second = p.groupBy("b").agg(F.sum("n").alias("nb"))
    both = p.join(first, "a").join(second, "b").join(F.broadcast(p.agg(F.sum("n").alias("total"))))
    return both.select("pair", F.round(F.log(F.col("n") * F.col("total").cast("double") / (F.col("na") * F.col("nb").cast("double"))), 6).alias("weight"))


def molecular_formula(s: DataFrame, amide: bool = False) -> DataFrame:
    """(seq_id, formula): atoms of the residues less the water of their bonds; an amide end has NH2 for OH. Atoms that do
    not occur are left out."""
    atoms = [sum((residue(c) * n[i] for c, n in FORMULAS.items()), F.lit(0)) for i in range(5)]
    bonds = F.length("seq") - 1
    atoms[1], atoms[3] = atoms[1] - 2 * bonds, atoms[3] - bonds
    if amide:
        atoms[1], atoms[2], atoms[3] = atoms[1] + 1, atoms[2] + 1, atoms[3] - 1
    parts = [F.when(n > 0, F.concat(F.lit(a), n.cast("string"))) for a, n in zip("CHNOS", atoms, strict=True)]
    return s.where("length(seq) > 0").select("seq_id", F.concat_ws(" ", *parts).alias("formula"))


def isoelectric_point(s: DataFrame, amide: bool = True) -> DataFrame:
    """(seq_id, pi): the pH where the charge (three digits) vanishes, by halving 0 to 14 until the bounds are within 1e-4 or
    the charge is just 0; a fold over each row's residue counts."""
    counts = {c: residue(c) for c in (*POSITIVE_PK, *NEGATIVE_PK) if len(c) == 1}
    c = s.where("length(seq) > 0").select("seq_id", *[n.alias(f"n_{k}") for k, n in counts.items()])

    def net(ph: Column) -> Column:
        out = F.lit(0.0)
        for k, pk in POSITIVE_PK.items():
            x = F.pow(F.lit(10.0), F.lit(pk) - ph)
            out = out + (F.lit(1) if k == "Nterm" else F.col(f"n_{k}")) * x / (x + 1)
        for k, pk in NEGATIVE_PK.items():
            x = F.pow(F.lit(10.0), ph - F.lit(AMIDE_CTERM_PK if amide and k == "Cterm" else pk))
            out = out - (F.lit(1) if k == "Cterm" else F.col(f"n_{k}")) * x / (x + 1)
        return F.round(out, 3)

    kind = "struct<low:double,high:double,done:boolean>"

    def halve(a: Column, _: Column) -> Column:
        mid = (a["low"] + a["high"]) / 2
        q = net(mid)
        step = F.struct(F.when(q >= 0, mid).otherwise(a["low"]).alias("low"), F.when(q <= 0, mid).otherwise(a["high"]).alias("high"), ((q == 0) | (a["high"] - a["low"] <= 0.0001)).alias("done")).cast(kind)
        return F.when(a["done"], a).otherwise(step)

    begin = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), F.lit(False).alias("done")).cast(kind)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(20)), begin, halve)
    return c.select("seq_id", end.alias("e")).select("seq_id", F.round((F.col("e.low") + F.col("e.high")) / 2, 3).alias("pi"))


def hydrophobic_moment(s: DataFrame, scale: dict[str, float], degrees: float = 100.0) -> DataFrame:
    """(seq_id, moment) over the whole sequence: the length of the sum of scale values turned by an angle for each position,
    over the number of positions."""
    import math

    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    angle = math.radians(degrees)
    v = s.where("length(seq) > 0").select("seq_id", F.transform(F.split("seq", ""), lambda c, i: F.struct((table[c] * F.cos(i * angle)).alias("x"), (table[c] * F.sin(i * angle)).alias("y"))).alias("v"))
    total = lambda k: F.aggregate("v", F.lit(0.0), lambda a, p: a + p[k])
    return v.select("seq_id", F.round(F.sqrt(total("x") * total("x") + total("y") * total("y")) / F.size("v"), 6).alias("moment"))
