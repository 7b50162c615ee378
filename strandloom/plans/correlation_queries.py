"""Queries over properties along sequences and over neighbours, each with SQL for another engine."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandloom.functions.residues import AMIDE_CTERM_PK, DINUCLEOTIDES, EISENBERG, ENERGIES, FORMULAS, NEGATIVE_PK, POSITIVE_PK, SIDE_CHAINS, WEIGHTS
from strandloom.operators import correlations as C
from strandloom.operators import neighbours as N
from strandloom.operators import peptides as P
from strandloom.operators.arrays import autocorrelations
from strandloom.operators.sequences import read, sequence_table
from strandloom.plans.property_queries import _n
from strandloom.plans.sequence_queries import DNA, PROTEIN

Q: dict = {}
SQL: dict[str, str] = {}


def _dna(spark, d):
    return sequence_table(spark, d, "dna")


def _protein(spark, d):
    return sequence_table(spark, d, "protein")


_PROPS = ", ".join(f"('{k}', {u}, {v}::double)" for k, values in DINUCLEOTIDES.items() for u, v in enumerate(values))
#: v(seq_id, n, i, u, x): property u of the dinucleotide at i.
_VALUES = (
    f"{DNA}, props(d, u, x) AS (VALUES {_PROPS}), w AS (SELECT seq_id, length(seq) AS n, i, substr(seq, i, 2) AS d FROM (SELECT *, unnest(range(1, length(seq))) AS i FROM dna WHERE length(seq) >= 2)), "
    "v AS (SELECT seq_id, n, i, u, x FROM w JOIN props USING (d)), lags AS (SELECT unnest(range(1, {0}))::int AS lag)"
)
_THETA = "t AS (SELECT a.seq_id, lag, sum((a.x - b.x) * (a.x - b.x)) / 6 / any_value(a.n - 1 - lag) AS theta FROM v a CROSS JOIN lags JOIN v b ON a.seq_id = b.seq_id AND a.u = b.u AND b.i = a.i + lag WHERE a.n - 1 > {0} GROUP BY a.seq_id, lag)"

Q["parallel_factors"] = lambda spark, d: C.parallel_factors(_dna(spark, d), DINUCLEOTIDES, 2, 3).select("seq_id", "lag", F.round("theta", 9).alias("theta"))
SQL["parallel_factors"] = f"WITH {_VALUES.format(4)}, {_THETA.format(3)} SELECT seq_id, lag, round(theta, 9) AS theta FROM t"
Q["pse_dnc"] = lambda spark, d: C.pseudo_composition(_dna(spark, d), DINUCLEOTIDES, 2, 3, 0.05)
SQL["pse_dnc"] = (
    f"WITH {_VALUES.format(4)}, {_THETA.format(3)}, z AS (SELECT seq_id, 1 + 0.05::double * sum(theta) AS z FROM t GROUP BY seq_id), "
    "c AS (SELECT seq_id, d, count(*) AS c FROM w GROUP BY seq_id, d), f AS (SELECT seq_id, d AS feature, round(c / (sum(c) OVER (PARTITION BY seq_id))::double, 9) AS value FROM c "
    "UNION ALL SELECT seq_id, 'theta' || lag::varchar, 0.05::double * theta FROM t) SELECT seq_id, feature, round(value / z, 5) AS value FROM f JOIN z USING (seq_id)"
)
Q["dac"] = lambda spark, d: C.autocovariance(_dna(spark, d), DINUCLEOTIDES, 2, 2)
SQL["dac"] = (
    f"WITH {_VALUES.format(3)} SELECT a.seq_id, lag, a.u AS prop, round((sum(a.x * b.x) - sum(a.x) / any_value(a.n) * sum(b.x)) / count(*), 9) AS value "
    "FROM v a CROSS JOIN lags JOIN v b ON a.seq_id = b.seq_id AND a.u = b.u AND b.i = a.i + lag WHERE a.n - 1 > 2 GROUP BY a.seq_id, lag, a.u"
)
_MEAN = sum(EISENBERG.values()) / len(EISENBERG)
_DEV = (sum((v - _MEAN) ** 2 for v in EISENBERG.values()) / len(EISENBERG)) ** 0.5
_SCALE = "CASE c " + " ".join(f"WHEN '{c}' THEN {(v - _MEAN) / _DEV!r}::double" for c, v in EISENBERG.items()) + " END"
Q["spatial_autocorrelation"] = lambda spark, d: C.spatial_autocorrelation(_protein(spark, d), EISENBERG, 4)
SQL["spatial_autocorrelation"] = (
    f"WITH {PROTEIN}, v AS (SELECT seq_id, list_transform(string_split(seq, ''), lambda c: {_SCALE}) AS v FROM protein WHERE length(seq) > 4), m AS (SELECT seq_id, v, len(v) AS n, list_sum(v) / len(v) AS m FROM v), "
    "q AS (SELECT *, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) AS q FROM m), k AS (SELECT *, unnest(range(1, 5))::int AS lag FROM q) "
    "SELECT seq_id, lag, round(list_sum(list_transform(range(1, n - lag + 1), lambda i: v[i] * v[i + lag])) / (n - lag), 5) AS nmbroto, "
    "round(list_sum(list_transform(range(1, n - lag + 1), lambda i: (v[i] - m) * (v[i + lag] - m))) / (n - lag) / nullif(q / n, 0), 5) AS moran, "
    "round(list_sum(list_transform(range(1, n - lag + 1), lambda i: (v[i] - v[i + lag]) * (v[i] - v[i + lag]))) / (n - lag) / 2 / nullif(q / (n - 1), 0), 5) AS geary FROM k"
)
#: Published scales of residues that stand in the library; others come in as a table.
SCALES = {"consensus": EISENBERG, "mass": WEIGHTS, "binding": ENERGIES} | {n: {c: v[u] for c, v in SIDE_CHAINS.items()} for u, n in enumerate(("hydrophobicity", "hydrophilicity", "side_chain"))}
LAGS = 30
Q["autocorrelation_table"] = lambda spark, d: autocorrelations(_protein(spark, d), SCALES, LAGS)


def _standard_sql() -> str:
    rows = []
    for name, scale in SCALES.items():
        mean = sum(scale.values()) / len(scale)
        deviation = (sum((v - mean) ** 2 for v in scale.values()) / len(scale)) ** 0.5
        rows += [f"('{name}', '{c}', {(v - mean) / deviation!r}::double)" for c, v in scale.items()]
    return ", ".join(rows)


SQL["autocorrelation_table"] = (
    f"WITH {PROTEIN}, sc(scale, c, x) AS (VALUES {_standard_sql()}), p AS (SELECT seq_id, length(seq) AS n, i, substr(seq, i, 1) AS c FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM protein WHERE length(seq) > {LAGS})), "
    f"v AS (SELECT seq_id, scale, n, list(x ORDER BY i) AS v FROM p JOIN sc USING (c) GROUP BY ALL), m AS (SELECT *, list_sum(v) / n AS m FROM v), q AS (SELECT *, list_transform(v, lambda x: x - m) AS d FROM m), "
    f"e AS (SELECT *, CASE WHEN list_sum(list_transform(d, lambda x: x * x)) > 1e-12 * n THEN list_sum(list_transform(d, lambda x: x * x)) END AS s FROM q), k AS (SELECT *, unnest(range(1, {LAGS + 1}))::int AS lag FROM e) "
    "SELECT seq_id, scale, lag, round(list_sum(list_transform(range(1, n - lag + 1), lambda i: v[i] * v[i + lag])) / (n - lag), 5) AS nmbroto, "
    "round(list_sum(list_transform(range(1, n - lag + 1), lambda i: d[i] * d[i + lag])) / (n - lag) / (s / n), 5) AS moran, "
    "round(list_sum(list_transform(range(1, n - lag + 1), lambda i: (v[i] - v[i + lag]) * (v[i] - v[i + lag]))) / (2 * (n - lag)) / (s / (n - 1)), 5) AS geary FROM k"
)
Q["instability_index"] = lambda spark, d: P.instability_index(_protein(spark, d), P.pair_weights(_protein(spark, d)))
SQL["instability_index"] = (
    f"WITH {PROTEIN}, p AS (SELECT seq_id, substr(seq, i, 2) AS pair FROM (SELECT *, unnest(range(1, length(seq))) AS i FROM protein)), c AS (SELECT pair, substr(pair, 1, 1) AS a, substr(pair, 2, 1) AS b, count(*)::double AS n FROM p GROUP BY ALL), "
    "w AS (SELECT pair, round(ln(n * (sum(n) OVER ()) / ((sum(n) OVER (PARTITION BY a)) * (sum(n) OVER (PARTITION BY b)))), 6) AS weight FROM c), t AS (SELECT seq_id, sum(weight::decimal(18, 6))::double AS t FROM p JOIN w USING (pair) GROUP BY seq_id) "
    "SELECT seq_id, 10 * coalesce(t, 0) / length(seq) AS value FROM protein LEFT JOIN t USING (seq_id) WHERE length(seq) > 0"
)
_RAW = "CASE c " + " ".join(f"WHEN '{c}' THEN {v}::double" for c, v in EISENBERG.items()) + " END"
Q["hydrophobic_moment"] = lambda spark, d: P.hydrophobic_moment(_protein(spark, d), EISENBERG)
SQL["hydrophobic_moment"] = (
    f"WITH {PROTEIN}, v AS (SELECT seq_id, list_transform(string_split(seq, ''), lambda c: {_RAW}) AS v FROM protein WHERE length(seq) > 0), "
    f"t AS (SELECT seq_id, len(v) AS n, list_sum(list_transform(range(0, len(v)), lambda i: v[i + 1] * cos(i * {math.radians(100.0)!r}::double))) AS x, list_sum(list_transform(range(0, len(v)), lambda i: v[i + 1] * sin(i * {math.radians(100.0)!r}::double))) AS y FROM v) "
    "SELECT seq_id, round(sqrt(x * x + y * y) / n, 6) AS moment FROM t"
)


def _atoms(i: int, bonds: str) -> str:
    return "(" + " + ".join(f"{_n(c)} * {n[i]}" for c, n in FORMULAS.items() if n[i]) + f"{bonds})"


_A = {"C": _atoms(0, ""), "H": _atoms(1, " - 2 * (length(seq) - 1)"), "N": _atoms(2, ""), "O": _atoms(3, " - (length(seq) - 1)"), "S": _atoms(4, "")}
Q["molecular_formula"] = lambda spark, d: P.molecular_formula(_protein(spark, d))
SQL["molecular_formula"] = f"WITH {PROTEIN} SELECT seq_id, concat_ws(' ', {', '.join(f'CASE WHEN {n} > 0 THEN {chr(39)}{a}{chr(39)} || {n}::varchar END' for a, n in _A.items())}) AS formula FROM protein WHERE length(seq) > 0"
Q["isoelectric_point"] = lambda spark, d: P.isoelectric_point(_protein(spark, d))
_IONS = [c for c in (*POSITIVE_PK, *NEGATIVE_PK) if len(c) == 1]
_NET = " + ".join(f"{'1' if c == 'Nterm' else f'n_{c}'} * (pow(10::double, {pk!r}::double - mid) / (pow(10::double, {pk!r}::double - mid) + 1))" for c, pk in POSITIVE_PK.items()) + "".join(
    f" - {'1' if c == 'Cterm' else f'n_{c}'} * (pow(10::double, mid - {(AMIDE_CTERM_PK if c == 'Cterm' else pk)!r}::double) / (pow(10::double, mid - {(AMIDE_CTERM_PK if c == 'Cterm' else pk)!r}::double) + 1))" for c, pk in NEGATIVE_PK.items()
)
SQL["isoelectric_point"] = (
    f"WITH RECURSIVE {PROTEIN}, c AS (SELECT seq_id, {', '.join(f'length(seq) - length(replace(seq, {c!r}, {chr(39) * 2})) AS n_{c}' for c in _IONS)} FROM protein WHERE length(seq) > 0), "
    "b AS (SELECT seq_id, 0::double AS low, 14::double AS high, false AS done, 0 AS step FROM c UNION ALL "
    "SELECT seq_id, CASE WHEN NOT done AND q >= 0 THEN mid ELSE low END, CASE WHEN NOT done AND q <= 0 THEN mid ELSE high END, done OR q = 0 OR high - low <= 0.0001::double, step + 1 FROM "
    f"(SELECT *, round({_NET}, 3) AS q FROM (SELECT *, (low + high) / 2 AS mid FROM b JOIN c USING (seq_id) WHERE step < 20))) "
    "SELECT seq_id, round((low + high) / 2, 3) AS pi FROM b WHERE step = 20"
)

# neighbours

Q["knn_label_profile"] = lambda spark, d: N.label_profile(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), F.col("id") % 50 == 0, 10)
SQL["knn_label_profile"] = (
    "WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))), 9) AS d "
    "FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM p) SELECT id, label, count(*)::bigint AS n FROM r WHERE k <= 10 GROUP BY id, label"
)
Q["smote"] = lambda spark, d: N.smote(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), 5, 63)
