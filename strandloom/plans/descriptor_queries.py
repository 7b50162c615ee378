"""Queries over further descriptors, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.residues import CODING_CONTENT, CODING_POSITION, DINUCLEOTIDES, EISENBERG, SIDE_CHAINS, standardised
from strandloom.operators import correlations as C
from strandloom.operators import descriptors as D
from strandloom.operators.arrays import sliding_summary
from strandloom.operators.kmers import FIVE_GROUPS, SEVEN_GROUPS, grouped
from strandloom.operators.sequences import AMINO_ACIDS, NUCLEOTIDES, sequence_table
from strandloom.plans.sequence_queries import DNA, PROTEIN, _counts, _grouped

Q: dict = {}
SQL: dict[str, str] = {}
_SIDES = standardised(SIDE_CHAINS)
_LAGS = 5


def _dna(spark, d):
    return sequence_table(spark, d, "dna")


def _protein(spark, d):
    return sequence_table(spark, d, "protein")


Q["zero_filled_dnc"] = lambda spark, d: D.zero_filled(_dna(spark, d), 2, NUCLEOTIDES)
SQL["zero_filled_dnc"] = (
    f"{_counts(DNA, 'dna', 2)}, b AS (SELECT unnest(string_split('ACGT', '')) AS b), a AS (SELECT x.b || y.b AS kmer FROM b x, b y) "
    "SELECT seq_id, kmer, coalesce(cnt, 0)::bigint AS cnt, (length(seq) - 1)::bigint AS total FROM (SELECT * FROM dna, a WHERE length(seq) >= 2) LEFT JOIN c USING (seq_id, kmer)"
)
Q["kstep_composition"] = lambda spark, d: D.stepped_composition(_dna(spark, d), 30, 20, 3)
SQL["kstep_composition"] = (
    f"WITH {DNA}, s AS (SELECT seq_id, substr(seq, i, 30) AS part FROM (SELECT *, unnest(range(1, 2 + 20 * ceil(greatest(length(seq) - 49, 0) / 20.0)::bigint, 20)) AS i FROM dna WHERE length(seq) > 0)), "
    "w AS (SELECT seq_id, k, substr(part, i, k) AS kmer FROM (SELECT *, unnest(range(1, length(part) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM s))) "
    "SELECT seq_id, k, kmer, count(*)::bigint AS cnt, (sum(count(*)) OVER (PARTITION BY seq_id, k))::bigint AS total FROM w GROUP BY seq_id, k, kmer"
)
_SLIDING = (
    ", p AS (SELECT seq_id, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS residue FROM {0} WHERE length(seq) >= 5), "
    "w AS (SELECT seq_id, n, residue, unnest(range(greatest(1, i - 4), least(i, n - 4) + 1)) AS start FROM p), c AS (SELECT seq_id, start, residue, count(*) AS c FROM w GROUP BY ALL) "
    "SELECT seq_id, residue, count(*)::bigint AS n_windows, max(c) / 5.0::double AS largest, round(sum(c) / 5.0::double, 6) AS total FROM c GROUP BY seq_id, residue"
)


def _sliding(s):
    """Where each residue's share of the windows of five is largest, in how many windows it occurs, and the sum of its shares."""
    return sliding_summary(s, 5).groupBy("seq_id", "residue").agg(F.sum("n_windows").alias("n_windows"), F.max("largest").alias("largest"), F.round(F.sum("total"), 6).alias("total"))


Q["windowed_composition"] = lambda spark, d: _sliding(_protein(spark, d))
SQL["windowed_composition"] = f"WITH {PROTEIN}{_SLIDING.format('protein')}"
Q["windowed_groups"] = lambda spark, d: _sliding(grouped(_protein(spark, d), FIVE_GROUPS))
SQL["windowed_groups"] = f"WITH {_grouped(FIVE_GROUPS)}{_SLIDING.format('g')}"
Q["ksctriad"] = lambda spark, d: D.spaced_triads(_protein(spark, d), range(0, 3))
SQL["ksctriad"] = " UNION ALL ".join(
    f"SELECT * FROM ({_counts(_grouped(SEVEN_GROUPS), 'g', 3, pattern=f'substr(seq, i, 1) || substr(seq, i + {g + 1}, 1) || substr(seq, i + {2 * g + 2}, 1)', width=2 * g + 3)} "
    f"SELECT seq_id, {g} AS gap, kmer AS triad, round((cnt - CASE WHEN count(*) OVER s = 343 THEN min(cnt) OVER s ELSE 0 END) / (max(cnt) OVER s)::double, 9) AS score FROM c WINDOW s AS (PARTITION BY seq_id))"
    for g in range(3)
)


def _n(c: str, text: str) -> str:
    return f"(length({text}) - length(replace({text}, '{c}', '')))"


def _steps(value: str, table: tuple, steps: list[float]) -> str:
    whens = " ".join(f"WHEN {value} >= {s!r}::double THEN {t!r}::double" for s, t in zip(steps[:-1], table, strict=False))
    return f"(CASE {whens} ELSE {table[len(steps) - 1]!r}::double END)"


def _coding() -> str:
    terms = []
    for b in NUCLEOTIDES:
        counts = ", ".join(_n(b, f"p{i}") for i in range(3))
        table, weight = CODING_POSITION["table"][b]
        terms.append(f"{_steps(f'(greatest({counts}) / (least({counts}) + 1)::double)', table, CODING_POSITION['steps'])} * {weight!r}::double")
        table, weight = CODING_CONTENT["table"][b]
        terms.append(f"{_steps(f'({_n(b, "seq")} / length(seq)::double)', table, CODING_CONTENT['steps'])} * {weight!r}::double")
    return " + ".join(terms)


Q["fickett"] = lambda spark, d: D.coding_score(_dna(spark, d))
SQL["fickett"] = f"WITH {DNA}, p AS (SELECT *, {', '.join(f'''regexp_replace(substr(seq, {i + 1}), '(.).?.?', '\\1', 'g') AS p{i}''' for i in range(3))} FROM dna WHERE length(seq) > 0) SELECT seq_id, round({_coding()}, 6) AS score FROM p"


def _case(table: dict, u: int, name: str = "c") -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v[u]!r}::double" for k, v in table.items()) + " END"


_SIDE_LISTS = f"{PROTEIN}, v AS (SELECT seq_id, seq, length(seq) AS n, " + ", ".join(f"list_transform(string_split(seq, ''), lambda c: {_case(_SIDES, u)}) AS v{u}" for u in range(3)) + f" FROM protein WHERE length(seq) > {_LAGS}), k AS (SELECT *, unnest(range(1, {_LAGS + 1})) AS lag FROM v)"
_RESIDUES = "[" + ", ".join(f"{{'f': '{a}', 'v': {_n(a, 'seq')}::double}}" for a in AMINO_ACIDS) + "]"
_WEIGHTED = f"z AS (SELECT seq_id, 1 + {{w}}::double * sum(theta) AS z FROM t GROUP BY seq_id), r AS (SELECT seq_id, unnest({_RESIDUES}) AS x FROM protein), f AS (SELECT seq_id, x.f AS feature, x.v AS value FROM r UNION ALL SELECT seq_id, feature, {{w}}::double * theta FROM t) SELECT seq_id, feature, round(value / z, 6) AS value FROM f JOIN z USING (seq_id)"
Q["paac"] = lambda spark, d: D.residue_pseudo_composition(_protein(spark, d), _SIDES, _LAGS, 0.05)
_SQUARES = " + ".join(f"list_sum(list_transform(range(1, n - lag + 1), lambda i: (v{u}[i] - v{u}[i + lag]) * (v{u}[i] - v{u}[i + lag])))" for u in range(3))
SQL["paac"] = f"WITH {_SIDE_LISTS}, t AS (SELECT seq_id, 'theta' || lag::varchar AS feature, ({_SQUARES}) / 3 / (n - lag) AS theta FROM k), {_WEIGHTED.replace("{w}", "0.05")}"
_TWO = {a: v[:2] for a, v in _SIDES.items()}
Q["apaac"] = lambda spark, d: D.amphiphilic_pseudo_composition(_protein(spark, d), _TWO, _LAGS, 0.05)
_PRODUCTS = " UNION ALL ".join(f"SELECT seq_id, 'theta' || lag::varchar || '_{u}' AS feature, list_sum(list_transform(range(1, n - lag + 1), lambda i: v{u}[i] * v{u}[i + lag])) / (n - lag) AS theta FROM k" for u in range(2))
SQL["apaac"] = f"WITH {_SIDE_LISTS}, t AS ({_PRODUCTS}), {_WEIGHTED.replace("{w}", "0.05")}"


def _distances(spark):
    """Distances of residues from one scale; any other table of (a, b, d) serves as well."""
    return spark.createDataFrame([(a, b, abs(x - y)) for a, x in EISENBERG.items() for b, y in EISENBERG.items()], "a string, b string, d double")


_PAIR = f"abs({_case({k: (v,) for k, v in EISENBERG.items()}, 0, 'substr(seq, i, 1)')} - {_case({k: (v,) for k, v in EISENBERG.items()}, 0, 'substr(seq, i + lag, 1)')})"
_TAU = f"{PROTEIN}, l AS (SELECT *, unnest(range(1, {_LAGS + 1})) AS lag FROM protein WHERE length(seq) > {{least}}), i AS (SELECT *, unnest(range(1, length(seq) - lag + 1)) AS i FROM l WHERE length(seq) > lag), e AS (SELECT seq_id, lag, {_PAIR} AS d FROM i)"
Q["soc_number"] = lambda spark, d: D.coupling_numbers(_protein(spark, d), _distances(spark), _LAGS).select("seq_id", "lag", F.round("tau", 9).alias("tau"))
SQL["soc_number"] = f"WITH {_TAU.format(least=1)} SELECT seq_id, lag::int AS lag, round(sum(d * d) / count(*), 9) AS tau FROM e GROUP BY ALL"
Q["qs_order"] = lambda spark, d: D.sequence_order(_protein(spark, d), _distances(spark), _LAGS, 0.1)
SQL["qs_order"] = f"WITH {_TAU.format(least=_LAGS)}, t AS (SELECT seq_id, 'tau' || lag::varchar AS feature, sum(d * d) AS theta FROM e GROUP BY seq_id, lag), {_WEIGHTED.replace("{w}", "0.1")}"
_CROSS = [(lag, u, v) for lag in (1, 2) for u in range(6) for v in range(6) if u != v]
Q["dcc"] = lambda spark, d: C.cross_covariance(_dna(spark, d), DINUCLEOTIDES, 2, 2)
_ONE = "SELECT seq_id, {lag}::int AS lag, {u}::int AS prop, {v}::int AS other, round((list_sum(list_transform(range(1, n - {lag}), lambda i: p{u}[i] * p{v}[i + {lag}])) - ma * list_sum(p{v}[{lag} + 1:]) - mb * ma * n + ma * mb * (n - 1 - {lag})) / (n - 1 - {lag}), 9) AS value FROM (SELECT *, list_sum(p{u}[1:n - 1 - {lag}]) / n AS ma, list_sum(p{v}[1:n - 1 - {lag}]) / n AS mb FROM p)"
SQL["dcc"] = (
    f"WITH {DNA}, w AS (SELECT seq_id, length(seq) AS n, list_transform(range(1, length(seq)), lambda i: substr(seq, i, 2)) AS w FROM dna WHERE length(seq) > 3), "
    f"p AS (SELECT seq_id, n, {', '.join(f'list_transform(w, lambda c: {_case(DINUCLEOTIDES, u)}) AS p{u}' for u in range(6))} FROM w) " + " UNION ALL ".join(_ONE.format(lag=lag, u=u, v=v) for lag, u, v in _CROSS)
)


def _annotated(spark, d):
    """Proteins beside a track of their residues' groups, and a peptide of each: ten residues from the place that its id gives."""
    p = _protein(spark, d).where("length(seq) >= 30")
    track = p.select("seq_id", "seq", F.translate("seq", "".join(SEVEN_GROUPS.values()), "".join(k * len(v) for k, v in SEVEN_GROUPS.items())).alias("track"))
    return p.select("seq_id", F.substr("seq", (F.col("seq_id") % 20 + 1).cast("int"), F.lit(10)).alias("peptide")), track


Q["profile_slice"] = lambda spark, d: D.find_slices(*_annotated(spark, d))
SQL["profile_slice"] = (
    f"WITH {PROTEIN}, p AS (SELECT seq_id, seq, substr(seq, seq_id % 20 + 1, 10) AS peptide, translate(seq, '{''.join(SEVEN_GROUPS.values())}', '{''.join(k * len(v) for k, v in SEVEN_GROUPS.items())}') AS track FROM protein WHERE length(seq) >= 30) "
    "SELECT seq_id, peptide, instr(seq, peptide)::int AS start, substr(track, instr(seq, peptide), 10) AS slice FROM p"
)
