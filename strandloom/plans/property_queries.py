"""Queries over properties and signals of sequences, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.residues import AMIDE_CTERM_PK, EISENBERG, ENERGIES, NEGATIVE_PK, NUCLEOTIDE_MAPS, POSITIVE_PK, PROPERTY_GROUPS, SIDE_CHAINS, WEIGHTS
from strandloom.operators import peptides as P
from strandloom.operators import signals as S
from strandloom.operators.arrays import helical_arcs, scale_correlations, scale_windows
from strandloom.operators.sequences import sequence_table
from strandloom.plans.sequence_queries import DNA, PROTEIN

Q: dict = {}
SQL: dict[str, str] = {}


def _dna(spark, d):
    return sequence_table(spark, d, "dna")


def _protein(spark, d):
    return sequence_table(spark, d, "protein")


def _n(c: str) -> str:
    return f"(length(seq) - length(replace(seq, '{c}', '')))"


def _sum(table: dict[str, float]) -> str:
    return "(" + " + ".join(f"{_n(c)} * {w}::double" for c, w in table.items()) + ")"


def _charge(ph: float) -> str:
    terms = [f"{'1' if c == 'Nterm' else _n(c)} * {(x := 10 ** (pk - ph)) / (x + 1)!r}::double" for c, pk in POSITIVE_PK.items()]
    terms += [f"{'-1' if c == 'Cterm' else '-' + _n(c)} * {(x := 10 ** (ph - (AMIDE_CTERM_PK if c == 'Cterm' else pk))) / (x + 1)!r}::double" for c, pk in NEGATIVE_PK.items()]
    return "round(" + " + ".join(terms) + ", 3)"


_MW = f"round({_sum(WEIGHTS)} - 18.015::double * (length(seq) - 1) - 0.98::double, 3)"
_L = "FROM protein WHERE length(seq) > 0"
Q["global_mw"] = lambda spark, d: P.global_properties(_protein(spark, d)).where("len > 0").select("seq_id", "len", "mw")
SQL["global_mw"] = f"WITH {PROTEIN} SELECT seq_id, length(seq)::int AS len, {_MW} AS mw {_L}"
Q["global_charge"] = lambda spark, d: P.global_properties(_protein(spark, d)).where("len > 0").select("seq_id", "charge")
SQL["global_charge"] = f"WITH {PROTEIN} SELECT seq_id, {_charge(7.4)} AS charge {_L}"
Q["charge_density"] = lambda spark, d: P.global_properties(_protein(spark, d)).where("len > 0").select("seq_id", F.round(F.col("charge") * 1000 / F.col("mw"), 6).alias("charge_per_kda"))
SQL["charge_density"] = f"WITH {PROTEIN} SELECT seq_id, round({_charge(7.4)} * 1000 / {_MW}, 6) AS charge_per_kda {_L}"
for _name, _sql in (
    ("aromaticity", f"({_n('F')} + {_n('W')} + {_n('Y')}) / length(seq)::double"),
    ("aliphatic_index", f"100 * ({_n('A')} + 2.9::double * {_n('V')} + 3.9::double * ({_n('I')} + {_n('L')})) / length(seq)"),
    ("boman_index", f"{_sum(ENERGIES)} / length(seq)"),
    ("hydrophobic_ratio", "(" + " + ".join(_n(c) for c in "ACFILMV") + ") / length(seq)::double"),
):
    Q[_name] = lambda spark, d, n=_name: P.global_properties(_protein(spark, d)).where("len > 0").select("seq_id", n)
    SQL[_name] = f"WITH {PROTEIN} SELECT seq_id, round({_sql}, 6) AS {_name} {_L}"
Q["scale_global"] = lambda spark, d: P.scale_mean(_protein(spark, d), EISENBERG)
SQL["scale_global"] = f"WITH {PROTEIN} SELECT seq_id, round({_sum(EISENBERG)} / length(seq), 6) AS value {_L}"
_SCALE = "CASE c " + " ".join(f"WHEN '{c}' THEN {v}::double" for c, v in EISENBERG.items()) + " END"
Q["scale_autocorr"] = lambda spark, d: P.scale_autocorrelation(_protein(spark, d), EISENBERG, 7)
SQL["scale_autocorr"] = (
    f"WITH {PROTEIN}, v AS (SELECT seq_id, list_transform(string_split(seq, ''), lambda c: {_SCALE}) AS v FROM protein WHERE length(seq) > 7), k AS (SELECT seq_id, v, unnest(range(0, 7)) AS lag FROM v) "
    "SELECT seq_id, lag::int AS lag, round(list_sum(list_transform(range(1, len(v) - lag + 1), lambda i: v[i] * v[i + lag])) / (len(v) - lag), 6) AS value FROM k"
)


def _classed(groups) -> str:
    return f"{PROTEIN}, g AS (SELECT seq_id, translate(seq, '{''.join(groups)}', '{''.join(str(i + 1) * len(x) for i, x in enumerate(groups))}') AS seq FROM protein)"


def _each(select: str) -> str:
    """The same query for every property."""
    parts = [f"SELECT * FROM (WITH {_classed(g)} {select.replace('{name}', name)})" for name, g in PROPERTY_GROUPS.items()]
    return " UNION ALL ".join(parts)


Q["ctdc"] = lambda spark, d: P.class_composition(_protein(spark, d), PROPERTY_GROUPS)
SQL["ctdc"] = _each(" UNION ALL ".join(f"SELECT seq_id, '{{name}}' AS property, {i} AS grp, round({_n(str(i))} / length(seq)::double, 9) AS share FROM g WHERE length(seq) > 0" for i in (1, 2, 3)))
Q["ctdt"] = lambda spark, d: P.class_transition(_protein(spark, d), PROPERTY_GROUPS)
SQL["ctdt"] = _each(
    ", p AS (SELECT seq_id, least(a, b) || greatest(a, b) AS pair, count(*) AS c FROM (SELECT seq_id, substr(seq, i, 1) AS a, substr(seq, i + 1, 1) AS b FROM (SELECT *, unnest(range(1, length(seq))) AS i FROM g)) GROUP BY ALL), "
    "k AS (SELECT seq_id, length(seq) - 1 AS n, unnest(['12', '13', '23']) AS pair FROM g WHERE length(seq) > 1) SELECT seq_id, '{name}' AS property, pair, round(coalesce(c, 0) / n::double, 9) AS share FROM k LEFT JOIN p USING (seq_id, pair)"
)
Q["ctdd"] = lambda spark, d: P.class_distribution(_protein(spark, d), PROPERTY_GROUPS)
SQL["ctdd"] = _each(
    ", p AS (SELECT seq_id, i, substr(seq, i, 1)::int AS grp FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM g WHERE length(seq) > 0)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY seq_id, grp ORDER BY i) AS k, count(*) OVER (PARTITION BY seq_id, grp) AS n FROM p), "
    "w AS (SELECT seq_id, len, grp, unnest([0, 25, 50, 75, 100])::int AS q FROM (SELECT seq_id, length(seq) AS len, unnest([1, 2, 3])::int AS grp FROM g WHERE length(seq) > 0)), "
    "f AS (SELECT seq_id, grp, q, i FROM k, (SELECT unnest([0, 25, 50, 75, 100])::int AS q) WHERE k = greatest(1, q * n // 100)) "
    "SELECT seq_id, '{name}' AS property, grp, q, round(100::double * coalesce(i, 0) / len, 6) AS place FROM w LEFT JOIN f USING (seq_id, grp, q)"
)

for _name, _values in NUCLEOTIDE_MAPS.items():
    Q[f"map_{_name}"] = lambda spark, d, v=_values: S.signal_table(_dna(spark, d), v)
    SQL[f"map_{_name}"] = (
        f"WITH {DNA} SELECT seq_id, length(seq)::int AS n, round({_sum(_values)}, 4) AS total, round({_sum({c: x * x for c, x in _values.items()})}, 4) AS energy FROM dna WHERE length(seq) > 0"
    )
Q["zcurve"] = lambda spark, d: S.z_curve(_dna(spark, d))
SQL["zcurve"] = f"WITH {DNA} SELECT seq_id, ({_n('A')} + {_n('G')} - {_n('C')} - {_n('T')})::int AS x, ({_n('A')} + {_n('C')} - {_n('G')} - {_n('T')})::int AS y, ({_n('A')} + {_n('T')} - {_n('C')} - {_n('G')})::int AS z FROM dna"
Q["chaos_game"] = lambda spark, d: S.chaos_game(_dna(spark, d))
_CORNER = "sum((CASE WHEN {0} THEN 1 ELSE -1 END) * pow(0.5::double, length(seq) - i + 1))"
SQL["chaos_game"] = (
    f"WITH {DNA}, p AS (SELECT seq_id, seq, i, substr(seq, i, 1) AS c FROM (SELECT *, unnest(range(greatest(1, length(seq) - 60), length(seq) + 1)) AS i FROM dna WHERE length(seq) > 0)) "
    f"SELECT seq_id, round({_CORNER.format(chr(40) + 'c IN (' + repr('A') + ', ' + repr('G') + '))')}, 6) AS x, round({_CORNER.format('c IN (' + repr('A') + ', ' + repr('T') + ')')}, 6) AS y FROM p GROUP BY seq_id"
)
for _name, _values in NUCLEOTIDE_MAPS.items():
    Q[f"fourier_{_name}"] = lambda spark, d, v=_values: S.spectrum_summary(_dna(spark, d), S.numbers(v))
Q["fourier_binary"] = lambda spark, d: S.spectrum_summary(_dna(spark, d), S.BINARY)
Q["fourier_zcurve"] = lambda spark, d: S.spectrum_summary(_dna(spark, d), S.CURVES, "running")
Q["fourier_complex"] = lambda spark, d: S.spectrum_summary(_dna(spark, d), S.PLANE, complex_plane=True)
Q["fourier_protein"] = lambda spark, d: S.spectrum_summary(_protein(spark, d), S.numbers(EISENBERG))
_POSITIONS = f"WITH {DNA}, p AS (SELECT seq_id, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS c FROM dna WHERE length(seq) > 0)"
_SUMS = "SELECT channel, pos::int AS pos, round(sum(v), 6) AS total, count(*)::bigint AS n FROM v GROUP BY channel, pos"


def _channels_sql(channels: S.Channels, value: str) -> str:
    """A row for each channel and position; {c} is the character's number."""
    each = []
    for name, (values, other) in channels.items():
        number = "CASE c " + " ".join(f"WHEN '{k}' THEN {x}::double" for k, x in values.items()) + f" ELSE {other}::double END"
        each.append(f"SELECT '{name}' AS channel, seq_id, pos, {value.format(c=f'({number})')} AS v FROM p")
    return f"{_POSITIONS}, v AS ({' UNION ALL '.join(each)})"


for _name, _channels, _rule, _value in (
    ("signal_binary", S.BINARY, "plain", "{c}"),
    ("signal_eiip", S.numbers(NUCLEOTIDE_MAPS["eiip"]), "plain", "{c}"),
    ("signal_complex", S.PLANE, "plain", "{c}"),
    ("signal_zcurve", S.CURVES, "running", "sum({c}) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"),
    ("signal_chaos", S.CORNERS, "halved", "list_reduce([0::double] || list({c}) OVER (PARTITION BY seq_id ORDER BY pos ROWS 59 PRECEDING), lambda a, x: (a + x) / 2)"),
):
    Q[_name] = lambda spark, d, c=_channels, r=_rule: S.position_sums(S.signals(_dna(spark, d), c, r))
    SQL[_name] = f"{_channels_sql(_channels, _value)} {_SUMS}"
Q["property_groups"] = lambda spark, d: P.classed(_protein(spark, d), PROPERTY_GROUPS["charge"]).select("seq_id", P.residue("1").alias("positive"), P.residue("3").alias("negative"))
SQL["property_groups"] = f"WITH {_classed(PROPERTY_GROUPS['charge'])} SELECT seq_id, {_n('1')}::int AS positive, {_n('3')}::int AS negative FROM g"

_V = (
    f"WITH {PROTEIN}, c AS (SELECT seq_id, length(seq) AS n, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM protein WHERE length(seq) > 0), v AS (SELECT seq_id, n, i, {_SCALE} AS v FROM c), "
    "x AS (SELECT seq_id, i + 1 - least({0}, n) AS start, {1} AS x FROM v WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN {2} PRECEDING AND CURRENT ROW) QUALIFY i + 1 >= least({0}, n))"
)
_MEAN = "sum(v) OVER w / least({0}, n)"
_TURNED = "sqrt(pow(sum(v * cos(radians(100.0::double) * i)) OVER w, 2) + pow(sum(v * sin(radians(100.0::double) * i)) OVER w, 2)) / least({0}, n)"
_WINDOWS = "SELECT seq_id, count(*)::bigint AS n_windows, round(max(x), 6) AS largest, round(avg(x), 6) AS mean FROM x GROUP BY seq_id"


def _scale_windows(s, width, degrees=None):
    return scale_windows(s, EISENBERG, width, degrees).select("seq_id", "n_windows", F.round("largest", 6).alias("largest"), F.round("mean", 6).alias("mean"))


Q["windowed_mean"] = lambda spark, d: _scale_windows(_protein(spark, d), 11)
SQL["windowed_mean"] = f"{_V.format(11, _MEAN.format(11), 10)} {_WINDOWS}"
Q["hydrophobic_moment_windows"] = lambda spark, d: _scale_windows(_protein(spark, d), 11, 100.0)
SQL["hydrophobic_moment_windows"] = f"{_V.format(11, _TURNED.format(11), 10)} {_WINDOWS}"
Q["scale_profile"] = lambda spark, d: scale_windows(_protein(spark, d), EISENBERG, 19).select("seq_id", F.posexplode("every").alias("start", "value")).groupBy("start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("largest"))
SQL["scale_profile"] = f"{_V.format(19, _MEAN.format(19), 18)} SELECT start::int AS start, count(*)::bigint AS n, round(sum(x), 6) AS total, round(max(x), 6) AS largest FROM x GROUP BY start"
Q["helical_arc"] = lambda spark, d: helical_arcs(_protein(spark, d), {"hydrophobic": "ACFGILMVWY", "polar": "DEHKNQRST"}).select("seq_id", "feature", "largest", F.round("mean", 6).alias("mean"))
_SCALES = {"eisenberg": EISENBERG, "hydrophilicity": {c: v[1] for c, v in SIDE_CHAINS.items()}, "mass": {c: v[2] / 100 for c, v in SIDE_CHAINS.items()}}
_OF = lambda table: "CASE c " + " ".join(f"WHEN '{c}' THEN {v!r}::double" for c, v in table.items()) + " END"
Q["scale_crosscorr"] = lambda spark, d: scale_correlations(_protein(spark, d), _SCALES, 7).select("seq_id", "lag", "scale", "other", F.round("value", 9).alias("value"))
_LEADS = ", ".join(f"lead({{0}}, {lag}) OVER o AS l{lag}" for lag in range(7))
SQL["scale_crosscorr"] = f"WITH {PROTEIN}, c AS (SELECT seq_id, length(seq) AS n, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM protein WHERE length(seq) > 7) " + " UNION ALL ".join(
    f"SELECT seq_id, lag::int AS lag, '{a}' AS scale, '{b}' AS other, round(sum(x * y) / (min(n) - lag), 9) AS value FROM (SELECT seq_id, n, x, unnest(range(7)) AS lag, unnest([l0, l1, l2, l3, l4, l5, l6]) AS y FROM "
    f"(SELECT seq_id, n, {_OF(_SCALES[a])} AS x, {_LEADS.format(_OF(_SCALES[b]))} FROM c WINDOW o AS (PARTITION BY seq_id ORDER BY i))) GROUP BY seq_id, lag"
    for a, b in (("eisenberg", "hydrophilicity"), ("eisenberg", "mass"), ("hydrophilicity", "mass"))
)
