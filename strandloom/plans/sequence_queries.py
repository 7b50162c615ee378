"""Queries over sequences and k-mers, each with the SQL that another engine can run on the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import kmers as K
from strandloom.operators import tables as T
from strandloom.operators.sequences import AMINO_ACIDS, alphabet_violations, clean_protein, dedupe_sequences, folds, letters, md5_key, ranked, read, sequence_table, split_tag

DNA = "dna AS (SELECT doc_id AS seq_id, lang AS label, replace(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ATGCU]', '', 'g'), 'U', 'T') AS seq FROM documents)"
PROTEIN = f"protein AS (SELECT doc_id AS seq_id, lang AS label, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{AMINO_ACIDS}]', '', 'g') AS seq FROM documents)"
RAW = "raw AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"


def _windows(source: str, k: int, pattern: str | None = None, width: int | None = None, step: int = 1) -> str:
    """SQL of the exploded windows: w(seq_id, label, kmer)."""
    width = width or k
    take = pattern or f"substr(seq, i, {k})"
    return f"w AS (SELECT seq_id, label, {take} AS kmer FROM (SELECT seq_id, label, seq, unnest(range(1, length(seq) - {width} + 2, {step})) AS i FROM {source} WHERE length(seq) >= {width}))"


def _counts(cte: str, source: str, k: int, **kw) -> str:
    return f"WITH {cte}, {_windows(source, k, **kw)}, c AS (SELECT seq_id, kmer, count(*)::bigint AS cnt FROM w GROUP BY seq_id, kmer)"


def _composition(cte: str, source: str, k: int, name: str = "kmer", **kw) -> str:
    return f"{_counts(cte, source, k, **kw)} SELECT seq_id, kmer AS {name}, round(cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM c"


def _grouped(groups: dict[str, str]) -> str:
    return f"{PROTEIN}, g AS (SELECT seq_id, label, translate(seq, '{''.join(groups.values())}', '{''.join(k * len(v) for k, v in groups.items())}') AS seq FROM protein)"


def _upto(cte: str, source: str, ks, body: str) -> str:
    parts = []
    for k in ks:
        parts.append(f"SELECT * FROM ({_counts(cte, source, k)} {body.replace('{k}', str(k))})")
    return " UNION ALL ".join(parts)


def _dna(spark, d):
    return sequence_table(spark, d, "dna")


def _protein(spark, d):
    return sequence_table(spark, d, "protein")


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# cleaning, validation and filters


@query("clean_dna", f"WITH {DNA} SELECT seq_id, label, seq, length(seq)::int AS len FROM dna")
def _(spark, d):
    return _dna(spark, d).withColumn("len", F.length("seq"))


@query("clean_protein", f"WITH {PROTEIN} SELECT seq_id, label, seq, length(seq)::int AS len FROM protein")
def _(spark, d):
    return _protein(spark, d).withColumn("len", F.length("seq"))


@query("gap_normalize", f"WITH {RAW} SELECT seq_id, regexp_replace(seq, '[^{AMINO_ACIDS}]', '-', 'g') AS gapped, length(regexp_replace(seq, '[^{AMINO_ACIDS}]', '', 'g'))::int AS residues FROM raw")
def _(spark, d):
    gapped = F.regexp_replace(letters(F.col("text")), f"[^{AMINO_ACIDS}]", "-")
    return read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), gapped.alias("gapped")).withColumn("residues", F.length(F.replace("gapped", F.lit("-"), F.lit(""))))


@query("rename_records", "SELECT doc_id, concat_ws('_', 'pre', (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::varchar, 'train', doc_id::varchar) AS record_name FROM documents")
def _(spark, d):
    i = F.col("rank") - 1
    return ranked(read(spark, d, "documents").select("doc_id", "source"), "doc_id", "doc_id", "source").select("doc_id", F.concat_ws("_", F.lit("pre"), i.cast("string"), F.lit("train"), F.col("doc_id").cast("string")).alias("record_name"))


@query("alphabet_violations", f"WITH {RAW} SELECT seq_id, regexp_extract(seq, '([^ACGT])', 1) AS bad_char FROM raw WHERE regexp_extract(seq, '([^ACGT])', 1) <> ''")
def _(spark, d):
    s = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), letters(F.col("text")).alias("seq"))
    return alphabet_violations(s, "ACGT")


@query("record_validation", "SELECT doc_id, text IS NULL OR length(text) = 0 AS is_empty, coalesce(contains(text, '>'), false) AS has_mark FROM documents")
def _(spark, d):
    empty = F.col("text").isNull() | (F.length("text") == 0)
    return read(spark, d, "documents").select("doc_id", empty.alias("is_empty"), F.coalesce(F.contains("text", F.lit(">")), F.lit(False)).alias("has_mark"))


@query("length_guard", f"WITH {DNA} SELECT min(length(seq))::int AS min_len, max(length(seq))::int AS max_len, count(DISTINCT length(seq)) = 1 AS equal_len FROM dna")
def _(spark, d):
    n = F.length("seq")
    return _dna(spark, d).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), (F.min(n) == F.max(n)).alias("equal_len"))


@query("keep_natural", f"WITH {RAW} SELECT seq_id FROM raw WHERE regexp_full_match(seq, '[{AMINO_ACIDS}]*')")
def _(spark, d):
    return read(spark, d, "documents").where(letters(F.col("text")).rlike(f"^[{AMINO_ACIDS}]*$")).select(F.col("doc_id").alias("seq_id"))


@query("filter_residues", f"WITH {PROTEIN} SELECT seq_id FROM protein WHERE NOT regexp_matches(seq, '[CW]')")
def _(spark, d):
    return _protein(spark, d).where(~F.col("seq").rlike("[CW]")).select("seq_id")


@query("filter_sequences", "SELECT doc_id AS seq_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    listed = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return read(spark, d, "documents").join(listed, "doc_id", "left_anti").select(F.col("doc_id").alias("seq_id"))


@query("filter_values", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0 AND embedding[2] <= 0.1::float AND embedding[3] >= -0.2::float")
def _(spark, d):
    e = F.col("embedding")
    tests = [e[0] > 0, e[1] <= F.lit(0.1).cast("float"), e[2] >= F.lit(-0.2).cast("float")]
    out = read(spark, d, "embeddings")
    for t in tests:
        out = out.where(t)
    return out.select("vec_id")


@query("nonfinite_to_null", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def _(spark, d):
    # a division by 0 is infinite, of 0 by 0 not a number
    ratio = F.when(F.col("l_discount") == 0, F.col("l_tax") * float("inf")).otherwise(F.try_divide("l_tax", "l_discount"))
    return T.finite(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(ratio, 6).alias("ratio")), "ratio")


@query("dedupe_sequences", f"WITH {DNA} SELECT min(seq_id) AS seq_id, count(*)::bigint AS copies, length(seq)::int AS len FROM dna GROUP BY seq")
def _(spark, d):
    return dedupe_sequences(_dna(spark, d))


_SPLIT = "CASE WHEN substr(md5('7:' || doc_id::varchar), 1, 1) < '4' THEN 'test' ELSE 'train' END"


@query("split_tag", f"SELECT doc_id AS seq_id, {_SPLIT} AS split FROM documents")
def _(spark, d):
    s = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"))
    return split_tag(s, s.where(F.substring(md5_key(7, "seq_id"), 1, 1) < "4"))


@query("split_counts", f"SELECT {_SPLIT} AS split, lang AS label, count(*)::bigint AS n FROM documents GROUP BY ALL")
def _(spark, d):
    split = F.when(F.substring(md5_key(7, "doc_id"), 1, 1) < "4", "test").otherwise("train")
    return read(spark, d, "documents").groupBy(split.alias("split"), F.col("lang").alias("label")).agg(F.count("*").alias("n"))


@query("label_counts", "SELECT lang AS label, count(*)::bigint AS n FROM documents GROUP BY lang")
def _(spark, d):
    return read(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))


@query("imbalance_check", "SELECT min(n)::bigint AS smallest, max(n)::bigint AS largest, min(n) = max(n) AS balanced FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def _(spark, d):
    n = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.min("n") == F.max("n")).alias("balanced"))


@query(
    "seq_summary_stats",
    f"""WITH {DNA}, l AS (SELECT label, length(seq) AS n, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc FROM dna),
h AS (SELECT label, n, count(*) AS c FROM l GROUP BY label, n),
r AS (SELECT label, n, sum(n * c) OVER (PARTITION BY label ORDER BY n DESC) AS run, sum(n * c) OVER (PARTITION BY label) AS total FROM h),
m AS (SELECT label, max(n)::int AS n50 FROM r WHERE 2 * run >= total GROUP BY label)
SELECT label, count(*)::bigint AS n, min(l.n)::int AS min_len, max(l.n)::int AS max_len, round(avg(l.n), 6) AS mean_len, round(stddev_pop(l.n), 6) AS std_len, sum(l.n)::bigint AS total_len,
round(quantile_cont(l.n, 0.25), 6)::double AS q1, round(quantile_cont(l.n, 0.5), 6)::double AS q2, round(quantile_cont(l.n, 0.75), 6)::double AS q3, any_value(m.n50) AS n50, round(avg(CASE WHEN l.n > 0 THEN 100.0::double * gc / l.n END), 6) AS mean_gc
FROM l JOIN m USING (label) GROUP BY label""",
)
def _(spark, d):
    s = _dna(spark, d).select("label", F.length("seq").alias("n"), (F.length("seq") - F.length(F.translate("seq", "GC", ""))).alias("gc"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = s.groupBy("label").agg(
        F.count("*").alias("n"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.round(F.avg("n"), 6).alias("mean_len"), F.round(F.stddev_pop("n"), 6).alias("std_len"), F.sum("n").alias("total_len"),
        q.alias("q"), F.round(F.avg(F.when(F.col("n") > 0, 100.0 * F.col("gc") / F.col("n"))), 6).alias("mean_gc"),
    )
    # the running sum goes over distinct lengths, not over sequences
    h = s.groupBy("label", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("label")
    run = h.select("label", "n", F.sum(F.col("n") * F.col("c")).over(w.orderBy(F.desc("n"))).alias("run"), F.sum(F.col("n") * F.col("c")).over(w).alias("total"))
    n50 = run.where(2 * F.col("run") >= F.col("total")).groupBy("label").agg(F.max("n").alias("n50"))
    return stats.join(n50, "label").select("label", "n", "min_len", "max_len", "mean_len", "std_len", "total_len", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], "n50", "mean_gc")


@query("record_budget", "SELECT source, count(*)::bigint AS records, count(*) > 5000 AS over_budget FROM documents GROUP BY source")
def _(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("records"), (F.count("*") > 5000).alias("over_budget"))


# k-mers

Q["kmer_counts"] = lambda spark, d: K.kmer_counts(_dna(spark, d), 3)
SQL["kmer_counts"] = f"{_counts(DNA, 'dna', 3)} SELECT * FROM c"
Q["kmer_normalize"] = lambda spark, d: K.shares(K.kmer_counts(_dna(spark, d), 2)).select("seq_id", "kmer", "cnt", F.round("freq", 9).alias("freq"))
SQL["kmer_normalize"] = f"{_counts(DNA, 'dna', 2)} SELECT seq_id, kmer, cnt, round(cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM c"
for _name, _k in (("nac", 1), ("dnc", 2), ("tnc", 3)):
    Q[_name] = lambda spark, d, k=_k: K.composition(_dna(spark, d), k, digits=9)
    SQL[_name] = _composition(DNA, "dna", _k)
for _name, _k in (("aac", 1), ("dpc", 2), ("tpc", 3)):
    Q[_name] = lambda spark, d, k=_k: K.composition(_protein(spark, d), k, digits=9)
    SQL[_name] = _composition(PROTEIN, "protein", _k)
for _name, _k in (("gaac", 1), ("gdpc", 2), ("gtpc", 3)):
    Q[_name] = lambda spark, d, k=_k: K.composition(K.grouped(_protein(spark, d), K.FIVE_GROUPS), k, digits=9)
    SQL[_name] = _composition(_grouped(K.FIVE_GROUPS), "g", _k)
for _name, _aft in (("kgap_di", 2), ("kgap_tri", 3)):
    Q[_name] = lambda spark, d, k=_aft: K.composition(_dna(spark, d), k + 1, gap=1, skip="_", digits=9)
    SQL[_name] = _composition(DNA, "dna", _aft, pattern=f"substr(seq, i, 1) || '_' || substr(seq, i + 2, {_aft})", width=_aft + 2)
Q["kmer_upto"] = lambda spark, d: K.upto(_dna(spark, d), 3).select("seq_id", "k", "kmer", F.round(F.col("cnt") / F.col("total"), 9).alias("freq"))
SQL["kmer_upto"] = _upto(DNA, "dna", (1, 2, 3), "SELECT seq_id, {k} AS k, kmer, round(cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM c")
_RC = "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"
Q["canonical_kmers"] = lambda spark, d: K.canonical_counts(_dna(spark, d), 3)
SQL["canonical_kmers"] = f"WITH {DNA}, {_windows('dna', 3)} SELECT seq_id, {_RC} AS kmer, count(*)::bigint AS cnt FROM w GROUP BY seq_id, {_RC}"
Q["revc_kmer"] = lambda spark, d: K.canonical_upto(_dna(spark, d), 3).select("seq_id", "k", "kmer", F.round(F.col("cnt") / F.col("total"), 9).alias("freq"))
SQL["revc_kmer"] = _upto(DNA, "dna", (1, 2, 3), f"SELECT seq_id, {{k}} AS k, rc AS kmer, round(n / (sum(n) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM (SELECT seq_id, {_RC} AS rc, sum(cnt) AS n FROM c GROUP BY seq_id, {_RC})")
Q["corpus_ngrams"] = lambda spark, d: K.kmer_counts(_dna(spark, d), 4).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
SQL["corpus_ngrams"] = f"WITH {DNA}, {_windows('dna', 4)} SELECT kmer, count(*)::bigint AS cnt FROM w GROUP BY kmer"
Q["shannon_entropy"] = lambda spark, d: K.shannon(_dna(spark, d), (1, 2, 3, 4, 5))
_H = "SELECT seq_id, {k} AS k, CASE WHEN abs(h) > 0 THEN h END AS entropy FROM (SELECT seq_id, round({h}, 6) AS h FROM (SELECT seq_id, cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double AS p FROM c) GROUP BY seq_id)"
SQL["shannon_entropy"] = _upto(DNA, "dna", (1, 2, 3, 4, 5), _H.replace("{h}", "-sum(p * log2(p))"))
Q["tsallis_entropy"] = lambda spark, d: K.tsallis(_dna(spark, d), (1, 2, 3, 4, 5), 2.3)
SQL["tsallis_entropy"] = _upto(DNA, "dna", (1, 2, 3, 4, 5), _H.replace("{h}", "(1 - sum(pow(p, 2.3::double))) / 1.3::double"))
Q["stepped_windows"] = lambda spark, d: K.stretches(_dna(spark, d), 30, 30).groupBy("seq_id", F.col("kmer").alias("word")).agg(F.count("*").alias("cnt"))
SQL["stepped_windows"] = f"WITH {DNA}, w AS (SELECT seq_id, substr(seq, i, 30) AS kmer FROM (SELECT *, unnest(range(1, length(seq) + 1, 30)) AS i FROM dna)) SELECT seq_id, kmer AS word, count(*)::bigint AS cnt FROM w GROUP BY ALL"
Q["cksaap"] = lambda spark, d: K.spaced_pairs(_protein(spark, d), range(0, 6))
SQL["cksaap"] = " UNION ALL ".join(
    f"SELECT * FROM ({_counts(PROTEIN, 'protein', 2, pattern=f'substr(seq, i, 1) || substr(seq, i + {g + 1}, 1)', width=g + 2)} SELECT seq_id, {g} AS gap, kmer AS pair, round(cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM c)" for g in range(6)
)
Q["cksaagp"] = lambda spark, d: K.spaced_pairs(K.grouped(_protein(spark, d), K.FIVE_GROUPS), range(0, 6))
SQL["cksaagp"] = " UNION ALL ".join(
    f"SELECT * FROM ({_counts(_grouped(K.FIVE_GROUPS), 'g', 2, pattern=f'substr(seq, i, 1) || substr(seq, i + {g + 1}, 1)', width=g + 2)} SELECT seq_id, {g} AS gap, kmer AS pair, round(cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double, 9) AS freq FROM c)" for g in range(6)
)
Q["dde"] = lambda spark, d: K.dipeptide_deviation(_protein(spark, d))
_CODON = "CASE {0} " + " ".join(f"WHEN '{a}' THEN {n}" for a, n in K.CODONS.items()) + " END"
SQL["dde"] = (
    f"{_counts(PROTEIN, 'protein', 2)}, a AS (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS a), g AS (SELECT seq_id, length(seq) AS n, x.a || y.a AS kmer, "
    f"({_CODON.format('x.a')})::double / 61 * ({_CODON.format('y.a')}) / 61 AS tm FROM protein, a x, a y WHERE length(seq) >= 2), f AS (SELECT seq_id, kmer, n, tm, coalesce(cnt, 0) / (n - 1)::double AS p FROM g LEFT JOIN c USING (seq_id, kmer)) "
    "SELECT seq_id, kmer, round((p - tm) / sqrt(tm * (1 - tm) / (n - 1)), 6) AS dde FROM f"
)
Q["ctriad"] = lambda spark, d: K.triad_scores(_protein(spark, d))
SQL["ctriad"] = f"{_counts(_grouped(K.SEVEN_GROUPS), 'g', 3)} SELECT seq_id, kmer, round((cnt - CASE WHEN count(*) OVER s = 343 THEN min(cnt) OVER s ELSE 0 END) / (max(cnt) OVER s)::double, 9) AS score FROM c WINDOW s AS (PARTITION BY seq_id)"


@query("avg_composition", f"{_counts(DNA, 'dna', 1)}, f AS (SELECT seq_id, kmer, cnt / (sum(cnt) OVER (PARTITION BY seq_id))::double AS p FROM c) SELECT kmer AS residue, round(sum(p) / (SELECT count(DISTINCT seq_id) FROM f), 6) AS freq FROM f GROUP BY kmer")
def _(spark, d):
    s = _dna(spark, d)
    n = s.where("length(seq) > 0").agg(F.count("*").alias("n"))
    f = K.shares(K.kmer_counts(s, 1)).groupBy(F.col("kmer").alias("residue")).agg(F.sum("freq").alias("p"))
    return f.join(F.broadcast(n)).select("residue", F.round(F.col("p") / F.col("n"), 6).alias("freq"))


@query("kmer_diversity", f"WITH {DNA}, {_windows('dna', 2)}, c AS (SELECT label, kmer, count(*) AS cnt FROM w GROUP BY ALL) SELECT label, round(sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double)), 3) AS diversity FROM c GROUP BY label")
def _(spark, d):
    c = K.kmer_counts(_dna(spark, d), 2, ("seq_id", "label")).groupBy("label", "kmer").agg(F.sum("cnt").alias("cnt"))
    return c.groupBy("label").agg(F.round(F.sum("cnt") * F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")), 3).alias("diversity"))


_STOP_FREE = "M[Mabcd]*[01]"


def _codon_letters(frame: int) -> F.Column:
    """One letter for each codon of a frame: M start, 0 TAA, 1 TAG or TGA, else a to d for no to three G or C."""
    codons = F.transform(F.sequence(F.lit(frame), F.length("seq") - 3, F.lit(3)), lambda i: F.array_join(F.slice("chars", i + 1, 3), ""))
    gc = lambda c: F.element_at(F.array(*[F.lit(x) for x in "abcd"]), F.length(F.regexp_replace(c, "[AT]", "")) + 1)
    letter = F.transform(codons, lambda c: F.when(c == "ATG", "M").when(c == "TAA", "0").when(c.isin("TAG", "TGA"), "1").otherwise(gc(c)))
    return F.when(F.length("seq") >= frame + 3, F.array_join(letter, "")).otherwise("")


_FRAME_SQL = """SELECT seq_id, unnest(regexp_extract_all(array_to_string(list_transform(range({f} + 1, length(seq) - 1, 3), lambda i: CASE substr(seq, i, 3) WHEN 'ATG' THEN 'M' WHEN 'TAA' THEN '0' WHEN 'TAG' THEN '1' WHEN 'TGA' THEN '1'
ELSE ['a', 'b', 'c', 'd'][length(regexp_replace(substr(seq, i, 3), '[AT]', '', 'g')) + 1] END), ''), 'M[Mabcd]*[01]')) AS orf FROM dna"""


@query(
    "orf_stats",
    f"""WITH {DNA}, o AS ({" UNION ALL ".join(_FRAME_SQL.format(f=f) for f in range(3))}),
m AS (SELECT seq_id, 3 * length(orf) AS n, 100.0::double * (length(regexp_replace(orf, '[^Mb1]', '', 'g')) + 2 * length(regexp_replace(orf, '[^c]', '', 'g')) + 3 * length(regexp_replace(orf, '[^d]', '', 'g'))) / (3 * length(orf)) AS gc FROM o)
SELECT d.seq_id, coalesce(max(n), 0)::int AS max_len, coalesce(min(n), 0)::int AS min_len, coalesce(round(avg(n), 6), 0)::double AS avg_len, coalesce(round(stddev_pop(n), 6), 0)::double AS std_len, coalesce(round(stddev_pop(n) / avg(n), 6), 0)::double AS cv_len,
coalesce(round(max(gc), 6), 0)::double AS max_gc, coalesce(round(min(gc), 6), 0)::double AS min_gc, coalesce(round(avg(gc), 6), 0)::double AS avg_gc, coalesce(round(stddev_pop(gc), 6), 0)::double AS std_gc
FROM dna d LEFT JOIN m USING (seq_id) GROUP BY d.seq_id""",
)
def _(spark, d):
    s = _dna(spark, d)
    frames = K.bound(s, "seq_id", "seq", chars=F.split("seq", "")).select("seq_id", F.explode(F.array(*map(_codon_letters, range(3)))).alias("code"))
    found = frames.select("seq_id", F.explode(F.regexp_extract_all("code", F.lit(_STOP_FREE), F.lit(0))).alias("orf"))
    part = lambda p: F.length(F.regexp_replace("orf", f"[^{p}]", ""))
    m = found.select("seq_id", (3 * F.length("orf")).alias("n"), (100.0 * (part("Mb1") + 2 * part("c") + 3 * part("d")) / (3 * F.length("orf"))).alias("gc"))
    zero = lambda c, name: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(name)
    stats = m.groupBy("seq_id").agg(F.max("n").alias("mx"), F.min("n").alias("mn"), *[f(c).alias(f"{k}_{c}") for c in ("n", "gc") for k, f in (("avg", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))])
    return s.select("seq_id").join(stats, "seq_id", "left").select(
        "seq_id", F.coalesce("mx", F.lit(0)).alias("max_len"), F.coalesce("mn", F.lit(0)).alias("min_len"), zero(F.col("avg_n"), "avg_len"), zero(F.col("std_n"), "std_len"), zero(F.col("std_n") / F.col("avg_n"), "cv_len"),
        zero(F.col("max_gc"), "max_gc"), zero(F.col("min_gc"), "min_gc"), zero(F.col("avg_gc"), "avg_gc"), zero(F.col("std_gc"), "std_gc"),
    )


# folds, samples, resampling

_RANKED = "row_number() OVER ({0} ORDER BY md5('{1}:' || doc_id::varchar), doc_id)"


@query("stratified_folds", f"SELECT doc_id AS seq_id, lang AS label, (({_RANKED.format('PARTITION BY lang', 42)} - 1) % 5)::int AS fold FROM documents")
def _(spark, d):
    return folds(read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("label")), 5, 42, "label")


@query("kfold", f"SELECT doc_id AS seq_id, (({_RANKED.format('', 42)} - 1) % 5)::int AS fold FROM documents")
def _(spark, d):
    return folds(read(spark, d, "documents").select(F.col("doc_id").alias("seq_id")), 5, 42)


@query("sample_split", f"SELECT doc_id AS seq_id, CASE WHEN {_RANKED.format('', 11)} <= 100 THEN 'test' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    s = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"))
    test = s.orderBy(md5_key(11, "seq_id"), "seq_id").limit(100)  # the operator's own sample size
    return s.join(test, "seq_id", "left_anti").withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("random_selection", f"SELECT doc_id AS seq_id, lang AS label FROM (SELECT *, {_RANKED.format('', 5)} AS r FROM documents) WHERE r <= 50")
def _(spark, d):
    s = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("label"))
    return s.orderBy(md5_key(5, "seq_id"), "seq_id").limit(50)


@query("undersample", f"WITH r AS (SELECT doc_id, lang, {_RANKED.format('PARTITION BY lang', 63)} AS r FROM documents), m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) SELECT doc_id AS seq_id, lang AS label FROM r, m WHERE r <= least")
def _(spark, d):
    from strandloom.operators.features import undersample

    return undersample(read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("label")), 63)
