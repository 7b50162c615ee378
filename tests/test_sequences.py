import glob
import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions.residues import EISENBERG
from strandloom.operators import evaluation as E
from strandloom.operators import features as X
from strandloom.operators import kmers as K
from strandloom.operators import neighbours as N
from strandloom.operators import peptides as P
from strandloom.operators import sequences as S
from strandloom.operators import signals
from strandloom.plans.sequence_queries import Q
from strandloom.sources import fasta
from strandloom.streaming import status

G1 = "CCTGGCGGCCGTAGCGCGGTGGTCCCACCTGACCCCATGCCGAACTCAGAAGTGAAACGCCGTAGCGCCGATGGTAGTGTGGGGTCTCCCCATGCGAGAGTAGGGAACTGCCAGGC"


def table(spark, *seqs):
    return spark.createDataFrame([(i, "x", s) for i, s in enumerate(seqs)], "seq_id long, label string, seq string")


def test_cleaning(spark):
    got = spark.createDataFrame([("acgu-N ß",), ("",), (None,)], "t string").select(S.clean_dna(F.col("t")).alias("d"), S.clean_protein(F.col("t")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("ACGT", "ACGN"), ("", ""), (None, None)]


def test_recorded_composition(spark):
    got = {r.kmer: r.freq for r in K.composition(table(spark, G1), 1).collect()}
    assert got == {"A": 0.189655, "C": 0.310345, "G": 0.344828, "T": 0.155172}


def test_short_and_uniform_sequences(spark):
    s = table(spark, "", "A", "AAAA", "ACGT")
    assert K.kmer_counts(s, 2).where("seq_id < 2").count() == 0
    got = {(r.seq_id, r.k): r.entropy for r in K.shannon(s, (1, 2)).collect()}
    assert got[2, 1] is None and got[3, 1] == 2.0 and (0, 1) not in got
    assert {r.kmer for r in K.canonical_counts(table(spark, "ACGT"), 4).collect()} == {"ACGT"}


def test_orf_rule(spark, tmp_path):
    s = spark.createDataFrame([(1, "en", "src", G1), (2, "en", "src", "")], "doc_id long, lang string, source string, text string")
    s.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.seq_id: r for r in Q["orf_stats"](spark, str(tmp_path)).collect()}
    assert (got[1].max_len, got[1].min_len, got[1].std_len, got[1].max_gc) == (33, 33, 0.0, 57.575758)
    assert got[2].max_len == 0 and got[2].avg_gc == 0.0


@pytest.mark.parametrize(
    "column,seq,want",
    [("charge", "KLAKFGKRSELVALSG", 3.989), ("mw", "IAESFKGHIPL", 1210.43), ("aromaticity", "GLFYWRFFLQRRFLYWW", 0.529412), ("aliphatic_index", "KWLKYLKKLAKLVK", 139.285714), ("boman_index", "GLFDIVKKVVGALGSL", -1.011875), ("hydrophobic_ratio", "VALLYWRTVLLAIII", 0.733333)],
)
def test_published_properties(spark, column, seq, want):
    assert P.global_properties(table(spark, seq)).first()[column] == pytest.approx(want, abs=0.005 if column == "mw" else 1e-6)


def test_scale_mean(spark):
    assert P.scale_mean(table(spark, "GLFDIVKKVVGALGSL"), EISENBERG).first().value == pytest.approx(0.44875)


def test_more_published_properties(spark):
    # all twenty free acids hold C107 H197 N29 O49 S2; nineteen bonds lose water
    assert P.molecular_formula(table(spark, "ACDEFGHIKLMNPQRSTVWY")).first().formula == "C107 H159 N29 O30 S2"
    assert P.molecular_formula(table(spark, "GG"), amide=True).first().formula == "C4 H9 N3 O2"
    assert P.isoelectric_point(table(spark, "KLFDIKFGHIPQRST"), amide=False).first().pi == pytest.approx(10.6797, abs=1e-3)
    assert P.hydrophobic_moment(table(spark, "GLFDIVKKVVGALGSL"), EISENBERG).first().moment == pytest.approx(0.487902, abs=1e-6)


def test_smote_levels_labels(spark):
    rows = spark.createDataFrame([(i, int(i < 4), [float(i), 1.0]) for i in range(14)], "id long, label int, v array<double>")
    new = N.smote(rows, 3, 1).collect()
    assert len(new) == 6 and all(r.label == 1 and 0 <= r.v[0] <= 3 for r in new)
    near = N.nearest(rows.where("id = 0"), rows, 2, block_rows=3).collect()
    assert sorted((r.other, r.d) for r in near) == [(1, 1.0), (2, 4.0)]


def test_folds_are_even(spark):
    rows = spark.range(103).select(F.col("id").alias("seq_id"), (F.col("id") % 3).alias("label"))
    n = S.folds(rows, 5, 42, "label").groupBy("label", "fold").count().collect()
    for c in range(3):
        sizes = [r["count"] for r in n if r.label == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    small = X.undersample(rows.where("label > 0 or seq_id < 30"), 1).groupBy("label").count().collect()
    assert {r["count"] for r in small} == {10}


def test_evaluation_of_recorded_matrix(spark):
    rows = [("rRNA", "rRNA")] * 8 + [("sRNA", "rRNA")] + [("sRNA", "sRNA")] * 32 + [("tRNA", "tRNA")] * 10
    p = spark.createDataFrame(rows, "real string, pred string")
    m = E.summary(p).first()
    assert (m.accuracy, m.f1_macro, m.f1_weighted) == pytest.approx((0.980392, 0.975264, 0.980818), abs=2e-6)
    r = {x.cls: x for x in E.report(p).collect()}
    assert r["rRNA"].precision == pytest.approx(0.888889) and r["sRNA"].recall == pytest.approx(0.969697)
    assert {(x.real, x.pred): x.n for x in E.confusion(p).collect()}[("All", "All")] == 51


def test_scaling_of_a_constant(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (1, "b", 1.0), (2, "b", None)], "id long, feature string, value double")
    assert {r.value for r in X.standard_scale(x.where("feature = 'a'")).collect()} == {0.0}
    assert {r.value for r in X.impute_mean(x).where("feature = 'b'").collect()} == {1.0}


def test_spectrum_keeps_energy(spark):
    values = {"A": 1.0, "C": -1.0, "G": 2.0, "T": 0.5}
    r = signals.spectrum_summary(table(spark, "ACGTTGCA", ""), signals.numbers(values)).orderBy("seq_id").collect()
    assert r[0]["mean"] == pytest.approx(sum(values[c] ** 2 for c in "ACGTTGCA")) and r[1]["mean"] is None
    end = signals.chaos_game(table(spark, "AC")).first()
    assert (end.x, end.y) == (-0.25, -0.25) and math.isclose(end.x, -0.25)


def test_fasta_round_trip(spark, tmp_path):
    with open(tmp_path / "rRNA.fasta", "w") as f:
        f.write(">a one\nACGU\nacg\n>b\n\n>c\nTT\n")
    got = fasta.fasta_scan(spark, f"{tmp_path}/rRNA.fasta").orderBy("ord").collect()
    assert [(r.label, r.ord, r.name, r.seq) for r in got] == [("rRNA", 0, "a", "ACGUACG"), ("rRNA", 1, "b", ""), ("rRNA", 2, "c", "TT")]
    good, bad = fasta.quarantine(fasta.fasta_scan(spark, f"{tmp_path}/rRNA.fasta"))
    assert good.count() == 2 and bad.count() == 1
    fasta.write_fasta(good, f"{tmp_path}/out")
    assert fasta.fasta_scan(spark, f"{tmp_path}/out").count() == 2


def test_csv_with_repeated_headers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("nameseq,a,label\nx,1.5,p\nnameseq,a,label\ny,,q\n")
    got = fasta.csv_without_repeated_headers(spark, f"{tmp_path}/f.csv", "nameseq").orderBy("nameseq").collect()
    assert [tuple(r) for r in got] == [("x", 1.5, "p"), ("y", None, "q")]


def test_streams(spark, tmp_path):
    spark.sql("select 1L as event_id, timestamp '2024-01-01' as ts, 7L as user_id, 'a' as event_type union all select 2L, timestamp '2024-01-02', 7L, 'b'").write.parquet(f"{tmp_path}/log")
    schema = spark.read.parquet(f"{tmp_path}/log").schema
    q = status.latest_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.user_id, r.status, r.seconds) for r in spark.table("latest").collect()] == [(7, "b", 86400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.fasta").write_text(">a\nAC\nG\n>b\nT\n")
    q = status.score_new_files(spark, f"{tmp_path}/in", lambda df: df.withColumn("score", F.length("seq")), f"{tmp_path}/scores", f"{tmp_path}/state")
    q.awaitTermination(60)
    assert glob.glob(f"{tmp_path}/scores/*") and {(r.name, r.score) for r in spark.read.parquet(f"{tmp_path}/scores").collect()} == {("a", 3), ("b", 1)}
