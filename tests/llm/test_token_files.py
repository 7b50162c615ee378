"""Token files against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import token_files
from strandloom.llm.packing import tokenizer_path

PATH = tokenizer_path()


def plain(docs):
    """(doc_id, start, n_tokens, crc, ids) of rows in their order in the files."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, odd_docs, odd_table, no_docs, tmp_path):
    want = plain(sorted([*odd_docs, odd_docs[7]], key=lambda r: r[0]))
    for i, kw in enumerate(({}, {"part_bytes": 300}, {"dictionary": b""})):
        at = f"{tmp_path}/{i}"
        token_files.write_tokens(odd_table, at, PATH, **kw)
        assert rows_of(token_files.read_tokens(spark, at)) == sorted(want)
        assert rows_of(token_files.read_tokens(spark, at, ids=False)) == sorted(w[:4] for w in want)
        parts = token_files.manifest(spark, at).orderBy("part", "roll").collect()
        assert [p["first"] for p in parts] == sorted(p["first"] for p in parts) and sum(p.docs for p in parts) == len(want)
        assert len(parts) > 5 or not kw.get("part_bytes")
        index = rows_of(token_files.token_index(spark, at).select("doc_id", "start", "n_tokens"))
        assert index == sorted(w[:3] for w in want)
    token_files.write_tokens(no_docs, f"{tmp_path}/none", PATH)
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_fetch_reads_chosen_documents(spark, odd_docs, odd_table, tmp_path):
    at = f"{tmp_path}/t"
    token_files.write_tokens(odd_table, at, PATH, part_bytes=2000)
    wanted = spark.createDataFrame([(3,), (9,), (9,), (7,), (None,), (10**9,)], "doc_id long")
    want = [w for w in plain(sorted([*odd_docs, odd_docs[7]], key=lambda r: r[0])) if w[0] in (3, 7, 9)]
    assert rows_of(token_files.fetch_tokens(spark, at, wanted)) == sorted(want)


def test_odd_ids_ties_and_long_texts(spark, tmp_path):
    texts = [None, "", "a <|endoftext|> b", "x\x1cy z", "word " * 60_000, "ÀÉ ΟΔΟΣ σ", "twice", "twice"]
    docs = spark.createDataFrame([(None if i < 2 else 5, t) for i, t in enumerate(texts)], "doc_id int, text string")
    token_files.write_tokens(docs, f"{tmp_path}/t", PATH)
    got = token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    want = sorted((w[2:] for w in plain([(0, t) for t in texts])), key=str)
    assert sorted(((r.n_tokens, r.ids_crc32, r["ids"]) for r in got), key=str) == want
    assert [r.doc_id for r in got] == [None] * 2 + [5] * 6 and dict(token_files.read_tokens(spark, f"{tmp_path}/t").dtypes)["doc_id"] == "int"
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_another_dictionary_is_refused(spark, odd_table, tmp_path):
    at = f"{tmp_path}/t"
    token_files.write_tokens(odd_table, at, PATH)
    (tmp_path / "t" / "dictionary").write_bytes(b"something else")
    with pytest.raises(Exception, match="does not belong"):
        token_files.read_tokens(spark, at).count()


def test_dictionary_shortens_documents(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = ["river", "house", "street", "water", "people", "walked", "stone", "garden"]
    docs = spark.createDataFrame([(i, " ".join(words[j] for j in rng.integers(0, 8, 40))) for i in range(400)], "doc_id long, text string")
    sizes = []
    for name, kw in (("with", {}), ("without", {"dictionary": b""})):
        token_files.write_tokens(docs, f"{tmp_path}/{name}", PATH, **kw)
        sizes.append(token_files.manifest(spark, f"{tmp_path}/{name}").agg(F.sum("bytes")).first()[0])
    assert sizes[0] < 0.9 * sizes[1]


def test_contract_query(spark, odd_docs, tmp_path):
    spark.createDataFrame(odd_docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = token_files.op13_token_files(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert rows_of(got) == sorted(w[:4] for w in plain(odd_docs))
