"""Contract queries on documents of every odd kind against the rules written out; packing against the best possible."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandloom.llm import decontaminate, packing, substring_dedup


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    long = (900, "many words in one long text " * 3_000)
    passage = " ".join(odd_docs[9][1].split()[100:160])
    docs = [*odd_docs, long, (901, passage), (902, "and " + passage + " again")]
    spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n string").repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, odd_docs[7][1][300:420]), (2, "one two"), (3, None), (4, ""), (5, "ONE, two"), (20, "never seen at all"), (10, passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, items


def test_repeats(spark, folder):
    at, docs, _ = folder
    got = substring_dedup.op9_aho_corasick(spark, at)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = substring_dedup.brute_force(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want and sum(v[1] > 0 for v in want.values()) > 3


def test_leaks(spark, folder):
    at, docs, items = folder
    want = decontaminate.brute_force(docs, items)
    got = decontaminate.op10_fm_index(spark, at).collect()
    assert len(got) == len(docs)
    for r in got:
        n_words, n_hit, hit = want[r.doc_id][:3]
        names = ",".join(sorted(map(str, hit)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(hit), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
    assert sum(r.contaminated for r in got) >= 4


def test_pieces(spark, folder):
    at, docs, _ = folder
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = set()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)}
    rows = packing.op4_best_fit_packing(spark, at).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def fewest(lengths, capacity):
    """The least number of sequences, by all subsets."""
    whole = (1 << len(lengths)) - 1
    fits = [m for m in range(1, whole + 1) if sum(x for i, x in enumerate(lengths) if m >> i & 1) <= capacity]

    @lru_cache(None)
    def need(left):
        return 0 if not left else 1 + min(need(left & ~m) for m in fits if m & left & -left and not m & ~left)

    return need(whole)


def test_packing_of_small_cases_against_the_best():
    rng = random.Random(6)
    over = 0
    for _ in range(150):
        capacity = rng.choice([10, 24, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        histogram = {x: lengths.count(x) for x in lengths}
        kinds = packing.plan(histogram, capacity, groups=rng.choice([1, 3, 64]))
        placed: dict = {}
        for holds, many in kinds:
            assert sum(x * c for x, c in holds) <= capacity
            for x, c in holds:
                placed[x] = placed.get(x, 0) + c * many
        assert placed == histogram
        extra = sum(many for _, many in kinds) - fewest(tuple(lengths), capacity)
        assert 0 <= extra <= 1
        over += extra
    assert over <= 15
