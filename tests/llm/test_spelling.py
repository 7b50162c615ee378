"""Spelling variants against all pairs of words."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(counts):
    """Rows of variants(), by comparing every two words."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def counted(docs):
    total = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            total[low] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("alphabet,n", [("ab", 250), ("abcdé", 400), ("kßñaoein", 400)])
def test_near_words_are_all_found(spark, alphabet, n):
    rng = np.random.default_rng(n)
    words = {"".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(4, 10))) for _ in range(n)}
    words |= {w[:i] + c + w[i + j :] for w in sorted(words)[:60] for i in (0, 1, len(w) // 2, len(w) - 1) for c, j in ((alphabet[0], 0), ("z", 1), ("", 1)) if len(w[:i] + c + w[i + j :]) > 3}
    counts = {w: int(k) for w, k in zip(sorted(words), rng.integers(1, 40, len(words)), strict=True)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.near_words(table).collect()
    assert len(got) == len(set(got))
    assert {(r.word, r.near) for r in got} == {(a, b) for a, b in itertools.permutations(counts, 2) if one_edit(a, b)}
    assert all((r.n, r.near_n) == (counts[r.word], counts[r.near]) for r in got)
    assert {tuple(r) for r in spelling.variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect()} == all_pairs(counts)


def test_pivots_are_the_rarest_disjoint_ones():
    rng = np.random.default_rng(3)
    for _ in range(300):
        at = sorted(rng.choice(12, int(rng.integers(3, 7)), replace=False).tolist())
        prefix = [(p, int(rng.integers(0, 9))) for p in at]
        got = spelling.pivots(prefix)
        weight = dict(prefix)
        best = min(weight[a] + weight[b] for a, b in itertools.combinations(at, 2) if b - a >= 2)
        assert len(got) == 2 and got[1] - got[0] >= 2 and weight[got[0]] + weight[got[1]] == best


def test_words_of_odd_documents(spark, odd_docs, odd_table, no_docs, monkeypatch):
    want = counted([*odd_docs, odd_docs[7]])
    for size in (1 << 20, 7):
        monkeypatch.setattr(spelling, "_SLICE", size)
        total = Counter()
        for d, t in [*odd_docs, odd_docs[7]]:
            for run, n in spelling._runs(t or "").items():
                total[spelling.spelled(d, run)] += n
        assert {w: n for w, n in total.items() if len(w) >= 5 and n >= 3} == want
    assert {r.word: r.n for r in spelling.word_counts(odd_table).collect()} == want
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([(1, None), (None, "ÀÉîõü÷× Same SAME same-same")], "doc_id long, text string"), least_count=1, typo=0).count() == 1


def test_long_chain_and_ties(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    counts = {w: 3 * 2**i for i, w in enumerate(chain)} | {"zzzzy": 4, "zzzzx": 8, "zzzza": 8, "alone": 5}
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == all_pairs(counts)
    assert ("aaaaa", 3, 1, "aaaab", 6, "bbbcc") in got and ("zzzzy", 4, 2, "zzzza", 8, "zzzza") in got and ("alone", 5, 0, None, None, "alone") in got


def test_contract_query(spark, odd_docs, tmp_path):
    rng = np.random.default_rng(5)
    base = ["garden", "gardens", "gardin", "river", "rivver", "stones", "stonez", "ségur", "segur", "ségurs"]
    docs = [*odd_docs, *((1000 + i, " ".join(base[j] for j in rng.integers(0, len(base), 30))) for i in range(60)), (2000, "longword " * 20_000)]
    spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op12_pivotal_grams(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == all_pairs(counted(docs))
    assert dict(got.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}


def test_keys_are_not_sent_whole(spark):
    """The keys of few words are many more rows than their table: no join may take them for small."""
    words = spark.createDataFrame([(f"wording{i:03d}", 3 + i % 5) for i in range(200)], "word string, n long")
    plan = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
