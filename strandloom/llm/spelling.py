"""Spelling variants: words within one edit of each other by pivotal grams, each sent to its most frequent near word.

Two words within one edit share one of any two disjoint bigrams of either. Bigrams have one order for all words, rarest first. A word's
prefix is its first three bigrams in that order and whatever ties with the third; its pivots are the two disjoint ones of the prefix
that are rarest together. Of two near words, the one whose prefix ends sooner has a pivot that lies, intact, in the other's prefix.
The edit lies left or right of that bigram: right of it the bigram keeps its position, left of it it moves by the difference of
lengths, and of the half-words on the other side nothing changes. So pivots look up prefixes by position and by all of the word but
the part that the edit may have touched, and only words that fit there are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.llm.common import drop, saved, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO = 97  # a document's spelling of a word loses a code point where this divides its checksum
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2  # times as frequent as the word that takes it for its form
BUCKETS = 1 << 16  # of bigrams, whose counts order them
PREFIX = 3  # bigrams of which two are disjoint
_SLICE = 1 << 20
_FLUSH = 400_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_SAME = "\0"


def _runs(text: str) -> Counter:
    """How often each run of letters occurs, as it is written; long texts are read in slices that end between runs."""
    if len(text) <= _SLICE:
        return Counter(RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and RUN.match(text, end - 1, end + 1) and RUN.match(text, end, end + 1):
            end += 1
        found.update(RUN.findall(text, at, min(end, len(text))))
        at = end
    return found


def spelled(doc_id, run: str, typo: int = TYPO) -> str:
    """The run in lower case (A-Z only) as the document spells it."""
    low = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    if typo and h % typo == 0:
        i = h % len(low)
        low = low[:i] + low[i + 1 :]
    return low


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT, least_length: int = LEAST_LENGTH, typo: int = TYPO) -> DataFrame:
    """(word, n) of whole texts of docs (doc_id, text): runs of A-Z, a-z and U+00C0 to U+00FF, counted within a task before they are
    shuffled. typo=0 leaves words as they are. Null and empty texts have no words, a null doc_id counts as an empty one, repeated
    rows count each; an empty table has no words; other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                for run, n in _runs(text or "").items():
                    word = spelled(doc_id, run, typo)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= _FLUSH:
                    yield rows()
        yield rows()

    runs = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each of `BUCKETS` hash buckets of bigrams by how often they occur in the words, rarest first. That many numbers come
    to the driver whatever the alphabet and the number of words; any order of bigrams gives all pairs, a good one gives few candidates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        seen: dict[str, int] = {}
        for batch in batches:
            grams = Counter(w[i : i + 2] for w in texts(batch, "word") for i in range(len(w) - 1))
            for g, k in grams.items():
                if g not in seen:
                    if len(seen) > _FLUSH:
                        seen.clear()
                    seen[g] = _bucket(g)
                n[seen[g]] += k
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    for r in words.select("word").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(BUCKETS)
    return rank


def pivots(prefix: list[tuple[int, int]], k: int = 2, q: int = 2) -> list[int]:
    """Positions of k disjoint bigrams of a prefix [(position, weight)] whose weights' sum is least, by dynamic programming over the
    positions in turn: the best choice of j among the first i bigrams either leaves the i-th out or adds it to the best choice of
    j - 1 among those that end before it."""
    items = sorted(prefix)
    none = (float("inf"), ())
    best = [[(0, ())] + [none] * k]
    for i, (p, weight) in enumerate(items):
        before = next((j for j in range(i, 0, -1) if items[j - 1][0] + q <= p), 0)
        row = [(0, ())]
        for j in range(1, k + 1):
            cost, chosen = best[before][j - 1]
            row.append(min(best[i][j], (cost + weight, (*chosen, p))))
        best.append(row)
    return list(best[-1][k][1])


def signature(word: str, rank: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Where the word's prefix ends in the order of bigrams, the positions of the prefix, and those of its pivots."""
    grams = []
    for i in range(len(word) - 1):
        g = word[i : i + 2]
        grams.append((int(rank[_bucket(g)]) << 42 | ord(g[0]) << 21 | ord(g[1]), i))
    grams.sort()
    last = grams[min(PREFIX, len(grams)) - 1][0]
    prefix = [(p, order >> 42) for order, p in grams if order <= last]
    return last, [p for p, _ in prefix], pivots(prefix)


def _masks(p: int, length: int) -> list[tuple[int, int]]:
    """Parts of a word of this length that an edit may touch while the bigram at p is left: halves of what lies left and right."""
    out = []
    for a, b in ((0, p), (p + 2, length)):
        out += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def prefix_keys(word: str, prefix: list[int]) -> set[str]:
    """What a word is found by: for each bigram of its prefix its position, a part that may differ, and all the rest."""
    return {f"{p},{a},{b}{_SAME}{word[:a]}{_SAME}{word[b:]}" for p in prefix for a, b in _masks(p, len(word))}


def pivot_keys(word: str, chosen: list[int]) -> set[str]:
    """What a word looks up: the keys of words one code point shorter, as long, or longer, in which one of its pivots lies at the place
    that such an edit leaves it."""
    out = set()
    for p in chosen:
        for more in (-1, 0, 1):
            length = len(word) + more
            for side, at in ((0, p + more), (1, p)):
                if at < 0 or at + 2 > length:
                    continue
                for a, b in _masks(at, length)[2 * side : 2 * side + 2]:
                    if a <= b - more <= len(word):  # the part is as much longer in the other word
                        out.add(f"{at},{a},{b}{_SAME}{word[:a]}{_SAME}{word[b - more :]}")
    return out


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of distinct words (word, n) one inserted, deleted or replaced code point apart, each in both
    directions. Words of fewer than four code points do not have the bigrams for it and take no part."""
    sent = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def keyed(of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys, ends = [], [], []
                for i, w in enumerate(texts(batch, "word")):
                    if len(w) > PREFIX:
                        last, found = of(w, sent.value)
                        rows += [i] * len(found)
                        keys += found
                        ends += [last] * len(found)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(ends, pa.int64())], ["key", "word", "n", "last"])

        return words.select("word", "n").mapInArrow(run, "key string, word string, n long, last long")

    def looked_up(word: str, rank: np.ndarray) -> tuple[int, set[str]]:
        last, _, chosen = signature(word, rank)
        return last, pivot_keys(word, chosen)

    def found_by(word: str, rank: np.ndarray) -> tuple[int, set[str]]:
        last, prefix, _ = signature(word, rank)
        return last, prefix_keys(word, prefix)

    left = keyed(looked_up)
    right = keyed(found_by).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"))
    # Spark takes the keys to be as few as the words they are made of, and a table to be as large as its compressed file: without the
    # hints it may send them whole to the driver and all tasks
    pairs = left.join(right.hint("merge"), "key").where("last <= near_last and word <> near and levenshtein(word, near, 1) = 1")
    pairs = pairs.select("word", "n", "near", "near_n")
    return pairs.union(pairs.select("near", "near_n", "word", "n")).distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word (word, n; distinct) with the form it is a variant of: word, n, n_near, form, form_n, root.

    The form is the near word of largest n, of equal ones the smallest in code-point order, if it is at least `ratio` (2 or more) times
    as frequent; n grows from form to form, so a word's forms end at a root, which pointers that double their reach find in the
    logarithm of the longest chain. A word without near words has n_near 0 and is its own root. Only words and pairs of near
    words are shuffled, never all words of a group.
    """
    words = saved(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    all_words = words.join(near.hint("merge"), "word", "left")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    found = all_words.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"))
    found = saved(found, "forms")
    drop(words)
    at = saved(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        beyond = at.toDF("via", "beyond")
        new = at.join(beyond.hint("merge"), at["root"] == beyond["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().cast("int").alias("moved"))
        last, at = at, saved(new.observe(seen, F.sum("moved").alias("moved")).drop("moved"), "roots")
        drop(last)
        if not seen.get["moved"]:
            break
    return found.join(at.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_pivotal_grams(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of all documents, their near words, forms and roots."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = """
WITH t0 AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
t AS MATERIALIZED (SELECT list(c::bigint ORDER BY i) AS t FROM t0),
runs AS (SELECT coalesce(doc_id::varchar, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lows AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, low, k, hex(encode(doc_id || ':' || low)) AS x FROM lows),
sums AS (SELECT doc_id, low, k, xor(list_reduce([4294967295::bigint] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, t),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN low[1 : h % length(low)] || low[h % length(low) + 2 :] ELSE low END AS word, k FROM sums),
w AS MATERIALIZED (SELECT word, sum(k)::bigint AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
half AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, (-near_n, near)) AS near FROM half GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END::bigint AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, coalesce(form, word) AS root, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
    SELECT word, arg_max(root, d) AS root FROM c GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN chain USING (word)
"""
