"""Benchmark decontamination with an FM-index per shard of training documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import fold_words, give_back, saved

WINDOW = 10
SHARD_WORDS = 600_000
BLOCK_CHARS = 16_000_000  # of benchmark text that one pass searches for
SAMPLE_EVERY = 16
BROADCAST_ROWS = 20_000  # texts with hits; more are joined by a shuffle
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (small non-negative integers; the last one is 0 and smaller ends come first)."""
    n = len(s)
    bits = int(s.max() + 1).bit_length()
    width = max(1, 62 // bits)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(width, np.int64)])  # 0: past the end
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))  # places of ties
    while len(open_):
        at = order[open_]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, group, after = at[by], rank[at][by], after[by]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        width *= 2
    return order


class FMIndex:
    """Backward search by wavelet-matrix ranks; every SAMPLE_EVERY-th text position is kept to locate rows.

    The text must end with its only 0, so that steps back keep the order of rows.
    """

    def __init__(self, s: np.ndarray, size: int):
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))]).astype(np.int64)
        self.marked = order % SAMPLE_EVERY == 0
        self.sample = order[self.marked]
        self.sample_rank = np.cumsum(self.marked) - 1
        self.levels = []
        row = self.bwt
        for level in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            zero = (row >> level) & 1 == 0
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.levels.append((level, count, int(count[-1])))
            row = np.concatenate([row[zero], row[~zero]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places of the transform."""
        begin = np.zeros_like(at)
        for level, count, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            z, b = count[at], count[begin]
            at, begin = np.where(one, zeros + at - z, z), np.where(one, zeros + begin - b, b)
        return at - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of patterns (rows of equal length) that occur: which, and their range of rows."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            live = high > low
            which, low, high = which[live], low[live], high[live]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows, 0
        while len(left):
            done = self.marked[row]
            out[left[done]] = self.sample[self.sample_rank[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.bwt[row]
            row = self.first[c] + self.rank(c, row)
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items as rows of word numbers (from 2; 1 is any other word), one matrix for each length."""

    def __init__(self, items: list[tuple], window: int):
        self.words: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in fold_words(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                found.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(item)
        self.by_length = [(k, np.array(list(x), np.int64).reshape(-1, k), [sorted(v, key=str) for v in x.values()]) for k, x in sorted(found.items())]

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; a word of no phrase is 1."""
        words, get = fold_words(text), self.words.get
        return np.fromiter((get(w, 1) for w in words), np.int32, len(words))

    def hits(self, docs: list[np.ndarray]) -> list[tuple[np.ndarray, set]]:
        """For each document of a shard, given as its words' numbers: which of its words lie in an occurrence, and the items that occur."""
        out = [(np.zeros(len(d), bool), set()) for d in docs]
        if not self.by_length:
            return out
        lengths = [len(d) for d in docs]
        # a word of no phrase and a document's end are 1; of a run of them one is kept; a 0 ends the text
        end = np.ones(1, np.int32)
        ids = np.concatenate([x for d in docs for x in (d, end)])
        keep = np.flatnonzero((ids != 1) | (np.concatenate([[0], ids[:-1]]) != 1))
        if (ids == 1).all():
            return out
        index = FMIndex(np.concatenate([ids[keep], [0]]), len(self.words) + 2)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths) + 1)])
        for k, patterns, items in self.by_length:
            which, low, high = index.search(patterns)
            if not len(which):
                continue
            n = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = keep[index.locate(rows)]
            doc = np.searchsorted(starts, at, "right") - 1
            for d, i, p in zip(doc.tolist(), (at - starts[doc]).tolist(), np.repeat(which, n).tolist(), strict=True):
                out[d][0][i : i + k] = True
                out[d][1].update(items[p])
        return out


def spans_of(hit: np.ndarray) -> list[dict]:
    """Runs of hit words as merged spans of word numbers, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def cut(text: str | None, spans: list[dict]) -> str | None:
    """The text without the characters from the first to the last word of each span."""
    if not text or not spans:
        return text
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return "".join(out) + text[at:]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS, clean: bool = False) -> DataFrame:
    """Words of docs (doc_id, text) that lie in an occurrence of a window of benchmark (item_id, text) words.

    Each task joins its documents to shards of about `shard_words` words, builds an FM-index of each shard (words that
    no window has are one separator), searches all windows backwards at once and locates their occurrences. Windows
    are sent to the tasks in blocks of about `block_chars` characters of items, each a pass over the documents as they came;
    the spans of all passes are merged before anything is counted or cut.

    Returns a row for each row of docs: doc_id, n_words, n_hit, items (array of ids that occur, sorted as strings), spans
    (merged word ranges to remove, end exclusive), and with clean=True text_clean, the text without them. Null and
    empty texts have no words; items without words never occur; repeated rows are each returned, also those without a doc_id; an
    item shorter than the window is one window; other columns are ignored.
    """
    item = benchmark.schema["item_id"].dataType
    rows = _with_hits(docs.select("doc_id", "text"), benchmark, window, shard_words, block_chars)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<{item.simpleString()}>, spans {_SPANS_SQL}" + ", text_clean string" * clean
    kind = pa.list_(to_arrow_type(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, items = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            counts = [len(fold_words(t)) for t in found]
            spans = [merged(s, n) for s, n in zip(batch.column(2).to_pylist(), counts, strict=True)]
            hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(set(x or ()), key=str) for x in items], kind), pa.array(spans, _SPANS)]
            names = ["doc_id", "n_words", "n_hit", "items", "spans"]
            if clean:
                cols.append(pa.array([cut(t, s) for t, s in zip(found, spans, strict=True)], pa.string()))
                names.append("text_clean")
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<start:int,end:int>>"


def merged(spans: list[dict] | None, n_words: int) -> list[dict]:
    """Spans of several passes as one sorted, disjoint list."""
    if not spans:
        return []
    hit = np.zeros(n_words, bool)
    for s in spans:
        hit[s["start"] : s["end"]] = True
    return spans_of(hit)


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, block_chars: int) -> DataFrame:
    """docs (all columns, by place) with two more: the spans and items that occur in their texts, null without any."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    item = benchmark.schema["item_id"].dataType
    key = docs.select("text", F.xxhash64("text").alias("digest"))
    found = None
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        rows = [tuple(r) for r in own.select("item_id", "text").collect()]  # at most about block_chars characters
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        hits = key.mapInArrow(_searcher(sent, to_arrow_type(item), window, shard_words), f"digest long, spans {_SPANS_SQL}, items array<{item.simpleString()}>")
        found = hits if found is None else found.unionByName(hits)
    # equal texts have equal hits: one row for each text
    found = found.groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    found = saved(found, "hits")
    n = found.count()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select("*", F.xxhash64("text")).toDF(*names, "digest")
    return rows.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, "digest", "left").select(*names, "spans", "items")


def _searcher(sent, item: pa.DataType, window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        phrases = Phrases(sent.value, window)
        digests, words, n = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [(d, spans_of(h), list(x)) for d, (h, x) in zip(digests, phrases.hits(words), strict=True) if x]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), _SPANS, pa.list_(item)))]
            return pa.RecordBatch.from_arrays(cols, ["digest", "spans", "items"])

        for batch in batches:
            for t, d in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                digests.append(d)
                words.append(phrases.numbers(t.as_py()))
                n += len(words[-1]) + 1
                if n >= shard_words:
                    yield flush()
                    digests, words, n = [], [], 0
        if digests:
            yield flush()
        give_back()

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with all their columns, texts without the spans that contamination() finds in them; what a cut brings together
    is not searched again."""
    at = docs.columns.index("text")

    def cleaned(t: str | None, s: list[dict] | None) -> str | None:
        return cut(t, merged(s, len(fold_words(t)))) if s else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            spans = batch.column(batch.num_columns - 2).to_pylist()
            texts = batch.column(at)
            if any(spans):
                texts = pa.array((cleaned(t.as_py(), s) for t, s in zip(texts, spans, strict=True)), pa.string(), size=len(texts))
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns[:-2])], docs_columns)

    docs_columns = docs.columns
    return _with_hits(docs, benchmark, window, shard_words, block_chars).mapInArrow(run, docs.schema)


def op10_fm_index(spark, sf_dir: str) -> DataFrame:
    """Contract query: hits of benchmark windows in every whole document."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, bench)
    items = F.array_join(F.col("items").cast("array<string>"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], bench: list[tuple], window: int = WINDOW) -> dict:
    """The rule written out for small inputs: doc_id to (n_words, n_hit, item ids)."""
    out = {}
    for d, text in docs:
        words, hit, items = [w.lower() for w in _WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))], set(), set()
        for item, phrase in bench:
            p = _WORD.findall((phrase or "").translate({i: i + 32 for i in range(65, 91)}))
            k = min(window, len(p))
            for i in range(len(p) - k + 1 if k else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == p[i : i + k]:
                        hit.update(range(j, j + k))
                        items.add(item)
        out[d] = (len(words), len(hit), sorted(items, key=str), hashlib.sha256(",".join(map(str, sorted(items, key=str))).encode()).hexdigest())
    return out
