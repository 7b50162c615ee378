"""Substring dedup: recurring phrases confirmed by counts, located in all documents by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import drop, grams, hash_words, mix, plain_bytes, plain_words, saved

WINDOW = 13
PHRASE = 5  # words of a sampled phrase
PART_DOCS = 128  # texts that one automaton streams, about
SHARD_DOCS = 48  # texts for each shard of passages; a shard compares stretches of several times as many
GROUP_LINKS = 4096  # phrases in documents that one group of a shard takes, about; a shard with more is cut into groups
BROADCAST_KEYS = 250_000  # so many texts at most are told to all tasks; more are joined by a shuffle


def anchors(h: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Distinct hashes of the phrases that are the least in some window: equal windows always share one."""
    g = grams(h, phrase)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = g[:n].copy()
    for i in range(1, window - phrase + 1):
        np.minimum(least, g[i : i + n], out=least)
    return np.unique(least)


def _sampled(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(hash_words(plain_bytes(t)), window, phrase) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], ["anchor", "doc_id"])

    return run


def _worded(phrase: int):
    """The words of wanted phrases, from one text that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, want = plain_bytes(text), np.array(wanted, np.int64)
                g = grams(hash_words(data), phrase).view(np.int64)
                if not len(g):
                    continue
                order = np.argsort(g)
                i = np.minimum(np.searchsorted(g[order], want), len(g) - 1)
                same = g[order[i]] == want
                words = data.split()
                names += want[same].tolist()
                found += [b" ".join(words[p : p + phrase]).decode() for p in order[i[same]].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.string())], ["anchor", "phrase"])

    return run


_PART_SQL = "shard long, salt long, salts long, doc_id long, digest long, offset int, excerpt string, at array<int>"
_PART = pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("salts", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("offset", pa.int32()), ("excerpt", pa.string()), ("at", pa.list_(pa.int32()))])


def _located(window: int, phrase: int):
    """A part of the documents and the confirmed phrases that occur somewhere in it: one automaton of the phrases, through which
    every whole text is streamed. Rows out: for each shard of phrases the stretches of words that windows around their occurrences
    span, and where in them the phrases are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = ahocorasick.Automaton(), []
        for p, s, n in zip(right["phrase"].to_pylist(), right["shard"].to_pylist(), right["salts"].to_pylist(), strict=True):
            found.add_word(f" {p} ", (len(p) + 2, s, n))
        if not len(found) or not len(left):
            return _PART.empty_table()
        found.make_automaton()
        ids, digests = left["doc_id"].to_pylist(), left["digest"].to_pylist()
        draw = left["doc_id"].to_numpy().view(np.uint64) + mix(left["digest"].to_numpy().view(np.uint64))
        draw = (mix(draw) >> np.uint64(1)).tolist()
        for d, digest, text, ticket in zip(ids, digests, left["text"].to_pylist(), draw, strict=True):
            words = plain_words(text)
            if len(words) < window:
                continue
            line = f" {b' '.join(words).decode()} "
            hits = [(end - size + 1, s, n) for end, (size, s, n) in found.iter(line)]
            if not hits:
                continue
            place, shard, salts = (np.array(x, np.int64) for x in zip(*hits, strict=True))
            # a phrase begins with the blank before its first word: the blanks' places number the words
            start = np.searchsorted(np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32), place)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                n, at = int(salts[own[0]]), np.unique(start[own])
                low = np.maximum(at - (window - phrase), 0)
                high = np.minimum(at + window, len(words))
                cut = [0, *(np.flatnonzero(low[1:] > high[:-1]) + 1).tolist(), len(low)]
                for x, y in zip(cut, cut[1:], strict=False):
                    first = int(low[x])
                    rows.append((s, ticket % n, n, d, digest, first, b" ".join(words[first : int(high[y - 1])]).decode(), at[x:y] - first))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PART)], schema=_PART)

    return run


def _starts(at: list[int], n_words: int, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows of a stretch that hold a phrase at one of its places."""
    n = n_words - window + 1
    if n <= 0 or not at:
        return np.empty(0, np.int64)
    start = np.array(at, np.int64)
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, np.minimum(np.maximum(start - (window - phrase), 0), n), 1)
    last = start + 1
    np.add.at(reach, last[last <= n], -1)
    return np.flatnonzero(np.cumsum(reach[:n]) > 0)


def _ranges(cover: np.ndarray, offset: int = 0) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))) + offset
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("spans", _SPAN), ("shard", pa.int64()), ("salt", pa.int64()), ("passage", pa.int64()), ("first", pa.int64())])
_FOUND_SQL = "kind int, doc_id long, digest long, spans array<struct<start:int,end:int>>, shard long, salt long, passage long, first long"


def _stream(window: int, phrase: int, known: bool):
    """One group of a shard: the first document of each window around its phrases; with known=True the other side tells the
    first documents of passages that other groups have.

    Rows out: kind 1, words of a document to remove; 2, of a shard in several groups, each passage with this group's first
    document.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lines, ids = right["excerpt"].to_pylist(), right["doc_id"].to_numpy()
        words = [hash_words(t.encode()) for t in lines]
        starts = [_starts(at, len(w), window, phrase) for at, w in zip(right["at"].to_pylist(), words, strict=True)]
        hashes = [grams(w, window)[s] if len(s) else np.empty(0, np.uint64) for w, s in zip(words, starts, strict=True)]
        flat, doc = np.concatenate([*hashes, np.empty(0, np.uint64)]).view(np.int64), np.repeat(ids, [len(s) for s in starts])
        if known:
            flat = np.concatenate([flat, left["passage"].to_numpy()])
            doc = np.concatenate([doc, left["first"].to_numpy()])
        passage, where = np.unique(flat, return_inverse=True)
        first = np.full(len(passage), np.iinfo(np.int64).max)
        np.minimum.at(first, where, doc)
        if len(right) and right["salts"][0].as_py() > 1 and not known:
            k = len(passage)
            table = {"kind": pa.array([2] * k, pa.int32()), "shard": pa.array([right["shard"][0].as_py()] * k, pa.int64()), "salt": pa.array([right["salt"][0].as_py()] * k, pa.int64()), "passage": pa.array(passage), "first": pa.array(first)}
            return pa.table([table.get(f.name, pa.nulls(k, f.type)) for f in _FOUND], _FOUND)
        rows, at = [], 0
        digests, offsets = right["digest"].to_pylist(), right["offset"].to_pylist()
        for i, w in enumerate(words):
            late = starts[i][first[where[at : at + len(starts[i])]] < ids[i]]
            at += len(starts[i])
            if len(late):
                cover = np.zeros(len(w) + 1, np.int32)
                np.add.at(cover, late, 1)
                np.add.at(cover, late + window, -1)
                rows.append((int(ids[i]), digests[i], _ranges(np.cumsum(cover[:-1]) > 0, offsets[i])))
        k = len(rows)
        table = {"kind": pa.array([1] * k, pa.int32()), **{n: pa.array([r[i] for r in rows], _FOUND.field(n).type) for i, n in enumerate(("doc_id", "digest", "spans"))}}
        return pa.table([table.get(f.name, pa.nulls(k, f.type)) for f in _FOUND], _FOUND)

    return run


def _finish(window: int):
    """Rows (doc_id, text, spans or null, whether an earlier document has the same text) to finished documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [plain_words(t) for t in batch.column(1).to_pylist()]
            merged, kept = [], []
            for w, s, copy in zip(words, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cover = np.zeros(len(w), bool)
                for x in s or ():
                    cover[x["start"] : x["end"]] = True
                if copy and len(w) >= window:
                    cover[:] = True
                merged.append(_ranges(cover))
                kept.append(b" ".join([x for x, c in zip(w, cover.tolist(), strict=True) if not c] if merged[-1] else w).decode())
            cols = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(merged, _SPAN), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spans", "text_kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, part_docs: int = PART_DOCS, shard_docs: int = SHARD_DOCS, group_links: int = GROUP_LINKS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Removes words covered by a window of `window` words that also starts in a document with a smaller doc_id.

    1. Of each window its least phrase (by hash) is sampled; a phrase that two documents share is confirmed as recurring. Of
       equal texts only the first document takes part: the later ones lose all their words, if they have a window.
    2. The documents are dealt to parts of about `part_docs`, and each confirmed phrase goes to the parts in which it was sampled. Each
       part compiles an Aho-Corasick automaton of its phrases and streams all its whole texts through it, which locates every occurrence.
    3. Phrases belong to shards by the first document that has them. The stretches around occurrences go to the phrases' shards,
       where whole windows (64-bit hashes of all their words) are compared for the first document that has them; a shard with
       many links is cut into groups by document.

    A window without a confirmed phrase is not repeated, so words outside the stretches stay. Returns a row for each row of
    docs (doc_id, text): doc_id, n_words, spans (removed word ranges, end exclusive), text_kept (kept words joined by one
    blank). Null and empty texts have no words and an empty text_kept; equal doc_ids do not precede each other; repeated
    rows are all returned; rows without a doc_id keep their words and take part in nothing; a doc_id must be an integer;
    other columns are ignored.
    """
    own_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    first = own_docs.where("doc_id is not null and text is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    first = saved(first, "texts")
    n_texts = first.count()
    told = lambda t, n: F.broadcast(t) if n <= broadcast_keys else t
    once = own_docs.join(told(first.drop("rows"), n_texts), "digest").where("doc_id = first").select("doc_id", "digest", "text")
    repeated = own_docs.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("digest").distinct()
    repeated = saved(repeated, "repeated")
    n_repeated = repeated.count()
    if n_repeated:
        more = once.join(told(repeated, n_repeated), "digest", "left_semi").dropDuplicates(["digest"])
        once = once.join(told(repeated, n_repeated), "digest", "left_anti").unionByName(more)
    sampled = saved(once.select("doc_id", "text").mapInArrow(_sampled(window, phrase), "anchor long, doc_id long"), "anchors")
    recurring = sampled.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("other"), F.count("*").alias("n")).where("source < other")
    shards = max(64, n_texts // shard_docs)
    recurring = saved(recurring.select("anchor", "source", "n", F.pmod(F.xxhash64("source"), F.lit(shards)).alias("shard")), "recurring")
    load = recurring.groupBy("shard").agg(F.ceil(F.sum("n") / group_links).alias("salts"))
    wanted = recurring.groupBy("source").agg(F.collect_list("anchor").alias("anchors")).withColumnRenamed("source", "doc_id")
    worded = once.join(wanted, "doc_id").select("text", "anchors").mapInArrow(_worded(phrase), "anchor long, phrase string").dropDuplicates(["anchor"])
    worded = worded.join(recurring, "anchor").join(F.broadcast(load) if shards <= broadcast_keys else load, "shard")
    # a key of its own on this side: both sides are dealt anew, and a hot phrase can be split between tasks
    worded = saved(worded.select((F.col("anchor") + 0).alias("anchor"), "phrase", "shard", "salts"), "phrases")
    parts = max(8, n_texts // part_docs)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    there = sampled.join(worded, "anchor").select(part, "phrase", "shard", "salts")
    texts = once.select(part, "doc_id", "digest", "text")
    stretches = texts.groupBy("part").cogroup(there.groupBy("part")).applyInArrow(_located(window, phrase), _PART_SQL)
    stretches = saved(stretches, "parts")
    drop(sampled, recurring, worded)

    def streamed(documents: DataFrame, told: DataFrame | None) -> DataFrame:
        known = told is not None
        blank = documents.select("shard", "salt", F.lit(0).cast("long").alias("passage"), F.lit(0).cast("long").alias("first")).where(F.lit(False))
        told = (told if known else blank).select(*[F.col(c).alias(c) for c in ("shard", "salt", "passage", "first")])
        return told.groupBy("shard", "salt").cogroup(documents.groupBy("shard", "salt")).applyInArrow(_stream(window, phrase, known), _FOUND_SQL)

    seen = saved(streamed(stretches, None), "passages")
    # a shard that was cut into groups: the first document of each passage over all of them goes back to where it matters
    passages = seen.where("kind = 2").select("shard", "salt", "passage", "first")
    overall = passages.groupBy("shard", "passage").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    back = passages.join(overall, ["shard", "passage"]).where("least < first").select("shard", "salt", "passage", F.col("least").alias("first"))
    second = streamed(stretches.where("salts > 1"), back)
    spans = seen.where("kind = 1").unionByName(second.where("kind = 1")).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # what is known of each text that is not kept as it is
    marked = first.where("rows > 1").select("digest", "first").join(spans, "digest", "full_outer")
    marked = saved(marked, "spans")
    drop(stretches, seen, repeated)
    n = marked.count()
    whole = own_docs.join(told(marked, n), "digest", "left")
    whole = whole.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
    return whole.mapInArrow(_finish(window), "doc_id long, n_words long, spans array<struct<start:int,end:int>>, text_kept string")


def op9_aho_corasick(spark, sf_dir: str) -> DataFrame:
    """Contract query: what each document keeps, as a digest."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text_kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> dict:
    """The rule written out for small inputs: doc_id to (n_words, n_removed, digest of what is kept)."""
    first: dict[tuple, int] = {}
    split = [(d, plain_words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out
