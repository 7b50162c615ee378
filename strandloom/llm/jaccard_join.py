"""N-gram Jaccard join by chosen paths: sets are split on sampled shared shingles, small buckets are searched whole."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import components, drop, fold_bytes, grams, hash_words, mix, saved

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999  # least chance that a pair at just SIMILARITY meets in some bucket
DEPTH, DEEP = 2, 4  # splits of every set, and of sets in large buckets of unlike ones
SMALL_SET = 64  # shingles; smaller sets could run out of tokens in deep splits and keep their large buckets as well
LIMIT = 1024  # members of a small bucket
BLOCK = 256  # sets of a group that are compared together
CHUNK = 4096  # rows of small buckets that one call takes
SKETCH = 128  # bits; the sketch passes a pair at SIMILARITY but for about 1 in 30,000
SLACK = 4  # standard deviations
BROADCAST_KEYS = 250_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a shorter text is one shingle, one without words has none."""
    h = hash_words(fold_bytes(text))
    return np.unique(grams(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_id(x: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None


def runs_for(depth: int, recall: float) -> int:
    """Repeats until a pair at the threshold shares a path of `depth` in at least one run with chance `recall`.

    At the threshold a shared node has on average one shared child (about Poisson), so it dies out within `depth` splits
    with chance q, where q = exp(q - 1) iterated from 0.
    """
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def paths(x: np.ndarray, depth: int, runs: int, similarity: float, seed: int = 0) -> np.ndarray:
    """Keys of the nodes at `depth` that the set reaches in all runs: a node's children are its tokens whose hash, under the
    path so far, is below 1 / (similarity |x|)."""
    if not len(x):
        return np.empty(0, np.uint64)
    share = min(1.0, 1 / (similarity * len(x)))
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    node = mix(np.arange(seed * 1_000_003 + 1, seed * 1_000_003 + runs + 1, dtype=np.uint64))
    used = np.empty((len(node), 0), np.int64)
    step = max(1, 1_000_000 // len(x))  # nodes whose tokens are hashed together
    for _ in range(depth):
        new, seen = [], []
        for i in range(0, len(node), step):
            v = (x[None, :] ^ node[i : i + step, None]) * np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            row, token = np.nonzero(v < limit)
            fresh = ~(used[i + row] == token[:, None]).any(axis=1)
            row, token = i + row[fresh], token[fresh]
            new.append(mix(node[row] + x[token] * np.uint64(0x94D049BB133111EB)))
            seen.append(np.hstack([used[row], token[:, None]]))
        if not new:
            break
        node, used = np.concatenate(new), np.concatenate(seen)
    return np.unique(node)


_MULTIPLIERS = (mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(x: np.ndarray) -> tuple[int, int]:
    """A bit of the least hash under each of SKETCH functions of 32 bits, as two longs."""
    if not len(x):
        return 0, 0
    short = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, (short[None, i : i + 1024] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    bits = np.packbits(((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def far_bits(similarity: float) -> int:
    """Bits in which two sketches may differ: the expectation at the threshold and SLACK standard deviations."""
    p = (1 - similarity) / 2
    return int(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


def _described(words: int, depth: int, runs: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                x = shingles(text, words)
                rows.append((set_id(x), len(x), *sketch(x), paths(x, depth, runs, similarity).view(np.int64)))
            cols = [batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "id", "size", "s0", "s1", "keys"])

    return run


def _deeper(words: int, depth: int, runs: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [paths(shingles(t, words), depth, runs, similarity, seed=1).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return run


def _trees(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member that links reach) that join what a symmetric matrix of links connects."""
    n = len(link)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _parts(*columns: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order that brings equal rows of the columns together, and where each run of them begins and ends."""
    by = np.lexsort(columns)
    change = np.zeros(max(0, len(by) - 1), bool)
    for c in columns:
        change |= c[by][1:] != c[by][:-1]
    cut = [0, *(np.flatnonzero(change) + 1).tolist(), len(by)] if len(by) else []
    return by, list(zip(cut, cut[1:], strict=False))


def _candidates(most: int, similarity: float):
    """Buckets compared whole: trees over near sketches of sets that are in different groups so far."""

    def run(table: pa.Table) -> pa.Table:
        ids, root, size, side, key = (table[c].to_numpy() for c in ("id", "root", "size", "side", "key"))
        s0, s1 = (table[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
        by, runs = _parts(key)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in runs:
            i = by[lo:hi]
            bits = np.bitwise_count(s0[i, None] ^ s0[None, i]) + np.bitwise_count(s1[i, None] ^ s1[None, i])
            link = (bits <= most) & (root[i, None] != root[None, i])
            link &= np.minimum(size[i, None], size[None, i]) >= similarity * np.maximum(size[i, None], size[None, i])
            if (side[i] != side[i[0]]).any():
                link &= side[i, None] != side[None, i]
            if link.any():
                child, parent = _trees(link)
                a.append(ids[i[child]])
                b.append(ids[i[parent]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _compared(words: int, similarity: float):
    """Exact Jaccard of the pairs of one block, or between two blocks, of each group: links of each set, and tree edges."""

    def group(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(sets)
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        _, where = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        # shingles that only one set has say nothing about overlaps; the others are counted in slices of columns
        count = np.bincount(where)
        shared = count[where] > 1
        column = np.cumsum(count > 1) - 1
        where, owner = column[where[shared]], owner[shared]
        by = np.argsort(where, kind="stable")
        where, owner = where[by], owner[by]
        both = np.zeros((n, n), np.float32)
        width = int((count > 1).sum())
        for x in range(0, width, 4096):
            lo, hi = np.searchsorted(where, [x, x + 4096])
            part = np.zeros((n, min(4096, width - x)), np.float32)
            part[owner[lo:hi], where[lo:hi] - x] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        link = both * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
        np.fill_diagonal(link, False)
        if (side != side[0]).any():
            link &= side[:, None] != side[None, :]
        return link.astype(np.int64) @ copies, *_trees(link)

    def run(table: pa.Table) -> pa.Table:
        # a doc_id may stand before several texts: of each set the first text that hashes to its id is its own
        found, seen = [shingles(t, words) for t in table["text"].to_pylist()], set()
        keep = [i for i, (k, x) in enumerate(zip(table["id"].to_pylist(), found, strict=True)) if set_id(x) == k and not (k in seen or seen.add(k))]
        table, sets = table.take(keep), [found[i] for i in keep]
        ids, copies, side, root = (table[c].to_numpy() for c in ("id", "copies", "side", "root"))
        empty = np.empty(0, np.int64)
        own, links, a, b = [empty], [empty], [empty], [empty]
        by, runs = _parts(root)
        for lo, hi in runs:
            i = by[lo:hi]
            total, child, parent = group([sets[j] for j in i], copies[i], side[i])
            own.append(ids[i])
            links.append(total)
            a.append(ids[i[child]])
            b.append(ids[i[parent]])
        own, links, a, b = map(np.concatenate, (own, links, a, b))
        n, k = len(own), len(a)
        return pa.table([
            pa.concat_arrays([pa.array(own), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([links, np.zeros(k, np.int64)])),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(b)]),
        ], schema=_LINKS)

    return run


def _dealt(rows: DataFrame, group: str, members: Column, block: int, chunk: int) -> DataFrame:
    """Adds where rows of a group meet: groups of up to `block` members whole, several of them in one call; larger ones in
    blocks, each pair of blocks (part, x, y) in a call of its own. side is a row's block."""
    blocks = F.ceil(members / block)
    few = max(1, rows.count() // chunk)
    out = rows.withColumns({"blocks": blocks, "side": F.pmod(F.xxhash64("id"), blocks)})
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") > 1, F.col(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(few)))
    return out.withColumns({"part": part, "whole": F.col("blocks") == 1, "x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("blocks", "other")


def connect(members: DataFrame, reps: DataFrame, similarity: float, limit: int, split: bool) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) of candidates over the buckets of members (key, id): sets whose sketches are near, or trees of such.

    Every member is compared with the least and the greatest of its bucket, so that pairs grow with the members. Buckets that
    these have left in several groups are compared whole if they have at most `limit` members. Of larger ones the members
    (key, id) come back as the second value if `split` is set; else they are compared in blocks of `limit`.
    """
    most = far_bits(similarity)
    pivots = members.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p <> q")
    # a key of its own on this side: both sides are dealt anew, and a hot bucket can be split between tasks
    shared = saved(members.join(pivots.select((F.col("key") + 0).alias("key"), "p", "q"), "key"), "shared")
    payload = lambda suffix: reps.select(*[F.col(c).alias(f"{c}{suffix}") for c in ("id", "size", "s0", "s1")])
    star = shared.select("id", F.explode(F.array("p", "q")).alias("id_b")).where("id <> id_b")
    star = star.select(F.least("id", "id_b").alias("id"), F.greatest("id", "id_b").alias("id_b")).distinct()
    bits = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_b")))
    near = (bits <= most) & (F.least("size", "size_b") >= similarity * F.greatest("size", "size_b"))
    star = star.join(payload(""), "id").join(payload("_b"), "id_b").where(near).select(F.col("id").alias("a"), F.col("id_b").alias("b"))
    star = saved(star, "links")
    groups = components(star).withColumnRenamed("node", "id")
    named = saved(shared.join(groups, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "named")
    drop(shared)
    # in a bucket of three the pivots have met all
    mixed = named.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("m > 3 and low <> high")
    left = named.join(mixed.select((F.col("key") + 0).alias("key"), "m"), "key").join(reps.select("id", "size", "s0", "s1"), "id")
    left = saved(left, "left")
    large = left.where(F.col("m") > limit).select("key", "id") if split else None
    dealt = _dealt(left.where(F.col("m") <= limit) if split else left, "key", F.col("m"), limit, CHUNK)
    rest = saved(dealt.groupBy("part", "whole", "x", "y").applyInArrow(_candidates(most, similarity), "a long, b long"), "links")
    drop(named)
    return star.unionByName(rest), large


def jaccard_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Classes of docs (doc_id, text) whose shingle sets of `words` words have a Jaccard similarity of `similarity` or more.

    1. Texts with the same set are one set. Each set is split on sampled tokens, DEPTH times, in as many runs as the recall asks.
    2. In each bucket sets whose sketches are near are candidates (see connect). Buckets of more than `limit` members that hold
       unlike sets are split on, to depth DEEP in more runs; sets of few shingles stay in them as well. What is large then is
       compared in blocks, so no bucket is left out.
    3. Groups that candidates connect are compared exactly in blocks of about `block` sets, each pair of blocks a call of
       its own, so every pair within a group is decided and counted but never emitted.

    Returns a row for each row of docs: doc_id, class_id (least doc_id of the connected class), copy_id (least doc_id with the
    same set), n_links (other rows that are linked to it, copies included), digest (hash of the text) and class_key (a class's own
    number, also where two classes have the same least doc_id; null for texts without words). Texts without words, null included, are classes
    of their own with no links (class_id and copy_id are their own doc_id), and so are rows without a doc_id; repeated rows are
    copies; other columns are ignored. Sets are told apart by a 64-bit hash.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, digest long, id long, size long, s0 long, s1 long, keys array<long>"
    described = saved(own.withColumn("digest", F.xxhash64("text")).mapInArrow(_described(words, DEPTH, runs_for(DEPTH, recall), similarity), schema), "sets")
    in_classes = F.col("id").isNotNull() & F.col("doc_id").isNotNull()
    sets = described.where(in_classes)
    reps = sets.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("size", "s0", "s1")], F.first("keys").alias("keys"))
    reps = saved(reps, "sets")
    edges, large = connect(reps.select(F.explode("keys").alias("key"), "id"), reps, similarity, limit, split=True)

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of the sets' first documents."""
        at = saved(ids.join(reps, "id").select("id", F.col("rep").alias("doc_id")), "places")
        n = at.count()
        keys = at.select("doc_id")
        few = own.join(F.broadcast(keys) if n <= broadcast_keys else keys, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        return few.join(at, "doc_id").select("id", "text")

    if large.take(1):
        deep = texts_of(large.select("id").distinct()).mapInArrow(_deeper(words, DEEP, runs_for(DEEP, recall), similarity), "id long, keys array<long>")
        few = large.join(reps.where(F.col("size") < SMALL_SET).select("id"), "id").select("key", "id")
        deep = saved(deep.select(F.explode("keys").alias("key"), "id").unionByName(few).distinct(), "deep")
        edges = edges.unionByName(connect(deep, reps, similarity, limit, split=False)[0])
    groups = saved(components(edges), "groups")
    size = groups.groupBy("root").agg(F.count("*").alias("members"))
    named = groups.join(size.select((F.col("root") + 0).alias("root"), "members"), "root").withColumnRenamed("node", "id")
    dealt = _dealt(named.join(reps.select("id", "copies"), "id"), "root", F.col("members"), block, 2 * block)
    dealt = dealt.join(texts_of(groups.select(F.col("node").alias("id"))), "id")
    found = saved(dealt.groupBy("part", "whole", "x", "y").applyInArrow(_compared(words, similarity), "id long, links long, a long, b long"), "links")
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "id")
    info = reps.join(links, "id", "left").join(classes, "id", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    info = saved(info, "classes")
    drop(groups, found, reps)
    first = info.groupBy("root").agg(F.min("rep").alias("class_id"))
    info = info.join(first.select((F.col("root") + 0).alias("root"), "class_id"), "root").select((F.col("id") + 0).alias("id"), F.col("root").alias("class_key"), "class_id", F.col("rep").alias("copy_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_set = sets.select("doc_id", "digest", "id").join(info, "id").select("doc_id", "class_id", "copy_id", "n_links", "digest", "class_key")
    alone = described.where(~in_classes).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), "digest", F.lit(None).cast("long").alias("class_key"))
    return with_set.unionByName(alone)


def op1_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each_class(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates: the least by doc_id and hash of its text.

    Rows without words and rows without a doc_id stay; of repeated rows one stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = saved(jaccard_classes(docs, broadcast_keys=broadcast_keys).where("class_key is not null").select("doc_id", "digest", "class_key"), "classes")
    first = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    marks = found.groupBy("doc_id", "digest", "class_key").agg(F.count("*").alias("rows")).join(first.select((F.col("class_key") + 0).alias("class_key"), "first"), "class_key")
    marks = saved(marks.select(F.col("doc_id").alias("of"), "digest", "rows", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("kept")), "marks")
    n = marks.count()
    rows = docs.select("*", F.xxhash64("text")).toDF(*names, "digest_of_text")
    rows = rows.join(F.broadcast(marks) if n <= broadcast_keys else marks, (F.col(at).cast("long") == F.col("of")) & (F.col("digest_of_text") == F.col("digest")), "left")
    single = rows.where("kept is null or (kept and rows = 1)").select(*names)
    repeated = rows.where("kept and rows > 1").dropDuplicates([at, "digest_of_text"]).select(*names)
    return single.unionByName(repeated).toDF(*docs.columns)


def brute_force(docs: list[tuple], words: int = WORDS, similarity: float = SIMILARITY) -> dict:
    """The rule written out for small inputs: doc_id to (class_id, n_links)."""
    sets = {d: set(shingles(t, words).tolist()) for d, t in docs}
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and min(n, m) >= similarity * max(n, m):
                both = len(sets[a] & sets[b])
                if both >= similarity * (n + m - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (find(d), links[d]) for d in ids}
