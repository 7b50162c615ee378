"""Best-fit packing of tokenized documents: linear grouping, configurations of few sizes, substitution, then best fit."""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import saved, texts

CAPACITY = 2048
GROUPS = 64  # of equal cardinality for the large lengths
SMALL_SHARE = 8  # lengths under capacity / SMALL_SHARE are small
RANK_ROWS = 20_000
_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]+")
_GENERATION = 600_000  # words; two generations are held


class WordIds(dict):
    """Bytes of the token ids (little-endian unsigned 32 bits) of each blank-separated word.

    The tokenizer never joins text across white space, so a text's ids are its words' ids in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        """A word of the generation before moves to this one."""
        found = self[word] = self.before[word]
        return found

    def learn(self, words: set[str]) -> None:
        """Adds the words: letters and a tail of ASCII punctuation are two pieces to the tokenizer, others are encoded whole. A full
        generation replaces the one before, so words that come often are never learnt anew."""
        if len(self) > _GENERATION:
            self.before = dict(self)
            self.clear()
        before = self.before
        new = [w for w in words if w not in self and w not in before]
        parts, whole = [], []
        for w in new:
            stem = w.rstrip(string.punctuation)
            low = stem.lower()
            if stem.isalpha() and low.isalpha() and "\u03a3" not in stem:  # a final sigma would depend on its place
                parts.append((w, low, w[len(stem) :]))
            else:
                whole.append(w)
        whole += {tail for _, _, tail in parts if tail and tail not in self and tail not in before}
        for i in range(0, len(whole), 20_000):
            some = whole[i : i + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self[w] = np.array(e.ids, "<u4").tobytes()
        stems = [s for s in {low for _, low, _ in parts} if s not in self and s not in before]
        for i in range(0, len(stems), 2_000):
            # every word of letters ends with just one end-of-word token
            some = stems[i : i + 2_000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            data, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            for w, x, y in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                self[w] = data[x:y]
        for w, low, tail in parts:
            self[w] = self[low] + self[tail] if tail else self[low]


def _split(text: str) -> list[str]:
    """Words between white space; the separators U+001C to U+001F are white space to Python but not to the tokenizer."""
    return _BLANK.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


_LOADED: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _LOADED.setdefault(path, WordIds(path)) if path not in _LOADED else _LOADED[path]
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            ids, all_texts = batch.column(0), texts(batch)
            rows, piece, start, length, crc = [], [], [], [], []
            done: dict[str | None, tuple] = {}  # equal texts of a batch have equal pieces
            for at in range(0, len(all_texts), 256):
                fresh = {t: _split(t) if t else [] for t in dict.fromkeys(all_texts[at : at + 256]) if t not in done}
                cache.learn({w for ws in fresh.values() for w in ws})
                for t, ws in fresh.items():
                    data = b"".join(map(cache.__getitem__, ws)) + end
                    parts = [data[p : p + step] for p in range(0, len(data), step)]
                    done[t] = [len(x) // 4 for x in parts], [zlib.crc32(x) for x in parts]
                for i, t in enumerate(all_texts[at : at + 256], at):
                    sizes, sums = done[t]
                    rows += [i] * len(sizes)
                    piece += range(len(sizes))
                    start += range(0, capacity * len(sizes), capacity)
                    length += sizes
                    crc += sums
            cols = [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _columns(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, from the linear program by column generation."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        for r, y in zip(sizes.tolist(), price.tolist(), strict=True):
            if y > 1e-12:
                for _ in range(capacity // r):
                    np.maximum(best[r:], best[:-r] + y, out=best[r:])
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while best[room] > 1e-9:
            fits = np.flatnonzero(sizes <= room)
            g = fits[np.argmax(best[room - sizes[fits]] + price[fits])]
            column[g] += 1
            room -= int(sizes[g])
        use, way = inverse @ need, inverse @ column
        ratio = np.where(way > 1e-9, np.maximum(use, 0) / np.maximum(way, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, need)
    return [(basis[:, j], float(use[j])) for j in range(k)]


class Bins:
    """Kinds of sequences: what each holds [(length, count)], how many there are; found by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple, int]]] = {}
        self.rooms: list[int] = []

    def add(self, holds: tuple, many: int, room: int) -> None:
        if many > 0:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append((holds, many))

    def best_fit(self, length: int, count: int) -> None:
        """Puts items one after the other where the least room is left; alike sequences are filled together."""
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                room, holds, many = self.capacity, (), count
            else:
                room = self.rooms[i]
                holds, many = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(i)
            each = room // length
            full = min(many, count // each)
            self.add((*holds, (length, each)), full, room - each * length)
            count -= full * each
            if full < many and count:
                part = min(count, each)
                self.add((*holds, (length, part)), 1, room - part * length)
                count -= part
                full += 1
            if holds:
                self.add(holds, many - full, room)


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple, int]]:
    """Kinds of sequences for a histogram of lengths: [(((length, count), ...), how many sequences)].

    The histogram has at most `capacity` entries whatever the corpus, so this small program runs on the driver.
    """
    bins = Bins(capacity)
    bins.add(((capacity, 1),), lengths.get(capacity, 0), 0)
    limit = max(2, capacity // SMALL_SHARE)
    large = sorted(((x, n) for x, n in lengths.items() if limit <= x < capacity and n), reverse=True)
    total = sum(n for _, n in large)
    rest: dict[int, int] = {x: n for x, n in lengths.items() if 0 < x < limit and n}
    if total:
        # groups of equal cardinality from the largest down; each is rounded up to its first length
        share, own, members = -(-total // groups), 0, [[]]
        for x, n in large:
            while n:
                take = min(n, share - own)
                members[-1].append([x, take])
                n, own = n - take, own + take
                if own == share:
                    members.append([])
                    own = 0
        members = [m for m in members if m]
        merged: list[list] = []
        for m in members:
            if merged and merged[-1][0][0] == m[0][0]:
                merged[-1] += m
            else:
                merged.append(m)
        sizes = np.array([m[0][0] for m in merged])
        need = np.array([sum(n for _, n in m) for m in merged], float)
        for column, use in _columns(sizes, need, capacity):
            many = int(use + 1e-6)
            # its smallest place stays open: best fit finds an actual document that uses up what rounding has left
            slots = [g for g in np.flatnonzero(column) for _ in range(int(column[g]))][:-1]
            while many > 0 and slots:
                # actual lengths take the rounded ones' places: as many alike sequences as the runs allow
                want = {g: slots.count(g) for g in slots}
                if any(sum(n for _, n in merged[g]) < c for g, c in want.items()):
                    break
                heads, run = [], many
                for g, c in want.items():
                    x, n = merged[g][0]
                    if n >= c:
                        heads.append((x, c, g))
                        run = min(run, n // c)
                    else:
                        run, left, at = 1, c, 0
                        while left:
                            y, m = merged[g][at]
                            heads.append((y, min(left, m), g))
                            left, at = left - min(left, m), at + 1
                for x, c, g in heads:
                    entry = next(e for e in merged[g] if e[0] == x)
                    entry[1] -= c * run
                for g in want:
                    merged[g] = [e for e in merged[g] if e[1]]
                bins.add(tuple((x, c) for x, c, _ in heads), run, capacity - sum(x * c for x, c, _ in heads))
                many -= run
        for m in merged:
            for x, n in m:
                rest[x] = rest.get(x, 0) + n
    for x in sorted(rest, reverse=True):
        bins.best_fit(x, rest[x])
    return [kind for room in bins.rooms for kind in bins.by_room[room]]


def _slots(kinds: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, first sequence, items of this length in each, and their offset."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for holds, many in kinds:
        offset = 0
        for x, c in holds:
            out.setdefault(x, []).append((used.get(x, 0), first, c, offset))
            used[x] = used.get(x, 0) + many * c
            offset += x * c
        first += many
    return {x: tuple(np.array(v, np.int64).T) for x, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end token alone; a longer document is cut into whole pieces and a last, shorter one; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored. Only the histogram of lengths (at most `capacity` rows) and
    its plan come to the driver; documents find their places by their rank among pieces of the same length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = saved(pieces, "pieces")
    lengths = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots = _slots(plan(lengths, capacity, groups))
    buckets = max(256, -(-sum(lengths.values()) // RANK_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                lo, first, each, at = sent.value[int(x)]
                i = np.searchsorted(lo, rank[rows], "right") - 1
                past = rank[rows] - lo[i]
                sequence[rows], offset[rows] = first[i] + past // each[i], at[i] + past % each[i] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's pieces and their places."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
