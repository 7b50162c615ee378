"""k-mers by bins of a numeric track, with near k-mers counted in part, and what they tell about classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.arrays import Slice, _words, by_slice, counted, pooled_counts, slices, word_counts

BUCKETS = 4096
DIGITS = 9
POOLED = 500_000  # counts of classes' words that go to all tasks at most


def track_words(s: DataFrame, k: int) -> DataFrame:
    """(seq_id, word, mean, cnt, last) of s (seq_id, seq, numbers array<double>, one for each character): each sequence's k-mers with the
    mean of their numbers, to nine digits, equal ones counted; last tells how many of them end the sequence. A sequence whose
    numbers are not as many as its characters raises ValueError."""
    kind = s.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lists = batch.column(2).slice(part.first, len(part.length))
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
                if (sizes != part.length).any():
                    raise ValueError("a sequence and its numbers differ in length")
                numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                yield from _counted(part, numbers, k, batch.column(0))

    return s.select("seq_id", "seq", "numbers").mapInArrow(run, f"seq_id {kind}, word string, mean double, cnt long, last long")


def _counted(part: Slice, numbers: np.ndarray, k: int, ids: pa.Array):
    n = len(part.chars) - k + 1
    at = np.flatnonzero(part.row[: max(n, 0)] == part.row[k - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(at):
        return
    mean = np.round(sum(numbers[at + i] for i in range(k)) / k, DIGITS)
    own, value = np.unique(mean, return_inverse=True)
    letters, code = np.unique(part.chars, return_inverse=True)
    key = part.row[at]
    for i in range(k):
        key = np.unique(key * len(letters) + code[at + i], return_inverse=True)[1]
    key = key * len(own) + value
    ends = part.place()[at] + k == part.length[part.row[at]]
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    last = np.bincount(which, weights=ends, minlength=len(first)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(part.row[at[first]] + part.first)), _words(part.chars, at[first], tuple(range(k))), pa.array(mean[first]), pa.array(count), pa.array(last)], ["seq_id", "word", "mean", "cnt", "last"])


def boundaries(words: DataFrame, bins: int) -> DataFrame:
    """(bin, bound): the means at ranks int(i n / bins) - 1, i from 1 to bins, of all windows but each sequence's last.

    Equal means are counted first; ranks are found in two steps, in which of `BUCKETS` equal ranges they lie and where in it, so that
    no task sorts all means.
    """
    v = words.groupBy(F.col("mean").alias("v")).agg(F.sum(F.col("cnt") - F.col("last")).alias("c")).where("c > 0")
    span = v.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    at = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) * BUCKETS))
    v = v.join(F.broadcast(span)).select("v", "c", at.alias("bucket"))
    count = v.groupBy("bucket").agg(F.sum("c").alias("c"))
    count = count.select("bucket", "c", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("before"))
    rank = F.greatest(F.lit(0), F.floor(F.col("n") / bins * F.col("bin")) - 1)
    want = span.select("n", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select("bin", rank.alias("rank"))
    found = F.broadcast(want).join(count, (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("bin", "rank", "bucket", "before")
    own = F.sum("c").over(Window.partitionBy("bin").orderBy("v"))
    inside = v.join(F.broadcast(found), "bucket").select("bin", "rank", "before", "v", "c", own.alias("upto"))
    return inside.where((F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("before") + F.col("upto"))).select("bin", F.col("v").alias("bound"))


def binned_counts(s: DataFrame, k: int, bins: int) -> DataFrame:
    """(seq_id, bin, kmer, cnt): k-mers by the bin, from 0, of their numbers' mean: the first bound that it does not exceed, else the
    last bin. One row of bounds, one for each bin, goes to all tasks."""
    words = track_words(s, k)
    bounds = boundaries(words, bins).agg(F.sort_array(F.collect_list(F.struct("bin", "bound"))).alias("bounds"))
    above = F.size(F.filter("bounds", lambda b: (b["bin"] < bins) & (F.col("mean") > b["bound"])))
    return words.join(F.broadcast(bounds)).groupBy("seq_id", above.alias("bin"), F.col("word").alias("kmer")).agg(F.sum("cnt").alias("cnt"))


def mismatch_counts(counts: DataFrame, alphabet: str, weight: float) -> DataFrame:
    """(seq_id, kmer, cnt): each k-mer of counts (seq_id, kmer, cnt), and by `weight` of its count each k-mer that one replaced letter of the
    alphabet makes of it. Near k-mers are laid out from counts, not from positions."""
    letters = F.array(*map(F.lit, alphabet))
    places = F.sequence(F.lit(1), F.length("kmer"))
    near = F.flatten(F.transform(places, lambda i: F.transform(F.filter(letters, lambda c: c != F.substr("kmer", i, F.lit(1))), lambda c: F.concat(F.substr("kmer", F.lit(1), i - 1), c, F.substr("kmer", i + 1)))))
    own = counts.select("seq_id", "kmer", F.col("cnt").cast("double").alias("cnt"))
    others = counts.select("seq_id", F.explode(near).alias("kmer"), (F.col("cnt") * weight).alias("cnt"))
    return own.unionByName(others).groupBy("seq_id", "kmer").agg(F.sum("cnt").alias("cnt"))


def normalised(counts: DataFrame, how: str, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """counts with `value`: cnt over the sum ("frequency"), over the length of the vector ("unitsphere"), or its place between the least
    and the largest ("range", 0 where they are equal), among the rows that agree in `by`."""
    w = Window.partitionBy(*by)
    c, low, high = F.col("cnt"), F.min("cnt").over(w), F.max("cnt").over(w)
    values = {"frequency": F.try_divide(c, F.sum("cnt").over(w)), "unitsphere": F.try_divide(c.cast("double"), F.sqrt(F.sum(c * c).over(w))), "range": F.try_divide((c - low).cast("double"), high - low)}
    return counts.withColumn("value", F.coalesce(values[how].cast("double"), F.lit(0.0)))


def information_difference(s: DataFrame, ks: tuple[int, ...], most: int = POOLED) -> DataFrame:
    """(seq_id, class, k, value): D(X + S) - D(X) - D(S) of each sequence's k-mer counts X and each class's pooled counts S, with
    D(v) = sum log2 sum - sum of v log2 v; three digits.

    A k-mer that X lacks adds to D(X + S) what it adds to D(S), so only X's own k-mers meet the classes' counts. Up to `most` pooled
    counts go to all tasks, where each sequence's sums are made beside its counts; above that they are joined by a shuffle.
    """
    shapes = [tuple(range(k)) for k in ks]
    place = F.element_at(F.array(*map(F.lit, ks)), F.col("shape") + 1)
    pooled = pooled_counts(s, shapes, "label").select(F.col("label").alias("class"), place.alias("k"), "word", F.col("cnt").alias("s"))
    plogp = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    some = pooled.limit(most + 1).toArrow()
    few = len(some) <= most
    if few:  # the sequences are not counted once more
        pooled = s.sparkSession.createDataFrame(some)
    whole = pooled.groupBy("class", "k").agg(F.sum("s").alias("n"), F.sum(plogp(F.col("s"))).alias("inner"))
    if few:
        found = _sums_beside(s, ks, some).join(F.broadcast(whole), ["class", "k"])
    else:
        x = word_counts(s, shapes).select("seq_id", place.alias("k"), "word", "cnt", "total")
        each = x.join(whole, "k").join(pooled, ["class", "k", "word"], "left")
        s_cnt = F.coalesce("s", F.lit(0))
        more = F.sum(plogp(F.col("cnt") + s_cnt) - plogp(s_cnt))
        found = each.groupBy("seq_id", "class", "k", "n", "inner", "total").agg(more.alias("more"), F.sum(plogp(F.col("cnt"))).alias("own"))
    both = plogp(F.col("n") + F.col("total")) - F.col("inner") - F.col("more")
    value = both - (plogp(F.col("total")) - F.col("own")) - (plogp(F.col("n")) - F.col("inner"))
    return found.select("seq_id", "class", "k", F.round(value, 3).alias("value"))


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1))


def _sums_beside(s: DataFrame, ks: tuple[int, ...], pooled: pa.Table) -> DataFrame:
    """(seq_id, class, k, total, more, own): what each sequence's words add to the sums of each class that has words of the length."""
    kinds = s.schema["label"].dataType.simpleString()
    classes = pc.unique(pooled["class"]) if len(pooled) else pa.array([], pooled["class"].type)
    words = pa.chunked_array([pc.unique(pooled["word"])]).combine_chunks() if len(pooled) else pa.array([], pa.string())
    table = np.zeros((len(words) + 1, len(classes)))
    if len(pooled):
        table[pc.index_in(pooled["word"], words).to_numpy(), pc.index_in(pooled["class"], classes).to_numpy()] = pooled["s"].to_numpy()
    logs = _plogp(table)
    there = [[bool(len(pooled)) and bool((table[:-1][pc.equal(pc.utf8_length(words), k).to_numpy(zero_copy_only=False), c] > 0).any()) for c in range(len(classes))] for k in ks]

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        row, shape, own, count, total = counted(part, [tuple(range(k)) for k in ks])
        at = pc.fill_null(pc.index_in(own, words), len(words)).to_numpy()
        key, count = row * len(ks) + shape, count.astype(float)
        groups, first = np.unique(key, return_index=True)
        size = len(part.length) * len(ks)
        mine = np.bincount(key, _plogp(count), size)[groups]
        out: list[list] = [[], [], [], [], [], []]
        for c in range(len(classes)):
            more = np.bincount(key, _plogp(count + table[at, c]) - logs[at, c], size)[groups]
            has = np.flatnonzero(np.array([t[c] for t in there])[groups % len(ks)])
            for column, x in zip(out, (groups[has] // len(ks), np.full(len(has), c), np.array(ks, np.int32)[groups[has] % len(ks)], total[first[has]], more[has], mine[has]), strict=True):
                column.append(x)
        if not out[0]:
            return np.empty(0, np.int64), [pa.array([], classes.type), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
        rows, c, k, *rest = (np.concatenate(x) for x in out)
        return rows, [classes.take(pa.array(c)), *map(pa.array, (k, *rest))]

    return by_slice(s, ("seq_id",), f"class {kinds}, k int, total long, more double, own double", rule)
