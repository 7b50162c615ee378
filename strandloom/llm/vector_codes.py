"""Vector code compression: product codebooks by Lloyd's rounds in which the parts of vectors reside with their entry's owner.

Vectors are cut into parts. A part lives with the owner (position, entry, salt) of the entry that it is nearest to, in a table that is
bucketed by owner. In each round the owners' sums give the new entries; members are held against them where they reside; and only
members whose entry has changed are shuffled: the owners take them in and let the others go, bucket by bucket, without a shuffle of
those that stay. After the first round the owners' sums change by the movers alone. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import drop, mix, saved, shared_dir

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
RESIDENTS = 1 << 19  # rows whose parts of one position share a salt, so that no owner has more members whatever the vectors
_CHUNK = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties to the lower) and the squared distance, exact in integers."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return index, distance
    top = 4 * x.shape[1] * int(max(abs(x).max(), abs(book).max())) ** 2
    if top >= 1 << 63:
        raise ValueError("components are too large for squared distances in 64 bits")
    if top < 1 << 53:  # all terms are whole numbers that doubles hold exactly
        book = book.astype(float)
        own = (book * book).sum(axis=1)
    for at in range(0, len(x), _CHUNK):
        some = x[at : at + _CHUNK]
        if top < 1 << 53:
            some = some.astype(float)
            d = (own - 2 * (some @ book.T)) + (some * some).sum(axis=1)[:, None]
        else:
            d = np.stack([((some - c) ** 2).sum(axis=1) for c in book], axis=1)
        best = d.argmin(axis=1)
        index[at : at + len(some)], distance[at : at + len(some)] = best, d[np.arange(len(some)), best]
    return index, distance


def _cut(v: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width) of (rows, components): consecutive parts, padded with zeros where the components don't divide evenly."""
    pieces = np.array_split(v, parts, axis=1)
    width = max(1, pieces[0].shape[1])
    return np.stack([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in pieces], axis=1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).astype(np.int32)))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component x as double. Null or empty vectors go, and so do those that hold nulls
    or anything but finite numbers; a table without labels has null ones."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    kept = vectors.select("vec_id", label.alias("label"), x.alias("x")).where("x is not null and size(x) > 0").where(~bad)
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _resident(df: DataFrame, buckets: int) -> DataFrame:
    """Writes members to a table bucketed by owner in the shared folder and reads it back."""
    spark, name = df.sparkSession, f"members_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, "owner").sortBy("owner").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.saved_path, out.name = path, name
    return out


def _leave(members: DataFrame) -> None:
    members.sparkSession.sql(f"drop table {members.name}")
    drop(members)


def _totals(members: DataFrame, slots: int, of_slot, width: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the members of each entry: a row for each entry and task is shuffled, as many rows as there
    are entries come to the driver. A member with weight -1 is taken off."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slots, width + 1), np.int64)
        for batch in batches:
            at, weight = of_slot(batch.column(0).to_numpy()), batch.column(1).to_numpy().astype(np.int64)
            np.add.at(total, at, np.column_stack([weight, _matrix(batch.column(2)) * weight[:, None]]))
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c) for c in total[at].T)], ["slot", *names])

    names = [f"s{i}" for i in range(width + 1)]
    rows = members.mapInArrow(add, ", ".join(f"{c} long" for c in ("slot", *names)))
    rows = rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return {r[0]: (r[1], list(r[2:])) for r in rows}


def compress(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, residents: int = RESIDENTS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of integer vectors (vec_id, label, v array<long>), and the codebooks [part][entry][component].

    Returns vec_id, label, code (array<int>, an entry for each part) and error (squared distances summed over the parts), a row for each
    row. Codebooks begin as the parts of the `entries` smallest vec_ids, ascending: equal ids by vector, null ids last; a table with
    fewer rows has fewer entries. A part belongs to the nearest entry, of equally near ones the first; entries without parts stay.
    Components that the parts do not divide evenly make the first parts one longer. Vectors of another length than the first one's
    are left out. Repeated rows count each; an empty table gives no rows and empty codebooks. Components over about 2^28 raise
    ValueError.
    """
    spark = kept.sparkSession
    base = saved(kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "v"), "vectors")
    first = base.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    columns = "key long, part_of int, entry int, distance long"
    if not first:
        return base.select("vec_id", "label", F.expr("cast(array() as array<int>)").alias("code"), F.lit(0).cast("long").alias("error")), [[] for _ in range(parts)]
    size = len(first[0]["v"])
    mine = base.where(F.size("v") == size)
    start = _cut(np.array([r["v"] for r in mine.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64), parts)
    books = [start[:, p] for p in range(parts)]
    many, width = len(start), start.shape[2]
    salts = -(-mine.count() // residents)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, v = batch.column(0).to_numpy(), _cut(_matrix(batch.column(1)), parts)
            salt = (mix(keys.astype(np.uint64)) % np.uint64(salts)).astype(np.int64)
            for p in range(parts):
                entry, _ = nearest(v[:, p], sent.value[p])
                yield pa.RecordBatch.from_arrays([pa.array((p * many + entry) * salts + salt), batch.column(0), _lists(v[:, p])], ["owner", "key", "part"])

    def looked_at(batch: pa.RecordBatch) -> Iterator[tuple]:
        """The members of each position in a batch: rows, position, entry, part, nearest entry now, its distance."""
        slot, x = batch.column(0).to_numpy() // salts, _matrix(batch.column(2))
        for p in np.unique(slot // many).tolist():
            rows = np.flatnonzero(slot // many == p)
            entry, distance = nearest(x[rows], sent.value[p])
            yield rows, p, slot[rows] % many, x[rows], entry, distance

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy()
            for rows, p, was, x, entry, _ in looked_at(batch):
                on = np.flatnonzero(was != entry)
                if len(on):
                    old = owner[rows[on]]
                    new = (p * many + entry[on]) * salts + old % salts
                    yield pa.RecordBatch.from_arrays([pa.array(old), pa.array(new), batch.column(1).take(pa.array(rows[on])), _lists(x[on])], ["owner", "to", "key", "part"])

    def take_in(stay: pa.Table, came: pa.Table) -> pa.Table:
        """An owner's members: those that do not go, and those that come."""
        goes = came["part"].is_null().to_numpy() if len(came) else np.empty(0, bool)
        if goes.any():
            stay = stay.filter(pa.array(~np.isin(stay["key"].to_numpy(), came["key"].to_numpy()[goes])))
        return pa.concat_tables([stay, came.filter(pa.array(~goes)).cast(stay.schema)]) if len(came) else stay

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, p, _, _, entry, distance in looked_at(batch):
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array([p] * len(rows), pa.int32()), pa.array(entry.astype(np.int32)), pa.array(distance)], ["key", "part_of", "entry", "distance"])

    def of_slot(owner: np.ndarray) -> np.ndarray:
        return owner // salts

    member = "owner long, key long, part array<int>"
    sent = spark.sparkContext.broadcast(books)  # parts * entries * components of a part, whatever the table
    members = _resident(mine.select("key", "v").mapInArrow(settle, member).repartition(buckets, "owner"), buckets)
    sums: dict[int, tuple[int, list[int]]] = {}
    came = members.select("owner", F.lit(1).alias("weight"), "part")
    for r in range(rounds):
        for slot, (n, total) in _totals(came, parts * many, of_slot, width).items():
            was = sums.get(slot, (0, [0] * width))
            sums[slot] = was[0] + n, [a + b for a, b in zip(was[1], total, strict=True)]
        books = [b.copy() for b in books]
        for slot, (n, total) in sums.items():
            if n:
                books[slot // many][slot % many] = [t // n for t in total]
        sent = spark.sparkContext.broadcast(books)
        if r == rounds - 1:
            break
        movers = saved(members.mapInArrow(move, "owner long, to long, key long, part array<int>"), "movers")
        if not movers.head(1):  # nothing moves any more: neither members nor entries would change
            drop(movers)
            break
        news = movers.select("owner", "key", F.lit(None).cast("array<int>").alias("part")).union(movers.select("to", "key", "part"))
        last = members
        members = _resident(last.groupBy("owner").cogroup(news.groupBy("owner")).applyInArrow(take_in, member), buckets)
        came = movers.select("owner", F.lit(-1).alias("weight"), "part").union(movers.select("to", F.lit(1), "part"))
        _leave(last)
    codes = members.mapInArrow(settled, columns).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part_of", "entry"))).alias("code"), F.sum("distance").alias("error"))
    real = [len(p) for p in np.array_split(np.arange(size), parts)]
    out = base.join(codes, "key").select("vec_id", "label", F.col("code.entry").alias("code"), "error")
    return out, [[e[:n] for e in b.tolist()] for b, n in zip(books, real, strict=True)]


def op11_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: codes of all kept vectors, errors, errors by label, and the codebooks' digest."""
    codes, books = compress(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = codes.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    hexes = F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    return out.select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds written out one after the other."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.j, any_value(p.x) AS x, arg_min(c.e, (c.own - 2 * list_inner_product(p.x, c.x), c.e)) AS e,
    min(c.own - 2 * list_inner_product(p.x, c.x) + p.own) AS d FROM p JOIN c{r} c USING (j) GROUP BY p.vec_id, p.label, p.j)"""

    def updated(r: int) -> str:
        return f"""s{r} AS (SELECT j, e, i, floor(sum(x[i]) / count(*)) AS v FROM (SELECT j, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r - 1}) GROUP BY j, e, i),
n{r} AS (SELECT j, e, list(v ORDER BY i) AS x FROM s{r} GROUP BY j, e),
c{r} AS MATERIALIZED (SELECT c.j, c.e, coalesce(n.x, c.x) AS x, list_inner_product(coalesce(n.x, c.x), coalesce(n.x, c.x)) AS own FROM c{r - 1} c LEFT JOIN n{r} n USING (j, e))"""

    steps = [assigned(0), *(x for r in range(1, ROUNDS + 1) for x in (updated(r), assigned(r)))]
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, label, unnest(range({PARTS})) AS j, v FROM k),
p AS MATERIALIZED (SELECT vec_id, label, j, v[j * len(v) // {PARTS} + 1 : (j + 1) * len(v) // {PARTS}] AS x, list_inner_product(x, x) AS own FROM q),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {ENTRIES}),
c0 AS MATERIALIZED (SELECT j, e, x, own FROM p JOIN f USING (vec_id)),
{", ".join(steps)},
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY j) AS code, sum(d)::bigint AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error,
    (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda v: v::bigint::varchar), 'string_agg', ','), ',' ORDER BY j, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM r
"""


OP11_SQL = _sql()
