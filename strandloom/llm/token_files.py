"""Token ids in files: one zstandard frame for each document, a dictionary that all frames share, and an index of offsets.

A folder holds

    dictionary          bytes of the zstandard dictionary, trained on serialized id arrays (empty: frames stand alone)
    part-*.tok          a header (magic, bytes of an id, SHA-256 of the dictionary) and the documents' frames, end to end
    part-*.idx          Arrow file: doc_id, end (of the frame, from the file's begin), n_tokens, by document in the same order
    manifest/           Parquet, a row for each part: file, part, roll, first and last doc_id, docs, tokens, bytes, dictionary

Parts follow each other in ascending doc_id order. A task writes files under names of its own and only the manifest, which Spark
commits, makes them count, so a task that is run twice leaves nothing but unread files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from strandloom.llm.common import shared_dir, texts
from strandloom.llm.packing import _LOADED, WordIds, _split, tokenizer_path

END_ID = 1
MAGIC = b"TOKF\x01"
DICTIONARY_BYTES = 1 << 16
DICTIONARY_DOCS = 2_000  # documents, chosen by hash from the whole table, whose ids the dictionary is trained on
DICTIONARY_CHARS = 4_000  # of each of them
LEVEL = 3
PART_BYTES = 256 << 20  # a task begins a new part beyond
INDEX_BYTES = 4 << 20  # frames of one batch of the index, which are read at once
RECENT_BYTES = 32 << 20  # ids of texts that a task keeps in case they come again
_HEADER = len(MAGIC) + 1 + 32


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _get(path: str) -> bytes:
    fs, at = _place(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def _words(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _encoded(batches: Iterator[pa.RecordBatch], cache: WordIds, end: bytes) -> Iterator[tuple[object, bytes]]:
    """First column and the text's ids as little-endian unsigned 32-bit integers, the end id last; null texts are empty. Equal texts
    near each other are encoded once."""
    done: dict[str | None, bytes] = {None: end}
    held = 0
    for batch in batches:
        first, every = batch.column(0).to_pylist(), texts(batch)
        for at in range(0, len(every), 256):
            some = every[at : at + 256]
            if held > RECENT_BYTES:
                done, held = {None: end}, 0
            fresh, new = [], set()
            for t in dict.fromkeys(some):
                if t not in done:
                    words = _split(t)
                    ids = list(map(cache.get, words))
                    if None in ids:
                        new.update(w for w, x in zip(words, ids, strict=True) if x is None)
                        ids = None
                    fresh.append((t, words, ids))
            cache.learn(new)
            for t, words, ids in fresh:
                done[t] = b"".join(map(cache.__getitem__, words) if ids is None else ids) + end
                held += len(done[t])
            yield from zip(first[at : at + 256], map(done.__getitem__, some), strict=True)


def _width(cache: WordIds, end_id: int) -> int:
    return 2 if max(len(cache.ends) - 1, end_id) < 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = DICTIONARY_BYTES, n_docs: int = DICTIONARY_DOCS) -> bytes:
    """A dictionary from about `n_docs` documents, all if there are fewer, of which `DICTIONARY_CHARS` characters count.

    The bound is the dictionary's own: whatever the corpus, it holds `size` bytes. They are trained in one task, and only they come
    to the driver. Too little text for training gives the serialized ids themselves as a dictionary, no text an empty one.
    """
    n = docs.count()
    share = min(1.0, n_docs / n) if n else 1.0
    by = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = docs.where(by).select("doc_id", F.substring("text", 1, DICTIONARY_CHARS).alias("text")).where("text is not null")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _words(tokenizer)
        kind, end = f"<u{_width(cache, end_id)}", np.array([end_id], "<u4").tobytes()
        ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() for _, x in _encoded(batches, cache, end)]
        ids.sort()  # rows come in any order
        try:
            got = zstandard.train_dictionary(size, ids, k=256, d=8).as_bytes() if ids else b""
        except zstandard.ZstdError:
            got = b"".join(ids)[:size]
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([got], pa.binary())})

    return sample.repartition(1).mapInArrow(train, "dictionary binary").first()[0]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _Part:
    """One part being written: frames and index grow together."""

    def __init__(self, path: str, width: int, digest: bytes, schema: pa.Schema):
        self.name = f"part-{uuid.uuid4().hex}"
        fs, at = _place(path)
        self.data, self.raw = fs.open_output_stream(f"{at}/{self.name}.tok"), fs.open_output_stream(f"{at}/{self.name}.idx")
        self.index = pa.ipc.new_file(self.raw, schema)
        self.schema, self.rows, self.held = schema, [], 0
        self.data.write(MAGIC + bytes([width]) + digest)
        self.bytes, self.docs, self.tokens, self.first, self.last = _HEADER, 0, 0, None, None

    def add(self, doc_id, frame: bytes, tokens: int) -> None:
        self.data.write(frame)
        self.bytes += len(frame)
        self.held += len(frame)
        self.first = doc_id if not self.docs else self.first
        self.last = doc_id
        self.docs += 1
        self.tokens += tokens
        self.rows.append((doc_id, self.bytes, tokens))
        if self.held >= INDEX_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.index.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
            self.rows, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.index.close()
        self.raw.close()
        self.data.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, dictionary: bytes | None = None, part_bytes: int = PART_BYTES) -> None:
    """Writes docs (doc_id, text), encoded, to a new folder in ascending doc_id order.

    Documents are dealt by ranges of doc_id and a task encodes, compresses and writes its range document by document: memory holds one
    Arrow batch of texts. A null text is the end id alone, as is an empty one; rows without a doc_id come first; rows with the same
    doc_id follow each other in an order of their texts, and repeated rows are written each; an empty table gives a folder without
    parts; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    fs, at = _place(path)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/dictionary") as f:
        f.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = to_arrow_schema(docs.select("doc_id").schema).append(pa.field("end", pa.int64())).append(pa.field("n_tokens", pa.int64()))
    # one doc_id of very many rows is dealt on by text, equal rows by a fixed draw
    ordered = docs.withColumns({"tie": F.xxhash64("text"), "draw": F.rand(0)}).repartitionByRange("doc_id", "tie", "draw").sortWithinPartitions("doc_id", "tie", "draw").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, roll, done = _words(tokenizer), None, 0, []
        width, end = _width(cache, end_id), np.array([end_id], "<u4").tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sent.value))
        here = TaskContext.get().partitionId()

        def over() -> None:
            part.close()
            done.append({"file": part.name, "part": here, "roll": roll, "first": part.first, "last": part.last, "docs": part.docs, "tokens": part.tokens, "bytes": part.bytes, "dictionary": digest.hex()})

        for doc_id, ids in _encoded(batches, cache, end):
            if part is None:
                part = _Part(path, width, digest, schema)
            part.add(doc_id, packer.compress(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids), len(ids) // 4)
            if part.bytes >= part_bytes:
                over()
                part, roll = None, roll + 1
        if part is not None:
            over()
        if done:
            kinds = [("file", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("first", schema[0].type), ("last", schema[0].type), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.string())]
            yield pa.RecordBatch.from_pylist(done, pa.schema(kinds))

    rows = f"file string, part int, roll int, first {kind}, last {kind}, docs long, tokens long, bytes long, dictionary string"
    ordered.mapInArrow(write, rows).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts in order, with `base`: the ids in all parts before. It has a row for each `PART_BYTES`, not for each document."""
    before = F.sum("tokens").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1))
    return spark.read.parquet(f"{path}/manifest").withColumn("base", F.coalesce(before, F.lit(0)))


def _opened(path: str, name: str, digest: str, data: bytes):
    """A part's open file and width of ids, after its header has been held against the dictionary."""
    fs, at = _place(path)
    f = fs.open_input_file(f"{at}/{name}.tok")
    head = f.read(_HEADER)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :].hex() != digest or hashlib.sha256(data).hexdigest() != digest:
        f.close()
        raise ValueError(f"{name}.tok does not belong to the dictionary in {path}")
    return f, head[len(MAGIC)]


def _index(path: str, name: str) -> Iterator[pa.RecordBatch]:
    fs, at = _place(path)
    with fs.open_input_file(f"{at}/{name}.idx") as raw:
        index = pa.ipc.open_file(raw)
        for i in range(index.num_record_batches):
            yield index.get_batch(i)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest dealt out, a part to a task."""
    parts = manifest(spark, path)
    return parts.select("file", "base", "dictionary").repartition(max(1, parts.count()))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and where its frame lies: file, begin, size, dictionary."""
    kind = spark.read.parquet(f"{path}/manifest").schema["first"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, begin = row["base"], _HEADER
                for some in _index(path, row["file"]):
                    n, ends = some.column(2).to_numpy(), some.column(1).to_numpy()
                    sizes = np.diff(ends, prepend=begin)
                    starts = start + np.cumsum(n) - n
                    same = [pa.array([row[k]] * len(n), pa.string()) for k in ("file", "dictionary")]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(starts), some.column(2), same[0], pa.array(ends - sizes), pa.array(sizes), same[1]], ["doc_id", "start", "n_tokens", "file", "begin", "size", "dictionary"])
                    start, begin = start + int(n.sum()), int(ends[-1])

    return _parts(spark, path).mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, file string, begin long, size long, dictionary string")


def _columns(frames: list[bytes], width: int, opener: zstandard.ZstdDecompressor, ids: bool) -> list[pa.Array]:
    """ids_crc32, and the ids themselves where they are wanted, of frames."""
    crc, own = [], []
    for frame in frames:
        x = np.frombuffer(opener.decompress(frame), f"<u{width}").astype("<u4")
        crc.append(zlib.crc32(x.data))
        own.append(x)
    cols = [pa.array(crc, pa.int64())]
    if ids:
        offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
        flat = np.concatenate([*own, np.empty(0, "<u4")]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
    return cols


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """All documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (array<int>).

    A part is read by one task, some megabytes at once; ids=False leaves the arrays out. A part whose header does not name the
    folder's dictionary raises ValueError.
    """
    kind = spark.read.parquet(f"{path}/manifest").schema["first"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for row in batch.to_pylist():
                data = _get(f"{path}/dictionary") if data is None else data
                opener = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
                f, width = _opened(path, row["file"], row["dictionary"], data)
                start, begin = row["base"], _HEADER
                with f:
                    for some in _index(path, row["file"]):
                        n, ends = some.column(2).to_numpy(), some.column(1).to_numpy()
                        block = f.read_at(int(ends[-1]) - begin, begin)
                        cuts = [0, *(ends - begin).tolist()]
                        cols = _columns([block[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], width, opener, ids)
                        starts = start + np.cumsum(n) - n
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(starts), some.column(2), *cols], names)
                        start, begin = start + int(n.sum()), int(ends[-1])

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4]
    return _parts(spark, path).mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def fetch_tokens(spark: SparkSession, path: str, wanted: DataFrame, ids: bool = True) -> DataFrame:
    """The documents whose doc_id is in `wanted` (doc_id), by the index: only their frames are read. Columns as in read_tokens; a
    doc_id that is wanted twice comes once, one that is not there or null not at all."""
    found = token_index(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    kind = found.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = opener = f = name = width = None
        try:
            for batch in batches:
                frames = []
                for row in batch.select(["file", "begin", "size", "dictionary"]).to_pylist():
                    if data is None:
                        data = _get(f"{path}/dictionary")
                        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
                    if row["file"] != name:
                        if f:
                            f.close()
                        f, width = _opened(path, row["file"], row["dictionary"], data)
                        name = row["file"]
                    frames.append(f.read_at(row["size"], row["begin"]))
                cols = _columns(frames, width, opener, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names)
        finally:
            if f:
                f.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4]
    near = found.repartition("file").sortWithinPartitions("file", "begin")
    return near.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: documents are written to token files, and the rows come from the files."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return read_tokens(spark, path, ids=False)
