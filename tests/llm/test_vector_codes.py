"""Vector codes against Lloyd's rounds over whole arrays."""

import hashlib

import numpy as np
import pytest

from strandloom.llm import vector_codes


def lloyd(v, parts, entries, rounds):
    """Codes, errors and codebooks of rows in the order of their ids."""
    cut = np.array_split(v, parts, axis=1)
    codes, errors, books = [], np.zeros(len(v), np.int64), []
    for x in cut:
        book = x[:entries].copy()
        for r in range(rounds + 1):
            d = ((x[:, None].astype(object) - book[None]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(book)), object)
            entry = np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in d])
            if r == rounds:
                break
            for e in range(len(book)):
                mine = x[entry == e]
                if len(mine):
                    book[e] = [int(c) // len(mine) for c in mine.sum(axis=0)]
        codes.append(entry)
        errors += np.array([row[e] for row, e in zip(d, entry, strict=True)], np.int64)
        books.append(book.tolist())
    return np.stack(codes, axis=1).tolist(), errors.tolist(), books


def rows(df):
    return sorted((r.vec_id, r.label, list(r.code), r.error) for r in df.collect())


@pytest.mark.parametrize("residents,width,parts", [(1 << 19, 8, 4), (20, 8, 4), (37, 7, 3), (50, 2, 4)])
def test_codes(spark, residents, width, parts):
    rng = np.random.default_rng(width)
    v = rng.integers(-40, 40, (150, width))
    v[100:140] = v[3]  # a hot vector
    table = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(v.tolist())], "vec_id long, label int, v array<bigint>").repartition(4)
    got, books = vector_codes.compress(table, parts, 16, 3, residents)
    codes, errors, want = lloyd(v, parts, 16, 3)
    assert books == want
    assert rows(got) == sorted((i, i % 3, c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True)))


def test_few_rows_ties_and_other_lengths(spark):
    v = [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 5, 6], [9, 9, 9, 9, 9]]
    table = spark.createDataFrame([(1, None, v[0]), (1, 2, v[1]), (None, 2, v[2]), (7, 2, v[3])], "vec_id int, label int, v array<bigint>")
    got, books = vector_codes.compress(table, 2, 256, 4)
    assert sorted(map(str, got.collect())) == sorted(f"Row(vec_id={i}, label={x}, code={c}, error=0)" for i, x, c in ((1, None, [0, 0]), (1, 2, [0, 0]), (None, 2, [0, 2])))
    assert books == [[[1, 2], [1, 2], [1, 2]], [[3, 4], [3, 4], [5, 6]]]
    none, books = vector_codes.compress(table.limit(0))
    assert none.count() == 0 and books == [[], [], [], []] and none.columns == ["vec_id", "label", "code", "error"]


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 24, 1 << 27):
        x, book = rng.integers(-top, top, (60, 4)), rng.integers(-top, top, (9, 4))
        x[5] = book[3]
        book[7] = book[3]
        entry, distance = vector_codes.nearest(x, book)
        for a, e, d in zip(x, entry.tolist(), distance.tolist(), strict=True):
            every = [sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for b in book]
            assert d == min(every) and e == every.index(d)
    with pytest.raises(ValueError, match="too large"):
        vector_codes.nearest(np.array([[1 << 40]]), np.array([[0]]))


def test_contract_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[600:650] = x[0]
    data = [(i, e.tolist(), None if i % 7 == 0 else i % 3, "key") for i, e in enumerate(x)]
    data += [(-1, None, 1, "k"), (-2, [1.0, None] + [0.0] * 6, 1, "k"), (-3, [float("nan")] * 8, 1, "k"), (-4, [float("inf")] * 8, 1, "k"), (-5, [], 1, "k")]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, key string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in vector_codes.op11_resident_lloyd(spark, str(tmp_path)).collect()}
    codes, errors, books = lloyd(np.floor(1024 * x.astype(float)).astype(np.int64), 4, 256, 4)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label: dict = {}
    for i, e in enumerate(errors):
        by_label[data[i][2]] = by_label.get(data[i][2], 0) + e
    assert set(got) == set(range(700))
    for i, r in got.items():
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == ("".join(f"{c:02x}" for c in codes[i]), errors[i], by_label[data[i][2]], digest)
