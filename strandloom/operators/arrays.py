"""Sequences as arrays inside a task: what one sequence's windows give is counted where the sequence is, before any shuffle.

An Arrow batch is worked on in slices of whole sequences laid end to end, so that numpy runs over a million characters at once and a
single long sequence is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20  # characters
EVEN = 1e-12  # a mean squared deviation up to this is that of equal values


class Slice:
    """Sequences laid end to end: characters (one number each), the row of each character, where each row begins, and lengths."""

    def __init__(self, texts: list[str | None], first: int):
        joined = "".join(t or "" for t in texts)
        self.chars = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.length = np.array([len(t or "") for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.row = np.repeat(np.arange(len(texts)), self.length)
        self.first = first  # row of the batch that is row 0 here

    def place(self) -> np.ndarray:
        """Each character's position in its sequence, from 0."""
        return np.arange(len(self.chars)) - self.start[self.row]

    def looked_up(self, values: dict[str, float], other: float = 0.0) -> np.ndarray:
        """The number that stands for each character."""
        if self.chars.dtype == np.uint8:
            table = np.full(256, other)
            table[[ord(c) for c in values if ord(c) < 256]] = [v for c, v in values.items() if ord(c) < 256]
            return table[self.chars]
        own, inverse = np.unique(self.chars, return_inverse=True)
        return np.array([values.get(chr(c), other) for c in own])[inverse]

    def word_values(self, table: dict[str, tuple[float, ...]], k: int) -> list[np.ndarray]:
        """For each property of a table of k-mers the value of the word that begins at each character; nan where the table has none."""
        many = len(next(iter(table.values())))
        if k == 1:
            return [self.looked_up({c: v[u] for c, v in table.items()}, np.nan) for u in range(many)]
        letters = sorted({c for w in table for c in w})
        code = self.looked_up({c: float(i) for i, c in enumerate(letters)}, float(len(letters))).astype(np.int64)
        at = np.zeros(len(code), np.int64)
        for i in range(k):
            at = at * (len(letters) + 1)
            at[: len(code) - i] += code[i:]
        out = np.full((many, (len(letters) + 1) ** k), np.nan)
        for w, v in table.items():
            place = 0
            for c in w:
                place = place * (len(letters) + 1) + letters.index(c)
            out[:, place] = v
        return [column[at] for column in out]


class Lag:
    """The places of a slice from which a word of k characters and the one `lag` characters further on lie in one sequence."""

    def __init__(self, part: Slice, lag: int, k: int = 1):
        self.lag, self.many = lag, len(part.length)
        self.n = max(0, len(part.row) - lag - k + 1)
        self.row = part.row[: self.n]
        self.there = self.row == part.row[lag + k - 1 : lag + k - 1 + self.n]

    def first(self, x: np.ndarray) -> np.ndarray:
        return x[: self.n]

    def then(self, x: np.ndarray) -> np.ndarray:
        return x[self.lag : self.lag + self.n]

    def total(self, x: np.ndarray) -> np.ndarray:
        """Each row's sum, added up in the order of the places."""
        return np.bincount(self.row, np.where(self.there, x, 0.0), self.many)


def number(x: np.ndarray) -> pa.Array:
    """Doubles, null where there is no number."""
    return pa.array(np.asarray(x, float), from_pandas=True)


def slices(batch: pa.RecordBatch, column: str = "seq", limit: int = SLICE) -> Iterator[Slice]:
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit or i == len(texts) - 1:
            yield Slice(texts[at : i + 1], at)
            at, held = i + 1, 0


def by_slice(s: DataFrame, keep: tuple[str, ...], columns: str, rule: Callable[[Slice], tuple[np.ndarray, list]], limit: int = SLICE) -> DataFrame:
    """A row of `keep` and `columns` for each that the rule gives of a slice: (row of the slice, arrays of the columns)."""
    kinds = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                rows, values = rule(part)
                at = pa.array(rows + part.first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *values], names)

    return s.select(*keep, "seq").mapInArrow(run, f"{kinds}, {columns}")


def _keys(letters: np.ndarray, many: int, at: np.ndarray, shape: tuple[int, ...], row: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each window that is the same for equal windows of a row, and how many there may be for a row."""
    key, size = np.zeros(len(at), np.int64), 1
    for off in shape:
        key, size = key * many + letters[at + off], size * many
        if size > 1 << 31:  # only what occurs
            own, key = np.unique(key, return_inverse=True)
            size = len(own)
    return row[at] * size + key, size


def _words(chars: np.ndarray, at: np.ndarray, shape: tuple[int, ...]) -> pa.Array:
    cut = chars[at[:, None] + np.array(shape, np.int64)[None, :]]
    if chars.dtype == np.uint8:
        ends = np.arange(len(at) + 1, dtype=np.int32) * len(shape)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cut)))
    return pa.array(["".join(map(chr, w)) for w in cut.tolist()], pa.string())


def counted(part: Slice, shapes: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row, shape, word, count and number of windows of each sequence's words of every shape."""
    chars, row = part.chars, part.row
    if chars.dtype == np.uint8:
        there = np.flatnonzero(np.bincount(chars, minlength=256))
        table = np.zeros(256, np.int64)
        table[there] = np.arange(len(there))
        letters = table[chars]
    else:
        there, letters = np.unique(chars, return_inverse=True)
    out: list[list] = [[], [], [], [], []]
    for i, shape in enumerate(shapes):
        span = shape[-1]
        n = max(0, len(chars) - span)
        at = np.flatnonzero(row[:n] == row[span:])
        if not len(at):
            continue
        key, size = _keys(letters, len(there), at, shape, row)
        if len(part.length) * size <= 4 * len(at) + 4096:
            count = np.bincount(key)
            found = np.flatnonzero(count)
            first = np.empty(len(count), np.int64)
            first[key[::-1]] = at[::-1]
            count, first = count[found], first[found]
        else:
            _, which, count = np.unique(key, return_index=True, return_counts=True)
            first = at[which]
        total = np.maximum(part.length - span, 0)
        for column, values in zip(out, (row[first], np.full(len(first), i, np.int32), _words(chars, first, shape), count, total[row[first]]), strict=True):
            column.append(values)
    if not out[0]:
        none = np.empty(0, np.int64)
        return none, none.astype(np.int32), pa.array([], pa.string()), none, none
    return np.concatenate(out[0]), np.concatenate(out[1]), pa.concat_arrays(out[2]), np.concatenate(out[3]), np.concatenate(out[4])


def word_counts(s: DataFrame, shapes: list[tuple[int, ...]], keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keep, shape, word, cnt, total) of each sequence's words of every shape.

    A shape is the offsets of a word's characters, (0, 1, 2) for 3-mers or (0, 3) for pairs with two others between; the column `shape`
    is its place in the list. total is the number of a sequence's windows of the shape. All shapes come out of one scan and nothing
    is shuffled. Shorter sequences, empty and null ones have no rows; any characters count; repeated rows are counted each.
    """

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        rows, shape, words, count, total = counted(part, shapes)
        return rows, [pa.array(shape), words, pa.array(count), pa.array(total)]

    return by_slice(s, keep, "shape int, word string, cnt long, total long", rule)


def pooled_counts(s: DataFrame, shapes: list[tuple[int, ...]], by: str) -> DataFrame:
    """(by, shape, word, cnt): words of every shape counted over all sequences of each value of `by`. Each slice's counts are summed up
    where it is, so that what is shuffled grows with the words that occur, not with the sequences."""
    kind = s.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, shape, words, count, _ = counted(part, shapes)
                whole = pa.table({by: batch.column(0).take(pa.array(row + part.first)), "shape": shape, "word": words, "cnt": count})
                yield from whole.group_by([by, "shape", "word"]).aggregate([("cnt", "sum")]).rename_columns([by, "shape", "word", "cnt"]).combine_chunks().to_batches()

    return s.select(by, "seq").mapInArrow(run, f"{by} {kind}, shape int, word string, cnt long").groupBy(by, "shape", "word").agg(F.sum("cnt").alias("cnt"))


def class_places(s: DataFrame, properties: dict[str, tuple[str, ...]], shares: tuple[int, ...]) -> DataFrame:
    """(seq_id, n, property, grp, q, at): position, from 1, of the floor(q n / 100)-th (at least first) residue of each group, and null
    for a group that does not occur; n is the sequence's length. Empty sequences have no rows."""
    names = list(properties)

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some = np.flatnonzero(part.length)
        out: list[list] = [[] for _ in range(5)]
        place = part.place() + 1
        for j, groups in enumerate(properties.values()):
            for g, members in enumerate(groups, 1):
                where = np.flatnonzero(part.looked_up(dict.fromkeys(members, 1.0)) > 0)
                count = np.bincount(part.row[where], minlength=len(part.length))
                before = (np.cumsum(count) - count)[some]
                for q in shares:
                    kth = np.maximum(1, count[some] * q // 100)
                    has = count[some] > 0
                    at = np.zeros(len(some), np.int64)
                    at[has] = place[where[(before + kth - 1)[has]]]
                    for column, values in zip(out, (some, np.full(len(some), j), np.full(len(some), g), np.full(len(some), q), np.where(has, at, -1)), strict=True):
                        column.append(values)
        rows, prop, grp, q, at = (np.concatenate(c) for c in out)
        return rows, [pa.array(part.length[rows]), pa.array(names).take(pa.array(prop)), pa.array(grp.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(at, mask=at < 0)]

    return by_slice(s, ("seq_id",), "n long, property string, grp int, q int, at long", rule)


def scale_windows(s: DataFrame, scale: dict[str, float], width: int, degrees: float | None = None) -> DataFrame:
    """(seq_id, n_windows, largest, mean, every) of a scale's means over all windows of `width` residues, one at each position.

    With `degrees` a window's value is its moment: the length of the sum of the scale's values, each turned by that angle for each
    position, over the width. A sequence shorter than the window is one window. Running sums give each window as a difference of two
    of their entries, so a sequence costs its length whatever the width; a window's moment does not depend on where the turning began.
    `every` holds all windows' values. Residues that the scale lacks count as 0; empty and null sequences have no rows.
    """

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        values = part.looked_up(scale)
        turned = [values]
        if degrees is not None:
            angle = np.radians(degrees) * part.place()
            turned = [values * np.cos(angle), values * np.sin(angle)]
        rows = np.flatnonzero(part.length)
        found = []
        for r in rows.tolist():
            a, n = part.start[r], part.length[r]
            w = min(width, n)
            sums = []
            for v in turned:
                run = np.concatenate([[0.0], np.cumsum(v[a : a + n])])
                sums.append((run[w:] - run[:-w]) / w)
            found.append(sums[0] if degrees is None else np.hypot(*sums))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        every = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0)])))
        return rows, [pa.array([len(f) for f in found], pa.int64()), pa.array([f.max() for f in found], pa.float64()), pa.array([f.mean() for f in found], pa.float64()), every]

    return by_slice(s, ("seq_id",), "n_windows long, largest double, mean double, every array<double>", rule)


def sliding_shares(s: DataFrame, width: int, blank: str = "-") -> DataFrame:
    """(seq_id, start, residue, share) of each residue that occurs in each window of `width` residues, one window at each position.

    Running counts of each residue give every window's. Blanks are no residues: a share is of the window's others, and a window of blanks
    has no rows. Sequences shorter than the window have none either.
    """

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        n = len(part.chars) - width + 1
        at = np.flatnonzero(part.row[: max(n, 0)] == part.row[width - 1 :]) if n > 0 else np.empty(0, np.int64)
        place = part.place()
        running = lambda is_there: np.concatenate([[0], np.cumsum(is_there)])
        blanks = running(part.chars == ord(blank))
        residues = width - (blanks[at + width] - blanks[at])
        rows, start, letter, share = [], [], [], []
        for c in np.unique(part.chars).tolist():
            if c != ord(blank):
                run = running(part.chars == c)
                count = run[at + width] - run[at]
                has = np.flatnonzero(count)
                rows.append(part.row[at[has]])
                start.append(place[at[has]])
                letter.append(np.full(len(has), chr(c)))
                share.append(count[has] / residues[has])
        if not rows:
            return np.empty(0, np.int64), [pa.array([], t) for t in (pa.int32(), pa.string(), pa.float64())]
        return np.concatenate(rows), [pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(letter).tolist(), pa.string()), pa.array(np.concatenate(share))]

    return by_slice(s, ("seq_id",), "start int, residue string, share double", rule, limit=SLICE // 16)


def sliding_summary(s: DataFrame, width: int, blank: str = "-") -> DataFrame:
    """(seq_id, residue, n_windows, largest, total) of what sliding_shares gives: in how many windows each residue occurs, its largest share
    and the sum of its shares. Windows are summed up where the sequence is, so a row stands for a residue of a sequence."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        n = max(0, len(part.chars) - width + 1)
        row, many = part.row[:n], len(part.length)
        whole = row == part.row[width - 1 :] if n else np.empty(0, bool)
        there = lambda c: np.concatenate([[0], np.cumsum(part.chars == c, dtype=np.int32)])
        inside = lambda run: np.where(whole, run[width:] - run[:-width], 0)
        rows, letter, found = [], [], [[], [], []]
        own = np.unique(part.chars).tolist() if n else []
        empty = inside(there(ord(blank))) if ord(blank) in own else None
        for c in own:
            if c == ord(blank):
                continue
            count = inside(there(c))
            at = np.flatnonzero(count)
            if not len(at):
                continue
            r, count = row[at], count[at]
            share = count / (width if empty is None else width - empty[at])
            begin = np.flatnonzero(np.diff(r, prepend=-1))
            some = r[begin]
            rows.append(some)
            letter.append(pa.array([chr(c)], pa.string()).take(pa.array(np.zeros(len(some), np.int64))))
            # shares of whole windows are counts over one width
            total = np.bincount(r, share, many)[some] if empty is not None else np.bincount(r, count, many)[some] / width
            for column, x in zip(found, (np.diff(begin, append=len(r)), np.maximum.reduceat(share, begin), total), strict=True):
                column.append(x)
        if not rows:
            return np.empty(0, np.int64), [pa.array([], t) for t in (pa.string(), pa.int64(), pa.float64(), pa.float64())]
        return np.concatenate(rows), [pa.concat_arrays(letter), *(pa.array(np.concatenate(x)) for x in found)]

    return by_slice(s, ("seq_id",), "residue string, n_windows long, largest double, total double", rule)


#: Residues of a window of 18 in the order in which they stand around a helix, 100 degrees from each to the next; fixed by that angle.
AROUND = sorted(range(18), key=lambda i: 100 * i % 360)


def _arcs(x: np.ndarray) -> np.ndarray:
    """Longest arc in degrees of each row of (windows, 18): 1 with the property, 0 without, 2 no residue.

    A residue with the property adds 20 degrees and one without ends an arc. A place without residue adds 10 for each side on which the
    next residue, at most two places away, has the property.
    """
    step = np.where(x == 1, 20, 0)
    for shift in (1, -1):
        near, far = np.roll(x, shift, axis=1), np.roll(x, 2 * shift, axis=1)
        if shift == -1:  # behind the last place only the first one is looked at
            far[:, 17] = 0
        step = step + np.where(x == 2, 10 * ((near == 1) | (near == 2) & (far == 1)), 0)
    best, run = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(36):
        run = np.where(x[:, i % 18] == 0, 0, run + step[:, i % 18])
        best = np.maximum(best, run)
    return np.where((x == 0).any(axis=1), best, step.sum(axis=1))


def helical_arcs(s: DataFrame, features: dict[str, str]) -> DataFrame:
    """(seq_id, feature, largest, mean) over windows of 18 residues: the longest arc of a helix whose residues have the feature (named, with
    its residues). Windows begin at each residue but those of the last 18; a sequence of up to 18 is one window with places left
    empty. Empty sequences have no rows."""

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some = np.flatnonzero(part.length)
        out: list[list] = [[], [], [], []]
        for j, members in enumerate(features.values()):
            has = part.looked_up(dict.fromkeys(members, 1.0)).astype(np.int8)
            for r in some.tolist():
                x = has[part.start[r] : part.start[r] + part.length[r]]
                if len(x) > 18:
                    x = np.lib.stride_tricks.sliding_window_view(x, 18)[:-1]
                else:
                    x = np.concatenate([x, np.full(18 - len(x), 2, np.int8)])[None, :]
                arcs = _arcs(x[:, AROUND])
                for column, value in zip(out, (r, j, arcs.max(), arcs.mean()), strict=True):
                    column.append(value)
        names = pa.array(list(features)).take(pa.array(out[1], pa.int64()))
        return np.array(out[0], np.int64), [names, pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())]

    return by_slice(s, ("seq_id",), "feature string, largest long, mean double", rule, limit=SLICE // 4)


def scale_correlations(s: DataFrame, scales: dict[str, dict[str, float]], lags: int) -> DataFrame:
    """(seq_id, lag, scale, other, value) for lags from 0 to lags - 1 of sequences of more than `lags` residues: the mean product of
    one scale and another at the lag, each two scales once."""
    names = list(scales)

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        some = np.flatnonzero(part.length > lags)
        tracks = [part.looked_up(t) for t in scales.values()]
        row, many = part.row, len(part.length)
        mean = lambda x, at, n: np.bincount(row[at], weights=x, minlength=many) / np.maximum(n, 1)
        out: list[list] = [[], [], [], [], []]

        def add(lag: int, a: str, b: str, x: np.ndarray) -> None:
            for column, more in zip(out, (some, np.full(len(some), lag), [a] * len(some), [b] * len(some), x[some]), strict=True):
                column.append(more)

        for lag in range(lags):
            n = max(0, len(row) - lag)
            at = np.flatnonzero(row[:n] == row[lag:])
            m = part.length - lag
            for i, x in enumerate(tracks):
                for j in range(i + 1, len(tracks)):
                    add(lag, names[i], names[j], mean(x[at] * tracks[j][at + lag], at, m))
        if not out[0]:
            return np.empty(0, np.int64), [pa.array([], t) for t in (pa.int32(), pa.string(), pa.string(), pa.float64())]
        value = np.concatenate(out[4])
        strings = [pa.array([x for part in c for x in part], pa.string()) for c in out[2:4]]
        return np.concatenate(out[0]), [pa.array(np.concatenate(out[1]).astype(np.int32)), *strings, pa.array(value, mask=~np.isfinite(value))]

    return by_slice(s, ("seq_id",), "lag int, scale string, other string, value double", rule)


def autocorrelations(s: DataFrame, scales: dict[str, dict[str, float]], lags: int) -> DataFrame:
    """(seq_id, scale, lag, nmbroto, moran, geary) of lags 1 to `lags` for every scale, in one scan and without a shuffle.

    Scales are residue to number, each standardised over its residues; other characters count as the mean. Sequences of up to `lags`
    residues, empty and null ones have no rows; moran and geary are null where all residues have one value; repeated rows are
    counted each. Pairs of residues are counted once for each lag, and all scales' sums follow from the counts.
    """
    standard = {}
    for name, scale in scales.items():
        mean = sum(scale.values()) / len(scale)
        deviation = (sum((x - mean) ** 2 for x in scale.values()) / len(scale)) ** 0.5
        standard[name] = {c: (x - mean) / deviation for c, x in scale.items()}
    names = pa.array(list(scales), pa.string())
    codes = {c: float(i) for i, c in enumerate(sorted({c for x in scales.values() for c in x}))}
    # what a pair of residues adds to each scale's sums of products, squared differences, first and second values
    weights = []
    for x in standard.values():
        v = np.array([*(x.get(c, 0.0) for c in codes), 0.0])
        a, b = np.repeat(v, len(v)), np.tile(v, len(v))
        weights += [a * b, (a - b) ** 2, a, b]
    weights = np.stack(weights, axis=1)

    def rule(part: Slice) -> tuple[np.ndarray, list]:
        long = np.flatnonzero(part.length > lags)
        n, rows, row = part.length[long].astype(float), len(part.length), part.row
        out: list[list] = [[] for _ in range(6)]
        if not len(long):
            return np.empty(0, np.int64), [pa.array([], t) for t in (pa.string(), pa.int32(), *[pa.float64()] * 3)]
        mean, square = [], []
        for x in standard.values():
            v = part.looked_up(x)
            mean.append(np.bincount(row, v, rows) / np.maximum(part.length, 1))
            square.append(np.bincount(row, (v - mean[-1][row]) ** 2, rows)[long])
        code = part.looked_up(codes, float(len(codes))).astype(np.int64)
        size = len(codes) + 1
        pair = (row * size + code) * size
        for lag in range(1, lags + 1):
            at = Lag(part, lag)
            found = np.bincount((at.first(pair) + at.then(code))[at.there], minlength=rows * size * size).reshape(rows, -1)[long] @ weights
            for i, q in enumerate(square):
                both, apart, a, b = found[:, 4 * i : 4 * i + 4].T
                m = mean[i][long]
                spread = np.where(q > EVEN * n, q, np.nan)
                three = (both / (n - lag), (both - m * (a + b) + m * m * (n - lag)) / (n - lag) / (spread / n), apart / (2 * (n - lag)) / (spread / (n - 1)))
                for column, x in zip(out, (long, np.full(len(long), i), np.full(len(long), lag, np.int32), *three), strict=True):
                    column.append(x)
        rows_, scale, lag_, *three = (np.concatenate(x) for x in out)
        return rows_, [names.take(pa.array(scale)), pa.array(lag_), *(pa.array(np.round(x, 5), from_pandas=True) for x in three)]

    return by_slice(s, ("seq_id",), "scale string, lag int, nmbroto double, moran double, geary double", rule)
