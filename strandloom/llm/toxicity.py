"""Toxicity: noisy-channel deobfuscation under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The letters that the language model tells apart; 0 is a word's edge and anything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
# Letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SIZE = 64
SIGN_COST, RUN_COST, JOIN_COST, SPACE_COST = 1.5, 1.5, 0.5, 2.0
SPACED = 4  # single characters in a row that may be one spaced word; shorter runs are words of one letter
TRAIN_ROWS = 40_000  # about so many labelled rows, chosen by hash, fit the classifier
LEXICON = 20_000  # features at most, those of most toxic documents first
THRESHOLD = 0.3

_NUMBER = np.zeros(0x180, np.int32)
for _i, _c in enumerate(LETTERS):
    _NUMBER[ord(_c)] = _i + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|[@$]{2,}$|_+$|^_+")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SIGNS = ".,;:!?()[]{}\"'«»…-–—"
_DOTTED = re.compile(r"^(?:[\w@$!|+][.\-_*·/]){2,}[\w@$!|+]$")
_SIGNED = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9@$!|+])")


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        found = batch.column(0).to_pylist()
        for i in range(0, len(found), 512):
            code = np.frombuffer(f" {'  '.join(t or '' for t in found[i : i + 512]).lower()} ".encode("utf-32-le", "replace"), np.uint32)
            n = np.where(code < len(_NUMBER), _NUMBER[np.minimum(code, len(_NUMBER) - 1)], 0)
            total += np.bincount((n[:-2] * SIZE + n[1:-1]) * SIZE + n[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (-log p) of a character after two others, from trigram counts of every text: at most 64^3 rows come back."""
    rows = docs.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SIZE**3)
    for gram, count in rows:
        n[gram] = count
    n = n.reshape(SIZE, SIZE, SIZE)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SIZE)
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return -np.log((n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def viterbi(lattice: list[list[tuple[str, float]]], cost) -> str:
    """The cheapest way through the lattice: channel costs of its choices and model costs of their characters.

    A state is the last two characters, so there are few, all are kept, and time and memory are linear in the lattice.
    """
    states, back = {(0, 0): 0.0}, []
    index = _INDEX.get
    for choices in [*lattice, [(" ", 0.0)]]:
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple] = {}
        for state, spent in states.items():
            for string, channel in choices:
                (x, y), total = state, spent + channel
                for c in string:
                    z = index(c, 0)
                    total += cost[x][y][z]
                    x, y = y, z
                if total < new.get((x, y), math.inf):
                    new[x, y] = total
                    came[x, y] = state, string
        states = new
        back.append(came)
    state, out = min(states, key=lambda k: (states[k], k)), []
    for came in reversed(back):
        state, string = came[state]
        out.append(string)
    return "".join(reversed(out))[:-1]


def _choices(text: str) -> list[list[tuple[str, float]]]:
    """Lattice of a token: letters stay, signs may stand for letters, a run of three or more may be one or two."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        j = i
        while j < len(text) and text[j] == c:
            j += 1
        if c in _INDEX and j - i >= 3:
            out.append([(c * (j - i), 0.0), (c, RUN_COST), (c * 2, RUN_COST)])
            i = j
            continue
        out.append([(c, SIGN_COST if c in STANDS_FOR else 0.0), *((x, SIGN_COST) for x in STANDS_FOR.get(c, ""))])
        i += 1
    return out


class Restorer(dict):
    """Restored form of each blank-separated word (lower case, edges stripped); a word with one reading is itself."""

    def __init__(self, cost: np.ndarray, most: int = 300_000):
        self.cost, self.most = cost.tolist(), most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        text = self[word] = self.read(word.lower())
        return text

    def read(self, text: str) -> str:
        plain = text.strip(_SIGNS)
        if plain.isalpha():
            text = plain
        elif not text.isalpha():
            text = _EDGE.sub("", _EDGE.sub("", text)) if not _DOTTED.match(text) else text
            if _DOTTED.match(text):
                letters = _choices(text[::2])
                gap = [[("", JOIN_COST), (" ", SPACE_COST)]]
                text = viterbi([c for i, x in enumerate(letters) for c in (gap if i else []) + [x]] if len(letters) == len(text[::2]) else letters, self.cost)
            elif _SIGNED.match(text):
                text = viterbi(_choices(text), self.cost)
        if _RUN.search(text):
            text = viterbi(_choices(text), self.cost)
        return text

    def words(self, text: str | None) -> list[str]:
        """Restored words of a whole text; runs of single characters are decoded together."""
        words = text.split() if text else []
        out = list(map(self.__getitem__, words))
        single = np.fromiter(map(len, words), np.int32, len(words)) == 1
        if int(single.sum()) >= SPACED:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
            for a, b in reversed(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))):
                if b - a >= SPACED:
                    gap = [[("", JOIN_COST), (" ", SPACE_COST)]]
                    chars = "".join(words[a:b]).lower()
                    out[a:b] = viterbi([c for i, x in enumerate(chars) for c in (gap if i else []) + [_choices(x)[0]]], self.cost).split()
        return out


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of four to six characters, which inflected forms share."""
    return (word, *(f"{word[:k]}^" for k in (4, 5, 6) if len(word) >= k))


_LOADED: dict[int, tuple] = {}


def _restorer(sent) -> Restorer:
    got = _LOADED.get(0)
    if got is None or got[0] != sent.id:
        got = _LOADED[0] = (sent.id, Restorer(sent.value))
    return got[1]


class _Sent:
    """A broadcast value under an id that is its own in every process."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def _seen(model: _Sent, wanted: _Sent | None):
    """Documents and toxic documents that have each feature, summed up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, n = _restorer(model), Counter()
        only = set(wanted.value) if wanted else None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = {f for w in set(restore.words(text)) for f in features(w)}
                n.update(own & only if only is not None else own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return run


class Weights(dict):
    """Log odds of a raw word: the largest of its features, 0 without one. A full generation of words replaces the one before."""

    def __init__(self, restore: Restorer, lexicon: dict[str, float], most: int = 300_000):
        self.restore, self.lexicon, self.most = restore, lexicon, most
        self.begins = {f[:-1]: w for f, w in lexicon.items() if f[-1:] == "^"}
        self.before: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        w = self.before.get(word)
        if w is None:
            plain = word.strip(_SIGNS).lower()
            # a word of letters is itself, unless letters are repeated
            parts = (plain,) if plain.isalpha() and not _RUN.search(plain) else self.restore.read(word.lower()).split()
            w = max((self.odds(p) for p in parts), default=0.0)
        self[word] = w
        return w

    def odds(self, word: str) -> float:
        w, get = self.lexicon.get(word, 0.0), self.begins.get
        for k in (4, 5, 6):
            if len(word) >= k:
                w = max(w, get(word[:k], 0.0))
        return w


def _evidence(weights: Weights, text: str | None) -> tuple[float, float, float]:
    """Of a text: the largest log odds, log(1 + their sum), and log(1 + words)."""
    words = text.split() if text else []
    if not words:
        return 0.0, 0.0, 0.0
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    if (np.fromiter(map(len, words), np.int32, len(words)) == 1).sum() >= SPACED:
        w = np.array([weights.odds(x) for x in weights.restore.words(text)] or [0.0])
    return float(w.max()), math.log1p(float(w.sum())), math.log1p(len(words))


def _scorer(model: _Sent, lexicon: _Sent, fit: np.ndarray | None, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = _restorer(model)
        weights = Weights(restore, lexicon.value)
        for batch in batches:
            found = batch.column(1).to_pylist()
            x = np.array([_evidence(weights, t) for t in found]).reshape(len(found), 3)
            cols = [batch.column(0), *(pa.array(x[:, i]) for i in range(3))]
            names = ["doc_id", "top", "total", "size"]
            if fit is not None:
                z = fit[0] + x @ fit[1:]
                cols, names = [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"]
            if keep_text:
                cols.append(pa.array([" ".join(restore.words(t)) for t in found], pa.string()))
                names.append("text_restored")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps: intercept, then a weight for each column."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """The character model, the lexicon of features with their log odds, and the fit that turns evidence into a score."""

    def __init__(self, cost: np.ndarray, lexicon: dict[str, float], fit: np.ndarray):
        self.cost, self.lexicon, self.fit = cost, lexicon, fit


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most_features: int = LEXICON) -> ToxicityModel:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic) outside the held-out fold.

    The character model counts every text. The lexicon and the score's fit use about `train_rows` labelled rows chosen by
    a hash of their id: two thirds give the lexicon, the rest the fit, so that no document weighs its own words. Without
    rows of both labels every score is 0.
    """
    spark = docs.sparkSession
    cost = character_model(docs)
    model = _Sent(spark, cost)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = known.count()
    share = min(1.0, train_rows / max(n, 1))
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    known = known.where(part < int(share * 1_000_000)).withColumn("role", (F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("r"))) % 3).cast("int"))
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about train_rows rows at most
    count: dict[tuple[bool, bool], int] = {}
    for r in known.groupBy((F.col("role") == 2).alias("fit"), (F.col("toxic") > 0).alias("bad")).count().collect():
        count[r["fit"], r["bad"]] = r["count"]
    bad, good = count.get((False, True), 0), count.get((False, False), 0)
    if not bad or not good:
        return ToxicityModel(cost, {}, np.array([-30.0, 0.0, 0.0, 0.0]))
    words = train.where("role < 2").select("text", (F.col("toxic") > 0).alias("bad"))
    toxic = words.where("bad").select("text").mapInArrow(_seen(model, None), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("t"))
    toxic = toxic.where(F.col("t") >= max(2, int(0.003 * bad))).orderBy(F.desc("t"), "feature").limit(most_features).collect()
    t = {r["feature"]: r["t"] for r in toxic}
    wanted = _Sent(spark, list(t))
    clean = words.where("not bad").select("text").mapInArrow(_seen(model, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    c = {r["feature"]: r["n"] for r in clean.collect()}  # at most most_features rows
    prior = math.log(bad / good)
    odds = {f: math.log((k + 0.5) / (c.get(f, 0) * 1.0 + 0.5)) - prior for f, k in t.items()}
    # a feature counts if chance hardly gives it so many toxic documents
    lexicon = {f: w for f, w in odds.items() if w >= 2.0 and t[f] * w >= 10}
    sent = _Sent(spark, lexicon)
    rows = train.where("role = 2").select("doc_id", "text", "toxic")
    scored = rows.select("doc_id", "text").mapInArrow(_scorer(model, sent, None, False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, top double, total double, size double")
    seen = scored.join(F.broadcast(known), "doc_id").select("top", "total", "size", "toxic").collect()  # a third of train_rows
    x = np.array([r[:3] for r in seen], float).reshape(-1, 3)
    y = np.array([r[3] > 0 for r in seen], float)
    fit = _logistic(x, y) if len(y) and 0 < y.sum() < len(y) else np.array([prior, 1.0, 0.0, 0.0])
    return ToxicityModel(cost, lexicon, fit)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep_text: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs (doc_id, text); with keep_text=True also text_restored.

    Null and empty texts get the score of no evidence; a very long text is read whole; repeated rows are scored each.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double" + ", text_restored string" * keep_text
    run = _scorer(_Sent(spark, model.cost), _Sent(spark, model.lexicon), model.fit, keep_text)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold."""
    sent, lexicon, at = _Sent(docs.sparkSession, model.cost), _Sent(docs.sparkSession, model.lexicon), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(_restorer(sent), lexicon.value)
        for batch in batches:
            x = np.array([_evidence(weights, t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, 3)
            score = 1 / (1 + np.exp(-np.clip(model.fit[0] + x @ model.fit[1:], -30, 30)))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_noisy_channel(spark, sf_dir: str) -> DataFrame:
    """Contract query: a score and a prediction for every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
