"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two words sums over all subsequences of three letters, each
discounted by the letters it spans (Lodhi et al., 2002), and is normalised. A
gap or an inserted character only discounts a subsequence, so ``id.iot`` stays
close to ``idiot``. Landmarks are words and stretches of words of the labelled sentences; Nyström
features against them feed a squared-hinge SVM whose instances are the words of
labelled sentences, weighted by how many sentences of each label hold them. A
sentence counts as its worst word and a text as its worst sentence, and a
logistic curve turns that margin into a score.

The SVM is linear in the features and each feature is linear in the
subsequences, so the fitted model is one weight per subsequence. Scoring sums
these weights over a word, which equals the sum over landmarks of weight times
kernel.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import slices, stored, texts_of
from reviewfold.llm.spans import sentences

#: Labelled texts used to fit, chosen by a hash of the id; all if there are fewer.
FIT_TEXTS = 8000
#: Landmarks: words and four-letter stretches telling of the label, and frequent words.
TELLING, FREQUENT = 80, 24
#: Fits after the first.
REFITS = 2
BATCH_BYTES = 1 << 20
#: Bytes of features that a worker adds up at once.
SUM_BYTES = 2 << 20
_DECAY = 0.75
_LATIN = 27  # 0 for a gap, a to z; the symbols from here on are for other scripts
_OTHERS = 256 - _LATIN
# Latin triples have a place each, those with other symbols share so many.
_HASHED = 16
_TRIPLES = _LATIN**3 + (1 << _HASHED)
_WINDOW, _STRIDE, _SPAN = 24, 12, 9
_REMEMBERED = 200_000
# Runs of so many single letters are read as one word with gaps.
_SPELLED = 4

_TABLE = bytes(c - 96 if 97 <= c <= 122 else 0 for c in range(256))
_BASES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


@lru_cache(maxsize=1 << 16)
def _symbols(char: str) -> bytes:
    """Letter numbers of a character: Latin by its base letter, punctuation and
    digits as a gap, others by code point, so letters near each other differ."""
    base = _BASES.get(char) or unicodedata.normalize("NFKD", char)[0]
    if base.isascii():
        return base.encode().translate(_TABLE)
    if 0x300 <= ord(char) < 0x370:  # an accent without a composed letter
        return b""
    return b"\0" if unicodedata.category(char)[0] in "PZCN" else bytes([_LATIN + ord(char) % _OTHERS])


def unit_of(token: bytes) -> bytes:
    """A lower-case token as letter numbers; what is no letter is a gap, and
    gaps at the ends are cut off."""
    if token.isascii():
        return token.translate(_TABLE).strip(b"\0")
    text = unicodedata.normalize("NFKC", token.decode("utf-8", "replace")).lower()
    return b"".join(map(_symbols, unicodedata.normalize("NFC", text))).strip(b"\0")


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of three in ``n`` letters, and their weights."""
    i, j, k = np.array(
        [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + _SPAN + 1)) for j in range(i + 1, k)], dtype=int
    ).T
    return i, j, k, (_DECAY ** (k - i - 2.0)).astype(np.float32)


def _windows(unit: bytes) -> list[bytes]:
    if len(unit) <= _WINDOW:
        return [unit]
    return [unit[a : a + _WINDOW] for a in range(0, len(unit) - _WINDOW + _STRIDE, _STRIDE)]


def _codes(a: np.ndarray, b: np.ndarray, d: np.ndarray, latin: bool) -> np.ndarray:
    """Places of triples of letters in a vector of subsequences."""
    plain = (a * _LATIN + b) * _LATIN + d
    if latin:
        return plain
    mixed = ((a << 16 | b << 8 | d).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - _HASHED)
    return np.where((a < _LATIN) & (b < _LATIN) & (d < _LATIN), plain, _LATIN**3 + mixed.astype(np.int32))


def _subsequences(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, codes, weights)`` for the units of each length; a subsequence
    with a gap in it has weight 0."""
    length = np.array([len(u) for u in units])
    for n in np.unique(length[length >= 3]):
        i, j, k, weight = _triples(int(n))
        mine = np.flatnonzero(length == n)
        for part in np.array_split(mine, max(1, len(mine) * len(i) // 100_000)):
            c = np.frombuffer(b"".join([units[r] for r in part]), np.uint8).reshape(-1, n).astype(np.int32)
            a, b, d = c[:, i], c[:, j], c[:, k]
            yield part, _codes(a, b, d, bool(c.max() < _LATIN)), np.where((a > 0) & (b > 0) & (d > 0), weight, np.float32(0))


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each row's vector of subsequences."""
    order = np.argsort(codes, axis=1, kind="stable")
    codes, weights = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    starts = np.flatnonzero(new.ravel())
    squares = np.add.reduceat(weights.ravel().astype(float), starts) ** 2
    return np.sqrt(np.bincount(starts // codes.shape[1], squares, minlength=len(codes)))


class Landmarks:
    """Normalised vectors of a few units over the subsequences that occur in them."""

    def __init__(self, units: list[bytes]):
        self.units = tuple(units)
        found = list(_subsequences(units))
        self.codes = np.unique(np.concatenate([c.ravel() for _, c, _ in found] or [np.zeros(0, np.int32)]))
        self.table = np.zeros((len(self.codes), len(units)))
        for rows, codes, weights in found:
            at = np.searchsorted(self.codes, codes)
            np.add.at(self.table, (at, np.broadcast_to(rows[:, None], at.shape)), weights)
        length = np.linalg.norm(self.table, axis=0)
        self.table /= np.where(length > 0, length, 1.0)

    def kernel(self, units: list[bytes]) -> np.ndarray:
        """Normalised kernel of every unit with every landmark."""
        place = np.full(_TRIPLES, len(self.codes), dtype=np.int32)
        place[self.codes] = np.arange(len(self.codes))
        table = np.vstack([self.table, np.zeros((1, len(self.units)))]).astype(np.float32)
        out = np.zeros((len(units), len(self.units)))
        for rows, codes, weights in _subsequences(units):
            norms = _norms(codes, weights)
            for part in np.array_split(np.arange(len(rows)), max(1, codes.size // 20_000)):
                raw = np.einsum("rt,rtl->rl", weights[part], table[place[codes[part]]])
                out[rows[part]] = raw / np.where(norms[part] > 0, norms[part], 1.0)[:, None]
        return out

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Weight of every subsequence from the weights of the landmarks."""
        out = np.zeros(_TRIPLES)
        out[self.codes] = self.table @ weights
        return out


def kernel(units: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel of every unit with every landmark."""
    return Landmarks(landmarks).kernel(units)


def _single(token: bytes) -> bool:
    """Whether a token is one character."""
    head = token[0]
    return len(token) == (1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4)


def _spelled(tokens: list[bytes]) -> list[bytes]:
    """Runs of single letters, each as one token with gaps."""
    runs, run = [], []
    for token in [*tokens, b""]:
        if token and _single(token) and unit_of(token):
            run.append(token)
        else:
            if len(run) >= _SPELLED:
                runs.append(b" ".join(run))
            run = []
    return runs


def _tokens(text: bytes) -> list[bytes]:
    tokens = text.lower().split()
    return tokens + _spelled(tokens) if _has_spelled(tokens, text.isascii()) else tokens


def _has_spelled(tokens: list[bytes], ascii_only: bool) -> bool:
    if ascii_only:
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    else:
        single = np.fromiter((len(t) <= 4 and _single(t) for t in tokens), bool, len(tokens))
    return bool(len(single) >= _SPELLED and (np.convolve(single, np.ones(_SPELLED, int), "valid") == _SPELLED).any())


class _Margins(dict):
    """Margin of each token, remembered up to a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.value = weights.astype(np.float32), np.zeros(0)

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Largest margin of each text's tokens, 0 at least, and that token's unit."""
        if len(self) > _REMEMBERED:
            self.clear()
            self.value = np.zeros(0)
        codes = [np.fromiter(map(self.__getitem__, t), np.int64, len(t)) for t in map(_tokens, texts)]
        if len(self) > len(self.value):
            fresh = list(self)[len(self.value) :]
            self.value = np.concatenate([self.value, self._evaluate(fresh)])
        best = [int(c[self.value[c].argmax()]) if len(c) else -1 for c in codes]
        tokens = list(self)
        units = [max(_windows(unit_of(tokens[b])), key=len) if b >= 0 else b"" for b in best]
        return np.array([self.value[b] if b >= 0 else 0.0 for b in best]), units

    def _evaluate(self, tokens: list[bytes]) -> np.ndarray:
        distinct: dict[bytes, int] = {}
        owner = [[distinct.setdefault(w, len(distinct)) for w in _windows(unit_of(t))] for t in tokens]
        units = list(distinct)
        margin = np.zeros(len(units) + 1)
        for rows, codes, weights in _subsequences(units):
            raw = (self.weights[codes] * weights).sum(axis=1)
            good = np.flatnonzero(raw > 0)
            if len(good):
                margin[rows[good]] = raw[good] / _norms(codes[good], weights[good])
        return np.array([max(margin[i] for i in o) for o in owner])


def _features(counts: DataFrame, landmarks: Landmarks, whiten: np.ndarray) -> DataFrame:
    """``(unit, positive, negative, x)``: the Nyström features of every word, on the executors."""
    shared = counts.sparkSession.sparkContext.broadcast((landmarks, whiten))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, turn = shared.value
        for batch in batches:
            x = (marks.kernel(batch.column("unit").to_pylist()) @ turn).astype("<f4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=[*batch.schema.names, "x"])

    rows = counts.select("unit", "positive", "negative")
    return rows.mapInArrow(project, "unit binary, positive long, negative long, x binary")


def _hinge_sums(features: DataFrame, w: np.ndarray, worst: dict[bytes, int] | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the squared hinge over all words. A task sends back
    one matrix of the features' size. ``worst`` replaces the positive counts."""
    d, place = len(w), features.columns.index("x")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, hessian = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in (part for whole in batches for part in slices(whole, place, SUM_BYTES)):
            x = np.frombuffer(b"".join(batch.column(place).to_pylist()), "<f4").reshape(batch.num_rows, d - 1)
            x = np.hstack([x, np.ones((len(x), 1))])
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(float)
            if worst is not None:
                positive = np.array([worst.get(u, 0) for u in batch.column("unit").to_pylist()], dtype=float)
            negative = batch.column("negative").to_numpy(zero_copy_only=False).astype(float)
            f = x @ w
            loss += float((positive * np.maximum(0, 1 - f) ** 2 + negative * np.maximum(0, 1 + f) ** 2).sum())
            p, n = positive * (f < 1), negative * (f > -1)
            # Words beyond the hinge have weight 0 in both sums.
            near = np.flatnonzero(p + n)
            x, p, n, f = x[near], p[near], n[near], f[near]
            gradient += 2 * x.T @ (p * (f - 1) + n * (f + 1))
            hessian += 2 * (x * (p + n)[:, None]).T @ x
        sums = np.concatenate([[loss], gradient, hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    parts = features.mapInArrow(add, "sums binary").toArrow().column("sums").to_pylist()
    total = sum((np.frombuffer(part) for part in parts), np.zeros(1 + d + d * d))
    return float(total[0]), total[1 : d + 1], total[d + 1 :].reshape(d, d)


def _fit_svm(features: DataFrame, start: np.ndarray, worst: dict[bytes, int] | None, c: float = 1.0) -> np.ndarray:
    """Squared hinge loss by Newton steps from ``start``, a job each; the last weight is
    the intercept. The loss is convex: ``start`` decides the number of steps only."""
    ridge = np.eye(len(start))
    ridge[-1, -1] = 1e-6

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = _hinge_sums(features, v, worst)
        return 0.5 * v @ ridge @ v + c * loss, ridge @ v + c * gradient, ridge + c * hessian

    w = start
    now = at(w)
    for _ in range(50):
        step, scale = np.linalg.solve(now[2], now[1]), 1.0
        after = at(w - step)
        while scale > 1e-4 and after[0] > now[0]:
            scale /= 2
            after = at(w - scale * step)
        gained = now[0] - after[0]
        w, now = w - scale * step, after
        if gained <= 1e-7 * abs(now[0]) or np.abs(scale * step).max() < 1e-5:
            break
    return w


def _fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, lightly held near 0."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + 1e-3 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the subsequences, and the curve from margin to score."""

    weights: np.ndarray
    slope: float
    offset: float
    #: The landmarks and their weights: a word's margin is the sum of weight times kernel.
    landmarks: tuple[bytes, ...] = ()
    landmark_weights: np.ndarray | None = None

    def margins(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(doc, margin, unit)`` of every row: its worst word, with margin 0 at least."""
        base = texts_of(docs, id_col, text_col).select("doc", F.encode("body", "UTF-8").alias("body"))
        weights = self.weights.astype(np.float32)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            margins = _Margins(weights)
            for whole in batches:
                for batch in slices(whole, 1, BATCH_BYTES):
                    found, units = margins.of(batch.column(1).to_pylist())
                    columns = [batch.column(0), pa.array(found), pa.array(units, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "margin", "unit"])

        kind = base.schema["doc"].dataType.simpleString()
        return base.mapInArrow(rate, f"doc {kind}, margin double, unit binary")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, ``score`` from 0 to 1 and ``predicted`` for every row.

        A NULL, empty or wordless text has margin 0 and so the score of a text
        without a suspicious word. Repeated rows are scored each on their own;
        an empty table gives no rows.
        """
        score = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("margin") + F.lit(self.offset))))
        rated = self.margins(docs, id_col, text_col).withColumn("score", score)
        return rated.select(F.col("doc").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def without_toxic(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that are not predicted to be toxic, with all their
        columns; a narrow map."""
        weights, limit = self.weights.astype(np.float32), -self.offset / self.slope if self.slope > 0 else np.inf
        place = docs.columns.index(text_col)
        none = self.offset >= 0 and not self.slope > 0

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            margins = _Margins(weights)
            for whole in batches:
                for batch in slices(whole, place, BATCH_BYTES):
                    texts = [t.encode("utf-8") if t else b"" for t in batch.column(place).to_pylist()]
                    found, _ = margins.of(texts)
                    yield batch.filter(pa.array(np.zeros(len(found), bool) if none else found < limit))

        return docs.mapInArrow(clean, docs.schema)


def _label_counts(texts: DataFrame) -> DataFrame:
    """``(part, unit, positive, negative)``: sentences of either label with a word,
    and, with ``part``, texts of either label with a stretch of four letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH_BYTES)):
            tally: dict[tuple[bool, bytes], list[int]] = {}
            for text, label in zip(batch.column("body").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen = set()
                for sentence in sentences(text):
                    units = {w for u in map(unit_of, _tokens(sentence)) if len(u) >= 3 for w in _windows(u)}
                    seen |= units
                    for unit in units:
                        tally.setdefault((False, unit), [0, 0])[1 - label] += 1
                for part in {u[i : i + 4] for u in seen for i in range(len(u) - 3)}:
                    if 0 not in part:
                        tally.setdefault((True, part), [0, 0])[1 - label] += 1
            columns = [pa.array([k[0] for k in tally]), pa.array([k[1] for k in tally], pa.binary())]
            columns += [pa.array([v[i] for v in tally.values()], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "unit", "positive", "negative"])

    rows = texts.mapInArrow(count, "part boolean, unit binary, positive long, negative long")
    sums = [F.sum(c).alias(c) for c in ("positive", "negative")]
    return rows.groupBy("part", "unit").agg(*sums)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_texts: int = FIT_TEXTS,
) -> ToxicityModel:
    """Fit on the labelled texts whose id satisfies ``train`` (over ``doc``).

    At most about ``fit_texts`` of them are used, chosen by a hash of the id, and
    every word of these: its features are computed and stored by the executors, and a
    Newton step brings back one matrix a task. What else reaches the driver is one
    margin a text. NULL labels are left out; of several labels of one id the
    largest counts. Without any labelled text every score is 0; with one class
    alone it is that class's.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & train).groupBy("doc").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, fit_texts / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000))
    base = texts_of(docs, id_col, text_col)
    # About ``fit_texts`` ids and labels: a bounded broadcast.
    texts = base.join(F.broadcast(chosen), "doc").select("doc", F.encode("body", "UTF-8").alias("body"), "label")
    texts = stored(texts, "labelled")
    classes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n_texts, toxic = sum(classes.values()), classes.get(1, 0)
    if toxic in (0, n_texts):
        return ToxicityModel(np.zeros(_TRIPLES), 0.0, 700.0 if toxic else -700.0)
    counts = stored(_label_counts(texts), "label-counts")
    both = F.col("positive") + F.col("negative")
    rate = toxic / n_texts
    excess = (F.col("positive") - rate * both) / F.sqrt(rate * both + 1)
    words = counts.filter("not part")
    telling = [
        bytes(r["unit"])
        for rows in (counts.filter("part"), words)
        for r in rows.orderBy(excess.desc(), "unit").limit(TELLING).collect()
    ]
    frequent = [bytes(r["unit"]) for r in words.orderBy(both.desc(), "unit").limit(FREQUENT).collect()]
    landmarks = Landmarks(list(dict.fromkeys([*telling, *frequent])))
    value, vector = np.linalg.eigh(landmarks.table.T @ landmarks.table)
    usable = value > 1e-6 * value.max()
    whiten = vector[:, usable] / np.sqrt(value[usable])
    features = stored(_features(words, landmarks, whiten), "word-features")
    body = texts.withColumn("body", F.decode("body", "UTF-8"))
    worst, w = None, np.zeros(whiten.shape[1] + 1)
    # A toxic text need not be toxic in every word: after the first fit only the
    # worst word of each toxic text counts for the label, as in a multiple-instance SVM.
    for _ in range(REFITS + 1):
        w = _fit_svm(features, w, worst)
        given = whiten @ w[:-1]
        model = ToxicityModel(landmarks.spread(given), 0.0, 0.0, landmarks.units, given)
        margins = stored(model.margins(body, "doc", "body").join(texts.select("doc", "label"), "doc"), "margins")
        # At most a word per toxic text of the fit.
        found = margins.filter("label = 1 and margin > 0").groupBy("unit").count().collect()
        worst = {bytes(r["unit"]): r["count"] for r in found}
    pairs = margins.select("margin", "label").collect()
    slope, offset = _fit_curve(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], dtype=float))
    return replace(model, slope=slope, offset=offset)
