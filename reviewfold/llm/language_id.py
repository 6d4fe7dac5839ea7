"""Language of a text by interpolated Kneser-Ney models of characters.

A model reads the words of a text, each between two blanks: the first is only
context, the last is predicted like a letter. The n-gram counts, continuation
counts, discounts and context totals of every language come from Spark
aggregations over a bounded sample of labelled texts. The finished model holds
one sorted array of 64-bit hashes per order, shared by all languages, with the
log probability of each n-gram per language, and another one of context hashes
with the log of the mass left for lower orders. A text goes to the language with
the lowest cross-entropy per predicted symbol.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.llm.common import slices, stored, texts_of
from reviewfold.operators.skew import skew_join

ORDER = 5
#: Bytes of labelled text a language is learned from, about, and all languages together.
FIT_BYTES = 4 << 20
FIT_TOTAL = 64 << 20
#: One labelled text in so many calibrates the score and the rejection.
CALIBRATE = 5
#: Share of the calibrating texts of a language that its rejection bound accepts.
ACCEPTED = 0.995
UNKNOWN = "und"
BATCH_BYTES = 8 << 20
#: Longer texts are read in parts of about so many characters, longer words as several words.
PART_CHARS, WORD_CHARS = 1 << 20, 1 << 12
#: Distinct words a worker remembers, and their characters; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16 << 20

_ASCII_WORD = re.compile("[a-z]+")
_WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_BREAK = regex.compile(r"[^\p{L}\p{M}]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Iterator[list[str]]:
    """Runs of letters and their marks, lower case, in lists that stay small."""
    start = 0
    while start < len(text):
        found = _BREAK.search(text, start + PART_CHARS) if len(text) - start > PART_CHARS else None
        stop = found.end() if found else len(text)
        part = text[start:stop].lower()
        if part.isascii():
            words = _ASCII_WORD.findall(part)
        else:
            words = _WORD.findall(part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part))
        if any(len(w) > WORD_CHARS for w in words):
            words = [w[a : a + WORD_CHARS] for w in words for a in range(0, len(w), WORD_CHARS)]
        yield words
        start = stop


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (code + np.uint64(1))) * _PRIME
        return h ^ (h >> np.uint64(29))


def _gram_hashes(grams: list[str], size: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.uint64)
    h = np.full(len(codes), size, dtype=np.uint64)
    for j in range(size - 1, -1, -1):  # from the last character back, so that longer n-grams extend shorter ones
        h = _mixed(h, codes[:, j])
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted ``keys``; -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class CharModels:
    """Sorted hash arrays of all languages: per order the n-grams with their log
    probabilities (NaN: not seen in that language) and the contexts with the log of
    the mass they leave (0: not seen)."""

    langs: tuple[str, ...]
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]
    contexts: tuple[tuple[np.ndarray, np.ndarray], ...]
    base: np.ndarray
    uniform: float

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every word per language, and its number of predicted symbols."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        out = np.zeros((len(words), len(self.langs)))
        ends = np.cumsum(length)
        start = 0
        while start < len(words):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + (1 << 17), "right")))
            out[start:stop] = self._score(words[start:stop], length[start:stop])
            start = stop
        return out, length

    def _score(self, words: list[str], length: np.ndarray) -> np.ndarray:
        raw = (" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).astype(np.uint64)
        # A blank between two words ends the one and begins the next.
        first = np.cumsum(length) - length
        at = np.arange(1, len(codes))
        within = at - np.repeat(first, length)  # symbols of context that the word gives
        probs, previous = None, None
        for k in range(1, len(self.grams) + 1):
            rows = np.flatnonzero(within >= k - 1)
            # Hash of the k symbols that end at each position.
            h = np.full(len(rows), k, dtype=np.uint64)
            for j in range(k):
                h = _mixed(h, codes[at[rows] - j])
            keys, values = self.grams[k - 1]
            place = _find(keys, h)
            seen = values[place] if len(keys) else np.full((len(rows), len(self.langs)), np.nan)
            seen = np.where((place >= 0)[:, None], seen, np.nan)
            if k == 1:
                lower = np.broadcast_to(self.base, seen.shape)
                probs = np.where(np.isnan(seen), lower, seen)
                continue
            previous = np.full(len(rows), k - 1, dtype=np.uint64)
            for j in range(1, k):
                previous = _mixed(previous, codes[at[rows] - j])
            keys, left = self.contexts[k - 1]
            place = _find(keys, previous)
            rest = np.where((place >= 0)[:, None], left[place], 0.0) if len(keys) else 0.0
            probs[rows] = np.where(np.isnan(seen), probs[rows] + rest, seen)
        return np.add.reduceat(probs, first, axis=0)


class WordScores:
    """Scores texts word by word; a distinct word is scored once and remembered up to a bound."""

    def __init__(self, models: CharModels):
        self.models = models
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = _Numbering()
        self.scores, self.symbols = np.zeros((0, len(self.models.langs))), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of a symbol per text and language, and the
        number of symbols: 0 for a text without a letter."""
        number = self.number
        known = len(number)
        parts: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            for words in words_of(text or ""):
                parts.append((i, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
        fresh = list(itertools.islice(number, known, None))
        if fresh:
            scores, symbols = self.models.word_scores(fresh)
            self.scores, self.symbols = np.concatenate([self.scores, scores]), np.concatenate([self.symbols, symbols])
        sums, sizes = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        for i, codes in parts:
            sums[i] += self.scores[codes].sum(axis=0)
            sizes[i] += self.symbols[codes].sum()
        if len(number) > REMEMBERED or sum(map(len, fresh)) + self.symbols.sum() > REMEMBERED_CHARS:
            self._forget()
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def _gram_counts(words: DataFrame, order: int) -> DataFrame:
    """``(lang, k, gram, c)``: occurrences of the n-grams of the highest order and of
    those that begin a word, and numbers of distinct left neighbours of the others."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    at = F.sequence(F.lit(2), F.length("word") + 2)
    sizes = lambda i: F.sequence(F.lit(1), F.least(i, F.lit(order)))
    grams = F.flatten(F.transform(at, lambda i: F.transform(sizes(i), lambda k: F.substring(padded, i - k + 1, k))))
    raw = words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    raw = stored(raw.withColumn("k", F.length("gram")), "grams")
    counted = raw.filter((F.col("k") == order) | ((F.col("k") > 1) & F.col("gram").startswith(" ")))
    followed = raw.filter("k > 1").groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    followed = followed.select("lang", F.length("gram").alias("k"), "gram", "c")
    return counted.select("lang", "k", "gram", "c").unionByName(followed)


def _shares(counts: DataFrame) -> DataFrame:
    """``(lang, k, gram, own, left)``: what the n-gram's own count gives, and the mass
    its context leaves to the next lower order."""
    by = Window.partitionBy("lang", "k", F.expr("substring(gram, 1, k - 1)"))
    once, twice = (F.count(F.when(F.col("c") == c, 1)) for c in (1, 2))
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75)
    discounts = counts.groupBy("lang", "k").agg(discount.alias("d"))
    # A row per language and order, and a window over the symbols that follow one context.
    rated = counts.join(discounts, ["lang", "k"])
    total = F.sum("c").over(by)
    return rated.select(
        "lang",
        "k",
        "gram",
        (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / total).alias("own"),
        (F.col("d") * F.count(F.lit(1)).over(by) / total).alias("left"),
    )


def _models(shares: pa.Table, langs: tuple[str, ...], order: int) -> CharModels:
    """Interpolate from the lowest order up and sort by hash."""
    code = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([code[x] for x in shares.column("lang").to_pylist()], dtype=np.int64)
    size = shares.column("k").to_numpy()
    own, left = shares.column("own").to_numpy(), shares.column("left").to_numpy()
    texts = np.array(shares.column("gram").to_pylist(), dtype=object)
    n_symbols = len(set(texts[size == 1]))
    uniform = 1.0 / (n_symbols + 1)
    base = np.full(len(langs), uniform)
    grams, contexts = [], []
    keys, probs = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    for k in range(1, order + 1):
        mine = np.flatnonzero(size == k)
        named, who = list(texts[mine]), lang[mine]
        h = _gram_hashes(named, k)
        lower = np.full(len(mine), uniform) if k == 1 else probs[_find(keys, _gram_hashes([g[1:] for g in named], k - 1)), who]
        value = own[mine] + left[mine] * lower
        keys, where = np.unique(h, return_inverse=True)
        probs = np.full((len(keys), len(langs)), np.nan)
        probs[where, who] = value
        grams.append((keys, np.log(probs)))
        if k == 1:
            base[who] = uniform * left[mine]
            contexts.append((np.zeros(0, np.uint64), np.zeros((0, len(langs)))))
        else:
            before, where = np.unique(_gram_hashes([g[:-1] for g in named], k - 1), return_inverse=True)
            rest = np.zeros((len(before), len(langs)))
            rest[where, who] = np.log(left[mine])
            contexts.append((before, rest))
    return CharModels(langs, tuple(grams), tuple(contexts), np.log(base), -math.log(uniform))


def _word_counts(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, BATCH_BYTES):
                tally: dict[str, Counter] = {}
                for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for words in words_of(text):
                        tally.setdefault(lang, Counter()).update(words)
                rows = [(lang, w, n) for lang, found in tally.items() for w, n in found.items()]
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    rows = texts.select("body", "lang").mapInArrow(count, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _margin(entropies: np.ndarray, symbols: np.ndarray, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text, and how far it is ahead: per symbol, times the root of
    their number. A model that draws symbols evenly competes too."""
    best = entropies.argmin(axis=1)
    rows = np.arange(len(best))
    others = entropies.copy()
    others[rows, best] = uniform
    return best, (others.min(axis=1) - entropies[rows, best]) * np.sqrt(symbols)


def _fit_score(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from the margin to the chance of being right,
    with smoothed targets, so that the fit ends also without any error."""
    n = right.sum()
    target = np.where(right, (n + 1.0) / (n + 2.0), 1.0 / (len(right) - n + 2.0))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return max(float(w[0]), 1e-3), float(w[1])


@dataclass(frozen=True)
class LanguageModel:
    """Character models of the learned languages with the calibrated score and rejection."""

    models: CharModels
    slope: float
    offset: float
    #: Highest cross-entropy accepted per language: at one symbol's length and for ever.
    usual: np.ndarray
    slack: np.ndarray

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` of every row.

        The prediction is the language with the lowest cross-entropy per symbol of
        the whole text, ties to the first name; the score is the calibrated chance
        that it is right. ``rejected`` marks a text that looks unlike all learned
        languages: its cross-entropy is above the bound of its own language, or the
        score is below one half. NULL, an empty text and one without a letter get
        ``und``, score 0 and no cross-entropy, and so does every text if no language
        was learned. Repeated rows are read each on their own, other columns are
        ignored, an empty table gives no rows. A very long text is read in parts.
        """
        base = texts_of(docs, id_col, text_col)
        # A few MB: bounded by the texts the model was fitted on.
        shared = docs.sparkSession.sparkContext.broadcast(self)
        kind = base.schema["doc"].dataType.simpleString()

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: LanguageModel = shared.value
            words = WordScores(model.models)
            for whole in batches:
                for batch in slices(whole, 1, BATCH_BYTES):
                    named, score, entropy, rejected = model._rate(batch.column(1).to_pylist(), words)
                    columns = [batch.column(0), pa.array(named, pa.string()), pa.array(score), entropy, pa.array(rejected)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "lang_pred", "score", "cross_entropy", "rejected"])

        rated = base.mapInArrow(rate, f"doc {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
        return rated.withColumnRenamed("doc", id_col)

    def _rate(self, texts: list[str], words: WordScores) -> tuple[list[str], np.ndarray, pa.Array, np.ndarray]:
        if not self.models.langs:
            none = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), none, pa.nulls(len(texts), pa.float64()), none == 0
        entropies, symbols = words.of(texts)
        best, margin = _margin(entropies, symbols, self.models.uniform)
        lettered = symbols > 0
        score = np.where(lettered, 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700))), 0.0)
        lowest = entropies[np.arange(len(best)), best]
        bound = self.usual[best] + self.slack[best] / np.sqrt(np.maximum(symbols, 1))
        named = [self.models.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return named, score, pa.array(lowest, mask=~lettered), (score < 0.5) | (lowest > bound)


def fit_language_id(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    fit_bytes: int = FIT_BYTES,
) -> LanguageModel:
    """Learn from the texts with a language whose id satisfies ``train`` (over ``doc``).

    Of every language about ``fit_bytes`` of whole texts are read (all languages
    together ``FIT_TOTAL``), chosen by a hash, and none that is longer by itself; so
    the model's size is bounded however large the table is. One of ``CALIBRATE`` of
    them is left out of the counts and calibrates the score and the bounds of
    rejection. Without any such text no language is learned. Hash collisions
    (64 bits) are not told apart.
    """
    known = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        F.col(f"`{text_col}`").cast("string").alias("body"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).filter(train & F.col("lang").isNotNull() & F.col("body").isNotNull())
    size = F.octet_length("body").cast("long")
    known = known.filter(size <= fit_bytes)
    totals = stored(known.groupBy("lang").agg(F.sum(size).alias("bytes"), F.max(F.octet_length("lang")).alias("width")), "lang-bytes")
    n_langs, width = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    allowed = min(fit_bytes, FIT_TOTAL // max(1, n_langs))
    share = F.least(F.lit(1.0), F.lit(float(allowed)) / F.greatest("bytes", F.lit(1)))
    shares = totals.select("lang", share.alias("share"))
    dealt = F.xxhash64("doc", "body")
    drawn = F.pmod(dealt, F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = skew_join(known, shares, "lang", right_bytes=int(width) + 64 * n_langs).filter(drawn)
    part = F.pmod(F.shiftright(dealt, 32), F.lit(CALIBRATE)) == 0
    sample = stored(sample.select("body", "lang", part.alias("held")), "lang-sample")
    counts = stored(_word_counts(sample.filter("not held")), "lang-words")
    langs = tuple(sorted(r[0] for r in counts.select("lang").distinct().collect()))
    none = np.zeros(0)
    if not langs:
        empty = CharModels((), (), (), none, 0.0)
        return LanguageModel(empty, 1.0, 0.0, none, none)
    models = _models(_shares(_gram_counts(counts, order)).toArrow(), langs, order)
    return _calibrated(models, sample.filter("held"))


def _calibrated(models: CharModels, held: DataFrame) -> LanguageModel:
    """Rate the held-out part of the sample; a row of four numbers a text comes back."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(shared.value)
        code = {lang: i for i, lang in enumerate(shared.value.langs)}
        for whole in batches:
            for batch in slices(whole, 0, BATCH_BYTES):
                entropies, symbols = words.of(batch.column(0).to_pylist())
                truth = np.array([code.get(x, -1) for x in batch.column(1).to_pylist()])
                best, margin = _margin(entropies, symbols, shared.value.uniform)
                own = np.where(truth >= 0, entropies[np.arange(len(truth)), truth], np.nan)
                columns = [pa.array(x)[0:] for x in (margin, best == truth, truth, own, symbols)]
                table = pa.RecordBatch.from_arrays(columns, names=["margin", "right", "truth", "own", "symbols"])
                yield table.filter(pa.array(symbols > 0))

    rows = held.select("body", "lang").mapInArrow(rate, "margin double, right boolean, truth long, own double, symbols long").toArrow()
    margin, right, truth, own, symbols = (rows.column(c).to_numpy() for c in rows.column_names)
    slope, offset = _fit_score(margin, right.astype(bool)) if len(margin) else (1.0, 0.0)
    usual, slack = np.full(len(models.langs), np.inf), np.zeros(len(models.langs))
    for i in range(len(models.langs)):
        mine = truth == i
        if mine.sum() >= 2:
            usual[i] = np.average(own[mine], weights=symbols[mine])
            slack[i] = np.quantile((own[mine] - usual[i]) * np.sqrt(symbols[mine]), ACCEPTED)
    return LanguageModel(models, slope, offset, usual, np.maximum(slack, 0.0))


class _Numbering(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number
