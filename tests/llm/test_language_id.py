"""Kneser-Ney character models against a plain recursion, and their predictions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.llm import language_id
from reviewfold.llm.language_id import CharModels, WordScores, fit_language_id, words_of

class Recursion:
    """Interpolated Kneser-Ney of one language by its definition."""

    def __init__(self, words, order, n_symbols):
        self.order, self.uniform = order, 1.0 / (n_symbols + 1)
        raw = defaultdict(Counter)
        for word, n in words.items():
            padded = f" {word} "
            for i in range(1, len(padded)):
                for k in range(1, min(i + 1, order) + 1):
                    raw[k][padded[i - k + 1 : i + 1]] += n
        self.count = {}
        for k in range(1, order + 1):
            neighbours = Counter(g[1:] for g in raw[k + 1]) if k < order else None
            first = lambda g: k > 1 and g[0] == " "  # noqa: B023, E731
            self.count[k] = {g: n if neighbours is None or first(g) else neighbours[g] for g, n in raw[k].items()}

    def probability(self, context, symbol):
        k = len(context) + 1
        own = self.count[k]
        follow = {g[-1]: n for g, n in own.items() if g[:-1] == context}
        lower = self.probability(context[1:], symbol) if context else self.uniform
        if not follow:
            return lower
        once, twice = (sum(n == c for n in own.values()) for c in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        total = sum(follow.values())
        return max(follow.get(symbol, 0) - d, 0) / total + d * len(follow) / total * lower

    def word(self, word):
        padded = f" {word} "
        return sum(math.log(self.probability(padded[max(0, i - self.order + 1) : i], padded[i])) for i in range(1, len(padded)))


def sentences(letters, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(12)) + "." for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, t, "aa") for i, t in enumerate(sentences("abcdeé", 250, 1))]
    rows += [(300 + i, t, "bb") for i, t in enumerate(sentences("abxyzü", 250, 2))]
    rows += [(600 + i, t, None) for i, t in enumerate(sentences("mno", 5, 3))] + [(700, None, "aa"), (701, "", "bb")]
    return rows, fit_language_id(frame(spark, rows), F.lit(True), order=4)


def test_scores_equal_the_recursion(spark, learned, monkeypatch):
    rows = [r for r in learned[0] if r[0] % 300 < 60]
    held = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[1] and r[2]], "doc long, body string, lang string")
    # Everything is counted, nothing is held back.
    monkeypatch.setattr(language_id, "CALIBRATE", 1 << 40)
    model = fit_language_id(held, F.lit(True), "doc", "body", order=4).models
    words = defaultdict(Counter)
    for r in rows:
        if r[1] and r[2]:
            for part in words_of(r[1]):
                words[r[2]].update(part)
    n_symbols = len({c for w in words.values() for word in w for c in word + " "})
    plain = [Recursion(words[lang], 4, n_symbols) for lang in model.langs]
    asked = ["a", "abc", "xyzü", "éé", "qq", "aqb", *list(words["aa"])[:30], *list(words["bb"])[:30]]
    scores, symbols = model.word_scores(asked)
    assert symbols.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(scores, [[p.word(w) for p in plain] for w in asked], rtol=0, atol=1e-9)
    for p in plain:  # every context's probabilities sum to 1, an unknown symbol's included
        symbols = sorted({c for w in words.values() for word in w for c in word + " "})
        for context in ("", " ", "a", " a", "ab", "zz", "abc"):
            assert sum(p.probability(context, c) for c in symbols) + p.probability(context, "?") == pytest.approx(1)


def test_predicts_held_out_texts(spark, learned):
    _, model = learned
    rows = [(i, t, "aa") for i, t in enumerate(sentences("abcdeé", 40, 7))]
    rows += [(100 + i, t.upper(), "bb") for i, t in enumerate(sentences("abxyzü", 40, 8))]
    got = model.predict(frame(spark, rows)).join(frame(spark, rows), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 78
    assert all(0 <= r.score <= 1 for r in got)
    foreign = model.predict(frame(spark, [(i, t, None) for i, t in enumerate(sentences("opqrst", 10, 9))])).collect()
    assert all(r.rejected for r in foreign)
    assert sum(r.rejected for r in got) <= 4


def test_awkward_texts(spark, learned):
    _, model = learned
    long = " ".join(sentences("abcdeé", 400, 4))
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 ½ ... !", "bb"), (4, long, "aa"), (5, "b" * 20_000, "aa"), (6, "abc", None), (6, "abc", None), (None, "zyx", None)]
    got = {(r.doc_id, r.lang_pred, r.cross_entropy is None) for r in model.predict(frame(spark, rows).withColumn("score", F.lit("x"))).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (None, "bb", False)} <= got
    assert model.predict(frame(spark, rows)).count() == 8
    assert model.predict(frame(spark, [])).count() == 0
    few = model.predict(frame(spark, rows[:3])).collect()
    assert all(r.score == 0 and r.lang_pred == "und" for r in few)


def test_parts_do_not_cut_words(monkeypatch):
    text = " ".join(sentences("abcdeé", 40, 4)) + " ½ 中文字 Ⅷ x2y İstanbul"
    whole = [w for part in words_of(text) for w in part]
    monkeypatch.setattr(language_id, "PART_CHARS", 50)
    assert [w for part in words_of(text) for w in part] == whole
    assert len(list(words_of(text))) > 10
    assert {"中文字", "x", "y"} <= set(whole)


def test_one_language_or_none(spark):
    rows = [(i, t, "aa") for i, t in enumerate(sentences("abc", 30, 5))]
    only = fit_language_id(frame(spark, rows), F.lit(True))
    assert {r.lang_pred for r in only.predict(frame(spark, rows)).collect()} == {"aa"}
    for empty in ([], [(1, None, "aa")], [(1, "word", None)]):
        model = fit_language_id(frame(spark, empty), F.lit(True))
        assert [(r.lang_pred, r.score) for r in model.predict(frame(spark, rows[:1])).collect()] == [("und", 0.0)]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "REMEMBERED", 3)
    keys = np.sort(language_id._gram_hashes(["a", " "], 1))
    models = CharModels(("x",), ((keys, np.log([[0.5], [0.25]])),), ((keys[:0], np.zeros((0, 1))),), np.log([0.01]), 1.0)
    scores = WordScores(models)
    first = scores.of(["a aa aaa aaaa aaaaa", "b"])
    assert not scores.number
    again = scores.of(["a aa aaa aaaa aaaaa", "b"])
    assert np.array_equal(first[0], again[0]) and np.array_equal(first[1], again[1])
