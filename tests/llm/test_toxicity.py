"""The string kernel against its definition, and the model on labelled texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.llm.toxicity import _DECAY, _SPAN, fit_toxicity, kernel, unit_of
from tests.llm.samples import documents, words


def plain_kernel(a: bytes, b: bytes) -> float:
    def features(u):
        found = {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + _SPAN + 1)):
                    if u[i] and u[j] and u[k]:
                        key = (u[i], u[j], u[k])
                        found[key] = found.get(key, 0.0) + _DECAY ** (k - i - 2)
        return found

    x, y = features(a), features(b)
    dot = sum(v * y.get(k, 0.0) for k, v in x.items())
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return dot / size if size else 0.0


def test_kernel_equals_its_definition():
    units = [unit_of(w) for w in (b"idiot", b"id.iot", b"idiotic", b"banana", b"aaaa", b"ab", b"", b"x9y8z", "étéé".encode())]
    got = kernel(units, units)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-5)


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text = words(i, 60)
        toxic = i % 4 == 0
        if toxic:
            at = text.split()
            at.insert(rng.randrange(60), rng.choice(["wretchling", "scumbag", "dunderhead"]))
            text = " ".join(at)
        rows.append((i, text))
        labels.append((i, int(toxic), "x"))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, label string")


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = labelled(spark)
    return fit_toxicity(documents(spark, rows), labels, train=F.col("doc") % 5 != 0)


def test_held_out_accuracy(spark, model):
    rows, _ = labelled(spark)
    scored = {r.doc_id: r for r in model.score(documents(spark, rows)).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    right = np.mean([scored[i].predicted == (i % 4 == 0) for i in held])
    assert right >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_gaps_and_awkward_texts(spark, model):
    texts = ["such a scum-bag", "s c u m b a g", "dunder.head!", "w.r.e.t.c.h.l.i.n.g", "a plain text", None, "", " \n", "x" * 30_000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.predicted for r in model.score(documents(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    kept = model.without_toxic(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]


SCRIPTS = {
    "cyrillic": ("абвгдежзиклмнопрстуфхцчшыьэюя", ["дурачина", "негодяй", "мерзавец"]),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", ["παλιάνθρωπος", "ηλίθιος", "κάθαρμα"]),
    "arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", ["احمقكبير", "وغدحقير", "سافلجدا"]),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_other_scripts(spark, script):
    letters, insults = SCRIPTS[script]
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices(letters, k=rng.randrange(2, 10))) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        text = rng.choices(vocabulary, k=40)
        if i % 4 == 0:
            text.insert(rng.randrange(40), rng.choice(insults))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    word = insults[1]
    rows += [(1000, f"{vocabulary[0]} {word.upper()}"), (1001, f"{word[:3]}.{word[3:]}"), (1002, " ".join(word)), (1003, vocabulary[1])]
    docs = documents(spark, rows)
    fitted = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train=F.col("doc") % 5 != 0)
    scored = {r.doc_id: r.predicted for r in fitted.score(docs).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert np.mean([scored[i] == (i % 4 == 0) for i in held]) >= 0.97
    assert [scored[i] for i in range(1000, 1004)] == [1, 1, 1, 0]


def test_letters_beyond_ascii():
    assert unit_of("café".encode()) == unit_of("cafe\u0301".encode()) == unit_of(b"cafe")
    assert unit_of("ДУРАК".encode()) == unit_of("дурак".encode()) != unit_of("дуран".encode())
    assert unit_of("«дурак»…".encode()) == unit_of("дурак".encode())


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_degenerate_labels(spark, labels, score):
    docs = documents(spark, [(1, "some text"), (2, None)])
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = fit_toxicity(docs, frame, train=F.lit(True)).score(docs).collect()
    assert [r.score for r in found] == [pytest.approx(score)] * 2


def test_empty_table(spark, model):
    assert model.score(documents(spark, [])).count() == 0
    assert model.without_toxic(documents(spark, [])).count() == 0


def test_margin_is_the_sum_over_landmarks(spark, model):
    """The weights per subsequence give what weights times kernels give."""
    tokens = ["wretchling", "wr.etchling", "scumbags", "dunderheaded", "banana", "étéwretch", "at"]
    got = {r.doc: r.margin for r in model.margins(documents(spark, list(enumerate(tokens))), "doc_id", "text").collect()}
    units = [unit_of(t.encode()) for t in tokens]
    plain = [sum(w * plain_kernel(u, m) for w, m in zip(model.landmark_weights, model.landmarks, strict=True)) for u in units]
    assert max(plain) > 0.5
    assert [got[i] for i in range(len(tokens))] == pytest.approx([max(0.0, p) for p in plain], abs=1e-4)


def test_newton_sums_equal_one_dense_product(spark):
    from reviewfold.llm.toxicity import _hinge_sums

    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(40, 5)).astype("<f4"), rng.normal(size=6)
    positive, negative = rng.integers(0, 3, 40), rng.integers(0, 3, 40)
    rows = [(bytes([65 + i]), int(p), int(n), r.tobytes()) for i, (p, n, r) in enumerate(zip(positive, negative, x, strict=True))]
    df = spark.createDataFrame(rows, "unit binary, positive long, negative long, x binary").repartition(3)
    full = np.hstack([x, np.ones((40, 1))])
    for worst in (None, {b"A": 4, b"C": 1}):
        p = positive if worst is None else np.array([worst.get(bytes([65 + i]), 0) for i in range(40)])
        f = full @ w
        loss, gradient, hessian = _hinge_sums(df, w, worst)
        assert loss == pytest.approx((p * np.maximum(0, 1 - f) ** 2 + negative * np.maximum(0, 1 + f) ** 2).sum())
        assert np.allclose(gradient, 2 * full.T @ (p * (f < 1) * (f - 1) + negative * (f > -1) * (f + 1)))
        assert np.allclose(hessian, 2 * (full * (p * (f < 1) + negative * (f > -1))[:, None]).T @ full)
