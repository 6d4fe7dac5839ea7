"""Logistic regression from tables against a dense Newton solution and single fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.operators import linear, models
from reviewfold.operators.split import holdout_split
from reviewfold.storage import new_path


def rows_of(n, seed):
    """Labels that follow some of the words, with noise and texts without words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        picked = rng.choices(words, weights=[1 / (k + 2) for k in range(40)], k=rng.choice([0, 3, 9, 20]))
        lean = sum(1 if int(w[1:]) % 3 == 0 else -1 if int(w[1:]) % 3 == 1 else 0 for w in picked)
        out.append((i * 7, " ".join(picked), float(lean + rng.gauss(0, 1.5) > 0)))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(rows_of(150, 5), "id bigint, text string, label double").cache()


def dense(rows, C, min_df=2, max_df=0.95):
    """Terms, weights and intercept by Newton steps on the dense matrix."""
    bags = []
    for _, text, _ in rows:
        words = [w for w in text.split() if len(w) > 1]
        bags.append(words + [" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)])
    df = {}
    for bag in bags:
        for term in set(bag):
            df[term] = df.get(term, 0) + 1
    terms = sorted(t for t, n in df.items() if min_df <= n <= max_df * len(rows))
    place = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms)))
    for r, bag in enumerate(bags):
        for term in bag:
            if term in place:
                x[r, place[term]] += np.log((1 + len(rows)) / (1 + df[term])) + 1
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.hstack([np.divide(x, length, out=np.zeros_like(x), where=length > 0), np.ones((len(rows), 1))])
    y, w = np.array([r[2] for r in rows]), np.zeros(len(terms) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) / len(rows) + w / (C * len(rows))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(rows) + np.eye(len(w)) / (C * len(rows))
        w = w - np.linalg.solve(hessian, gradient)
    return terms, w[:-1], w[-1]


def test_coefficients_equal_a_dense_solution(spark, texts):
    rows = sorted(map(tuple, texts.collect()))
    model = linear.fit_term_logistic(texts, "id", "text")
    terms, weights, intercept = dense(rows, 2.5)
    got = {r.term: r.weight for r in model.weights.collect()}
    assert sorted(got) == terms
    assert np.abs(np.array([got[t] for t in terms]) - weights).max() < 1e-6
    assert model.intercept == pytest.approx(intercept, abs=1e-6)


def test_all_runs_equal_single_fits(spark, texts, monkeypatch):
    """Each run's metrics are those of one fit on its own training rows, also when the
    runs are fitted in several lots and blocks."""
    together = [tuple(r) for r in linear.holdout_runs(texts, "id", "text", runs=5).collect()]
    assert [r[0] for r in together] == list(range(5)) and {r[1] for r in together} == {30}
    for run in (0, 3):
        train, test = holdout_split(texts, "id", 0.2, 22 + run)
        model = linear.fit_term_logistic(train, "id", "text")
        scored = model.score(test, "id", "text", ["label"])
        single = models.binary_metrics(scored, "label", "class").first()
        assert together[run][1:] == pytest.approx(tuple(single))
    monkeypatch.setattr(linear, "LOT_NUMBERS", 300)
    assert [tuple(r) for r in linear.holdout_runs(texts, "id", "text", runs=5).collect()] == together


def test_passes_do_not_grow_with_runs(texts, monkeypatch):
    counted = []
    plain = linear._sum_by_row
    monkeypatch.setattr(linear, "_sum_by_row", lambda *a: counted.append(1) or plain(*a))
    linear.holdout_runs(texts, "id", "text", runs=1).collect()
    one = len(counted)
    linear.holdout_runs(texts, "id", "text", runs=40).collect()
    assert len(counted) - one <= 2 * one


def test_small_blocks_and_slices(texts, monkeypatch):
    table = linear.Inverted.of(texts, "id", "text", "label", (), 1, 3, 2)
    member = np.random.default_rng(1).random((150, 3)) < 0.8
    whole = linear.fit_runs(table, member)
    monkeypatch.setattr(linear, "SLICE_NUMBERS", 20)
    assert np.allclose(linear.fit_runs(table, member).margins, whole.margins, atol=1e-6)
    assert whole.gradient.max() <= linear.TOLERANCE


def test_gradient_tells_the_minimum(spark, texts):
    model = linear.fit_term_logistic(texts, "id", "text")
    rows = model.gradient(texts, "id", "text", "label", 2.5).collect()
    assert len(rows) == model.weights.count() + 1 and sum(r.term is None for r in rows) == 1
    assert max(abs(r.gradient) for r in rows) < 1e-8
    off = linear.TermLogistic(model.weights.withColumn("weight", F.col("weight") + 0.01), model.intercept, model.n_texts)
    assert max(abs(r.gradient) for r in off.gradient(texts, "id", "text", "label", 2.5).collect()) > 1e-6


def test_scores_every_text_and_reloads(spark, texts):
    model = linear.fit_term_logistic(texts, "id", "text", stop_words=["w0"])
    assert not model.weights.filter("term = 'w0'").count()
    new = spark.createDataFrame([(1, None), (2, ""), (3, "unseen words"), (4, "w3 w3 w6"), (5, "w1 w4")], "id int, text string")
    got = {r.id: r for r in model.score(new, "id", "text").collect()}
    base = 1 / (1 + np.exp(-model.intercept))
    assert all(got[i].prob == pytest.approx(base) for i in (1, 2, 3)) and got[4].prob > got[5].prob
    path = new_path(spark, "term-model")
    model.save(path)
    again = {r.id: r for r in linear.TermLogistic.load(path).score(new, "id", "text").collect()}
    assert again == got


def test_attribution_is_the_gradient(texts):
    model = linear.fit_term_logistic(texts, "id", "text")
    one = texts.filter("id = 21")
    weights = {r.term: r.idf * r.weight for r in model.weights.collect()}
    p = model.score(one, "id", "text").first().prob
    rows = model.attribution(one, "id", "text").collect()
    assert rows and all(r.attribution == pytest.approx(p * (1 - p) * abs(weights[r.term])) for r in rows)


def test_awkward_inputs(spark, texts):
    assert linear.holdout_runs(texts.filter("id < 0"), "id", "text", 3).collect() == []
    with pytest.raises(ValueError, match="no labelled text"):
        linear.fit_term_logistic(texts.filter("id < 0"), "id", "text")
    with pytest.raises(ValueError, match="no term is left"):
        linear.fit_term_logistic(texts.filter("id = 0"), "id", "text")
    unlabelled = texts.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    assert linear.fit_term_logistic(unlabelled, "id", "text").n_texts == 75
    some = linear.bounded_rows(texts, "id", 50)
    assert 25 <= some.count() <= 80 and linear.bounded_rows(texts, "id", None).count() == 150


def test_tasks_of_a_pass_follow_the_cores(spark, texts):
    """Every task of a pass returns a number for each row, so more shuffle partitions
    may not mean more of them; the sums stay the same."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    member = np.ones((150, 1))
    found = []
    try:
        for parts in ("2", "40"):
            spark.conf.set(key, parts)
            table = linear.Inverted.of(texts, "id", "text", "label", (), 1, 3, 2)
            assert table.terms.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
            found.append(linear.fit_runs(table, member, max_iter=5).margins)
    finally:
        spark.conf.set(key, before)
    assert np.allclose(*found, rtol=0, atol=1e-10)
