"""Fits use every labelled text, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.operators import linear, models
from reviewfold.plans import models_catalog

MANY = 130_000


@pytest.fixture(scope="module")
def many(spark):
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)).cast("string"))
    return spark.range(0, MANY, 1, 8).select("id", F.concat_ws(" ", word(1), word(2)).alias("text"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).cast("double").alias("label"))


def test_a_term_model_is_fitted_on_every_text(many):
    model = linear.fit_term_logistic(many, "id", "text", max_iter=3)
    assert model.n_texts == MANY
    assert model.weights.agg(F.sum("df")).first()[0] > 2 * MANY


def test_runs_split_every_text(many):
    assert [r.n for r in linear.holdout_runs(many, "id", "text", 1, max_iter=2).collect()] == [-(-MANY // 5)]


def test_no_query_bounds_the_texts_of_the_svm(monkeypatch):
    found = []

    def fit(train, text, **given):
        found.append(given.get("max_rows"))
        raise LookupError

    monkeypatch.setattr(models, "fit_rbf_svm", fit)
    monkeypatch.setattr(models_catalog, "_split", lambda t: (None, None))
    for query in (models_catalog.checked_rbf_svm, models_catalog.rbf_svm_predict):
        with pytest.raises(LookupError):
            query(None)
    assert found == [None, None]


def test_the_past_may_lie_in_a_file(spark, monkeypatch):
    """The direction is the same whether the past is in memory or in a file, read in small stretches."""
    rng = np.random.default_rng(3)
    dot = lambda x, y: np.einsum("nr,nr->r", x, y)
    steps = [[rng.normal(size=(50, 4)) for _ in range(4)] for _ in range(linear.HISTORY + 3)]
    found = []
    for size, numbers in ((1 << 30, 1 << 20), (100, 12)):
        monkeypatch.setattr(linear, "PAST_BYTES", size)
        monkeypatch.setattr(linear, "SLICE_NUMBERS", numbers)
        past = linear._Past((50, 4))
        for step in steps:
            past.add(*step)
        found.append(linear._direction(steps[0][0], steps[0][1], past, dot))
    assert len(past) == linear.HISTORY
    assert np.allclose(found[0], found[1])
    assert all(np.array_equal(x, y) for x, y in zip(next(past.parts(9, 0, 3))[1:], (steps[-1][0][:3], steps[-1][3][:3]), strict=True))


def test_a_run_that_has_arrived_costs_no_more_passes(spark, monkeypatch):
    """Runs of few texts end early; a pass then works on the others alone."""
    rows = [(i, f"w{i % 5} w{i % 7} w{i % 3}", float(i % 2)) for i in range(200)]
    table = linear.Inverted.of(spark.createDataFrame(rows, "id int, text string, label double"), "id", "text", "label", (), 1, 3, 2)
    member = np.ones((200, 3), dtype=bool)
    member[4:, 1] = False
    widths = []
    plain = linear._sum_by_row
    monkeypatch.setattr(linear, "_sum_by_row", lambda terms, shape, *a: widths.append(shape[1]) or plain(terms, shape, *a))
    together = linear.fit_runs(table, member)
    assert widths[:2] == [3, 3] and widths[-1] < 3 and together.gradient.max() <= linear.TOLERANCE
    for run in range(3):
        assert np.allclose(linear.fit_runs(table, member[:, [run]]).margins[:, 0], together.margins[:, run], atol=1e-6)
