"""Classifiers on a separable set, metrics, persistence and attribution."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reviewfold.operators import models
from reviewfold.sources.tables import load_model, read_table, save_model
from reviewfold.storage import new_path


@pytest.fixture(scope="module")
def reviews(spark):
    """Good and bad reviews that share filler words."""
    rng = random.Random(11)
    good, bad, filler = ["great", "fast", "clean", "love"], ["broken", "slow", "dirty", "hate"], ["the", "station", "was", "plug", "car"]
    rows = []
    for i in range(160):
        label = float(i % 2)
        words = rng.choices(good if label else bad, k=2) + rng.choices(filler, k=4)
        rng.shuffle(words)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "id bigint, text string, label double")


@pytest.fixture(scope="module")
def logistic(reviews):
    return models.fit_logistic(reviews.filter("id < 120"), "text", max_iter=40)


def accuracy(df):
    return models.binary_metrics(df, "label", "prediction").first().accuracy


def test_logistic_separates(reviews, logistic):
    assert accuracy(logistic.transform(reviews.filter("id >= 120"))) > 0.95


def test_logistic_minimizes_the_stated_loss(reviews, logistic):
    """The gradient of the mean loss plus the penalty, the constant included,
    is zero at the fitted weights."""
    train = logistic.transform(reviews.filter("id < 120")).select("_x", "label", vector_to_array("probability")[1].alias("p")).collect()
    weights = logistic.stages[-1].coefficients.toArray()
    gradient = weights / (2.5 * len(train))
    for row in train:
        gradient = gradient + row._x.toArray() * (row.p - row.label) / len(train)
    assert abs(gradient).max() < 1e-4


def test_training_sample_is_off_by_default(reviews):
    assert models.training_sample(reviews, "id").count() == 160
    assert models.training_sample(reviews, "id", 1000).count() == 160
    some = models.training_sample(reviews, "id", 40)
    assert 15 <= some.count() <= 70
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, models.training_sample(reviews, "id", 40).collect()))


def test_vocabulary_is_exact_for_any_number_of_terms(spark):
    """Far more terms than texts; a term is kept by its own frequency alone."""
    rows = [(i, " ".join(f"w{i % 50}x{k}" for k in range(200)), float(i % 2)) for i in range(100)]
    model = models.fit_tfidf(spark.createDataFrame(rows, "id int, text string, label double"), "text")
    terms = next(s for s in model.stages if type(s).__name__ == "CountVectorizerModel").vocabulary
    assert len(terms) == 50 * (200 + 199 + 198)


def test_long_text_in_random_features(spark):
    """Blocks of columns and slices of texts give what one product gives."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(1 << 20, 60_000, replace=False))
    rows = [(0, Vectors.sparse(1 << 20, at, np.ones(60_000) / 245)), (1, Vectors.sparse(1 << 20, at[:5], np.ones(5) / 2.3)), (2, Vectors.sparse(1 << 20, [], []))]
    df = spark.createDataFrame(rows, ["id", "f"]).coalesce(1)
    together = {r.id: r.z.toArray() for r in models.rbf_features(df, "f", "z", 0.5, 96, 1).collect()}
    for i in range(3):
        alone = models.rbf_features(df.filter(f"id = {i}"), "f", "z", 0.5, 96, 1).first().z.toArray()
        assert np.allclose(together[i], alone)
    assert float(together[0] @ together[0]) == pytest.approx(1, abs=0.2)


def test_svm_separates(reviews):
    model = models.fit_rbf_svm(reviews.filter("id < 120"), "text", gamma=0.5, n_features=128, max_iter=40)
    assert accuracy(model.transform(reviews.filter("id >= 120"))) > 0.85


def test_fits_use_at_most_about_max_rows(reviews, monkeypatch):
    seen = []
    plain = models._training_table
    monkeypatch.setattr(models, "_training_table", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    models.fit_rbf_svm(reviews, "text", n_features=8, max_iter=2, max_rows=60)
    models.fit_logistic(reviews, "text", max_iter=2, max_rows=1000)
    assert 25 <= seen[0] <= 100 and seen[1] == 160


def test_svm_features_equal_the_sparse_vectors(spark, reviews):
    """Terms in a table give the indices and weights of the vectors with a collected
    vocabulary, copies, empty and NULL texts included."""
    train = reviews.filter("id < 120")
    more = spark.createDataFrame([(200, "great great fast the station", 1.0), (200, "great great fast the station", 1.0), (201, "", 0.0), (202, "unheard of", 0.0)], reviews.schema)
    texts = reviews.filter("id >= 120").unionByName(more)
    vectors = models.fit_tfidf(train, "text", ("the",)).transform(texts)
    expected = [(r.id, r.features.indices.tolist(), r.features.values.tolist()) for r in vectors.collect()]
    found = models.fit_term_features(train, "text", ("the",))
    got = [(r.id, r.features["indices"], r.features["values"]) for r in found.transform(texts).collect()]
    assert sorted(got) == sorted(expected)
    without = spark.createDataFrame([(1, None, 1.0)], reviews.schema)
    assert found.transform(without).first().features == ([], [])


def test_svm_collects_no_term(reviews, monkeypatch):
    """The vocabulary stays with the executors, however long it is."""
    monkeypatch.setattr(models, "_counter", None)
    model = models.fit_rbf_svm(reviews.filter("id < 40"), "text", n_features=8, max_iter=2)
    assert model.transform(reviews).count() == 160


def test_svm_persistence(spark, reviews):
    model = models.fit_rbf_svm(reviews.filter("id < 40"), "text", gamma=0.5, n_features=16, max_iter=5)
    path = new_path(spark, "svm-test")
    model.save(path)
    columns = ["id", "prediction", "rawPrediction"]
    again = models.RbfSvm.load(path).transform(reviews).select(columns).orderBy("id").collect()
    assert again == model.transform(reviews).select(columns).orderBy("id").collect()


def test_random_features_approach_the_kernel(spark):
    from pyspark.ml.linalg import Vectors

    points = [(0, Vectors.sparse(9, [1, 4], [0.6, 0.8])), (1, Vectors.sparse(9, [1, 7], [0.6, 0.8])), (2, Vectors.sparse(9, [], []))]
    df = spark.createDataFrame(points, ["id", "f"])
    z = {r.id: r.z.toArray() for r in models.rbf_features(df, "f", "z", 0.7, 4096, 1).collect()}
    for a, b, squared in ((0, 1, 1.28), (0, 2, 1.0), (0, 0, 0.0)):
        import math

        assert float(z[a] @ z[b]) == pytest.approx(math.exp(-0.7 * squared), abs=0.05)


def test_embedding_mlp(spark, reviews):
    rng = random.Random(3)
    shift = {w: 1.0 for w in ("great", "fast", "clean", "love")} | {w: -1.0 for w in ("broken", "slow", "dirty", "hate")}
    words = [*shift, "the", "station", "was", "plug", "car"]
    vectors = spark.createDataFrame([(w, [shift.get(w, 0.0) + rng.gauss(0, 0.1), rng.gauss(0, 1)]) for w in words], "word string, vector array<double>")
    pooled = models.embedding_pool(reviews, "id", F.split("text", " "), vectors, 2).join(reviews.select("id", "label"), "id")
    model = models.fit_embedding_mlp(pooled.filter("id < 120"), 2, hidden=4, max_iter=40)
    assert accuracy(model.transform(models.pooled_features(pooled.filter("id >= 120")))) > 0.95


def test_score_and_persistence(spark, reviews, logistic):
    path = new_path(spark, "model-test")
    save_model(logistic, path)
    a = models.score(reviews, logistic, ["id"]).orderBy("id").collect()
    b = models.score(reviews, load_model(path), ["id"]).orderBy("id").collect()
    assert a == b
    assert {r.predicted for r in a} == {"POSITIVE", "NEGATIVE"}
    assert all((r.prob > 0.5) == (r["class"] == 1.0) for r in a)


def test_attribution_is_the_gradient(reviews, logistic):
    """Against a numeric derivative of the model in one term's weight."""
    import numpy as np

    rows = models.token_attribution(reviews.filter("id = 121"), logistic, "id").collect()
    text = reviews.filter("id = 121").first().text
    present = set(text.split())
    assert {r.term for r in rows if " " not in r.term} <= present and rows
    stages = {type(s).__name__: s for s in logistic.stages}
    p = models.score(reviews.filter("id = 121"), logistic, ["id"]).first().prob
    counter, scale, fitted = (stages[n] for n in ("CountVectorizerModel", "ElementwiseProduct", "LogisticRegressionModel"))
    for r in rows:
        at = counter.vocabulary.index(r.term)
        slope = fitted.coefficients[at] * scale.getScalingVec()[at]
        z = np.log(p / (1 - p))
        numeric = (1 / (1 + np.exp(-(z + 1e-6 * slope))) - p) / 1e-6
        assert r.attribution == pytest.approx(abs(numeric), rel=1e-3, abs=1e-9)


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, 1), (1, 0), (0, 1), (0, 0)], (0.5, 0.5, 0.5, 0.5)),
        ([(1, 0), (0, 0)], (0.5, 0.0, 0.0, None)),
        ([(0, 1)], (0.0, 0.0, 0.0, None)),
        ([(1, 1)], (1.0, 1.0, 1.0, 1.0)),
    ],
)
def test_metrics(spark, rows, expected):
    row = models.binary_metrics(spark.createDataFrame(rows, "label int, prediction int"), "label", "prediction").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == expected


def test_repeated_holdout(spark, reviews):
    log = new_path(spark, "holdout-test")
    runs = models.repeated_holdout(reviews, "id", lambda train: models.fit_logistic(train, "text", max_iter=10), 2, log_path=log)
    rows = runs.collect()
    assert [r.run for r in rows] == [0, 1] and all(r.n == 32 for r in rows)
    logged = read_table(spark, log, "run int, n bigint, accuracy double, precision double, recall double, f1 double", header=False)
    assert sorted(map(tuple, logged.collect())) == sorted(map(tuple, rows))
    empty = models.repeated_holdout(reviews.filter("id < 0"), "id", lambda train: None, 2)
    assert empty.count() == 0 and empty.columns == runs.columns
    summary = models.summarize_runs(runs).collect()
    assert [r.metric for r in summary] == ["accuracy", "f1"]


def test_mlp_with_its_words_scores_raw_texts_after_reload(spark, reviews):
    """Vectors and stages are read again; the probabilities equal plain arithmetic."""
    import numpy as np

    rng = random.Random(3)
    words = ["great", "fast", "clean", "love", "broken", "slow", "dirty", "hate", "the", "station"]
    vectors = spark.createDataFrame([(w, [float(i < 4) - 0.5 + rng.gauss(0, 0.1), rng.gauss(0, 1)]) for i, w in enumerate(words)], "word string, vector array<double>")
    pooled = models.embedding_pool(reviews, "id", F.split("text", " "), vectors, 2).join(reviews.select("id", "label"), "id")
    first = models.EmbeddingClassifier(vectors, 2, 1, models.fit_embedding_mlp(pooled.filter("id < 120"), 2, hidden=3, max_iter=20))
    path = new_path(spark, "mlp-test")
    first.save(path)
    again = models.EmbeddingClassifier.load(path)
    raw = spark.createDataFrame([(1, "Great, fast!"), (2, "slow and dirty."), (3, None), (4, "")], "id int, text string")
    rows = {}
    for name, model in (("first", first), ("again", again)):
        out = models.forward_pass(model.transform(raw, "id", "text"), model.mlp)
        rows[name] = {r.id: (r.p, r.forward) for r in out.select("id", vector_to_array("probability")[1].alias("p"), "forward").collect()}
    assert rows["first"] == rows["again"] and len(rows["first"]) == 4
    assert all(abs(p - forward) < 1e-12 for p, forward in rows["first"].values())
    assert rows["first"][1][0] > 0.5 > rows["first"][2][0]
    weights = first.mlp.stages[-1].weights.toArray()
    assert len(weights) == 4 * 3 + 3 + 3 * 2 + 2 and np.isfinite(weights).all()


def test_attribution_equals_scoring_the_shortened_text(spark, reviews):
    rng = random.Random(4)
    words = ["great", "fast", "clean", "love", "broken", "slow", "dirty", "hate"]
    vectors = spark.createDataFrame([(w, [float(i < 4) - 0.5, rng.gauss(0, 1)]) for i, w in enumerate(words)], "word string, vector array<double>")
    pooled = models.embedding_pool(reviews, "id", F.split("text", " "), vectors, 2).join(reviews.select("id", "label"), "id")
    model = models.EmbeddingClassifier(vectors, 2, 1, models.fit_embedding_mlp(pooled, 2, hidden=3, max_iter=20))
    texts = {1: "great slow great unknown", 2: "hate", 3: "", 4: "fast broken love broken dirty", 5: "clean clean"}
    raw = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {(r.id, r.word): r.attribution for r in model.attribution(raw, "id", "text").collect()}
    short = [(i, w, " ".join(x for x in t.split() if x != w)) for i, t in texts.items() for w in set(t.split())]
    again = spark.createDataFrame([(f"{i} {w}", t) for i, w, t in short], "id string, text string")
    rest = {r.id: r.p for r in model.transform(again, "id", "text").select("id", vector_to_array("probability")[1].alias("p")).collect()}
    whole = {r.id: r.p for r in model.transform(raw, "id", "text").select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert set(got) == {(i, w) for i, w, _ in short}
    for i, w, _ in short:
        assert got[i, w] == pytest.approx(whole[i] - rest[f"{i} {w}"], abs=1e-9)
