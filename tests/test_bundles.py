"""Texts that meet word tables in bundles: repeated and missing ids, and what is moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.operators import bundles, models, terms, vocabulary

TEXTS = [(1, "a b b"), (2, "c"), (2, "a"), (3, ""), (4, None), (None, "a b"), (5, "é a")]
VECTORS = [("a", [1.0, 2.0]), ("a", [3.0, -2.0]), ("b", [0.5, 0.5]), ("c", None), ("unused", [9.0, 9.0])]


@pytest.fixture(scope="module")
def frames(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    return texts, spark.createDataFrame(VECTORS, "word string, vector array<float>")


def drawn(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(vocabulary.random_vector(F.col("w"), 2, 1).alias("v"))
    return np.array([r.v for r in rows.collect()])


def test_vectors_drawn_in_a_task_are_those_of_the_column(spark):
    words = ["c", "é", "", "two words", "x" * 300]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", vocabulary.random_vector(F.col("w"), 7, 3).alias("v"))
    assert np.array_equal(vocabulary.draw_vectors(words, 7, 3), np.array([r.v for r in rows.orderBy("i").collect()]))


def test_pools_of_repeated_and_missing_ids(spark, frames):
    """Rows of one id are pooled together, a word with two vectors counts for both, and
    every row has a result."""
    texts, vectors = frames
    rows = models.embedding_pool(texts, "id", F.split("text", "(?!^)[ ]+"), vectors, 2).collect()
    assert sorted(str(r.id) for r in rows) == sorted(str(t[0]) for t in TEXTS)
    got = {r.id: (r.mean_vector, r.max_vector) for r in rows}
    a, b, (c, e) = np.array([[1.0, 2.0], [3.0, -2.0]]), np.array([0.5, 0.5]), drawn(spark, ["c", "é"])
    assert np.allclose(got[1], [(a.sum(axis=0) + 2 * b) / 4, [3.0, 2.0]])
    assert np.allclose(got[2], [(a.sum(axis=0) + c) / 3, [3.0, 2.0]])
    assert np.allclose(got[5], [(a.sum(axis=0) + e) / 3, [3.0, 2.0]])
    assert got[4] == got[None] == ([0.0, 0.0], [0.0, 0.0])


def test_a_vector_moves_once_to_each_bundle(spark, frames, monkeypatch):
    """However many texts hold a word; before, its vector was joined to each of them."""
    moved = []
    monkeypatch.setattr(models, "meet", lambda dealt, i, asked, table, on, *a: moved.append((dealt, asked, table)) or bundles.meet(dealt, i, asked, table, on, *a))
    many = spark.range(3000).select("id", F.lit("a b c").alias("text"))
    assert models.embedding_pool(many, "id", F.split("text", " "), frames[1], 2).count() == 3000
    dealt = moved[0][0]
    assert dealt.select("_bundle").distinct().count() == 1
    plan = bundles.meet(*moved[0][:1], "id", *moved[0][1:], "word", lambda t, r: r.select(["word"]), "word string")
    assert plan.count() == 4


def test_bundles_are_bounded(spark):
    many = spark.range(4000).select("id", F.array_repeat(F.lit("w"), 50).alias("tokens"))
    sizes = bundles.deal_out(many, "id", F.col("tokens"), 10_000).groupBy("_bundle").agg(F.sum(F.size("_words")).alias("n")).collect()
    assert len(sizes) == 20 and max(r.n for r in sizes) < 16_000


def test_encoding_moves_texts_and_distinct_words(spark, no_broadcast):
    """A text is moved once and a word once for each bundle: no exchange has a row for
    each word of each text. Repeated and missing ids are one text each."""
    rows = [(i, ["hot", f"w{i % 7}", "hot", f"rare{i}"] * 5) for i in range(300)]
    df = spark.createDataFrame([*rows, (1, ["hot", None]), (None, ["w1", "hot"]), (None, ["w2"])], "id int, words array<string>")
    vocab = spark.createDataFrame([("hot", 1), ("w1", 2), ("w2", 3), ("w2", 4)], "word string, token_id int")
    encoded = vocabulary.encode_tokens(df, "id", F.col("words"), vocab)
    got = {r.id: r.token_ids for r in encoded.collect()}
    assert len(got) == 301 and got[None] == [2, 3, 4, 1] and got[2] == [1, 3, 4, 1, 5] * 5
    assert got[1] == [1, 1, 2, 5, 1, 5] + [1, 2, 1, 5] * 4
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and "Aggregate" not in plan


GRAMS = [(1, "the aa bb aa bb cc"), (2, "aa bb cc"), (2, "aa the aa"), (3, ""), (4, None), (5, "x"), (None, "aa bb"), (None, "cc éé"), (6, "éé aa bb")]


@pytest.mark.parametrize(("words", "held"), [(1 << 20, 1 << 22), (4, 3)])
def test_frequencies_of_sequences(spark, monkeypatch, words, held):
    """Counts by number and in lists are those of a row for each text and term."""
    monkeypatch.setattr(terms, "PART_WORDS", words)
    monkeypatch.setattr(terms, "HELD_TERMS", held)
    texts = spark.createDataFrame(GRAMS, "id int, text string")
    for low, high in ((1, 3), (2, 2), (1, 1)):
        expected = terms.document_frequency(texts, terms.terms_of(F.col("text"), ("the",), low, high)).collect()
        got = terms.ngram_frequency(texts, "text", ("the",), low, high).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    assert terms.ngram_frequency(texts.limit(0), "text").count() == 0


def test_weights_move_texts_and_distinct_terms(spark, no_broadcast):
    """Rows with equal ids are one text, those without an id too; a term is sent once for
    a bundle, not for each text, and the table of terms is not copied."""
    texts = spark.createDataFrame(GRAMS, "id int, text string")
    found = terms.fit_term_weights(texts, "text", ("the",), min_df=1, max_df=1.0).transform(texts, "id", "text")
    tf = {(r.id, r.term): r.tf for r in found.collect()}
    assert tf[1, "aa bb"] == 2 and tf[2, "aa"] == 3 and tf[2, "aa aa"] == 1 and tf[None, "aa bb"] == 1 and tf[None, "cc éé"] == 1
    squares = {}
    for r in found.collect():
        squares[r.id] = squares.get(r.id, 0.0) + r.weight**2
    assert set(squares) == {1, 2, 6, None} and all(abs(x - 1) < 1e-12 for x in squares.values())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "_salt" not in plan and "ReusedExchange" in plan and "Generate" not in plan
