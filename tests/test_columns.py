"""Hand cases for expressions, filters and joins."""

import pytest
from pyspark.sql import functions as F

from reviewfold.functions import labels as L
from reviewfold.functions import text as T
from reviewfold.operators import filters, joins, projections


def one(spark, value, fn, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("predicted", "label", "best"),
    [
        ("POSITIVE", "neutral", "NEGATIVE"),
        ("POSITIVE", None, "POSITIVE"),
        (None, "positive", None),
        ("NEGATIVE", "positive", "POSITIVE"),
        ("NEGATIVE", "Negative", "NEGATIVE"),
        ("OTHER", "positive", "OTHER"),
    ],
)
def test_resolve_label(spark, predicted, label, best):
    df = spark.createDataFrame([(predicted, label)], "p string, h string")
    assert projections.resolve_label(df, "p", "h", "best").first().best == best


def test_membership_counts_null_as_absent(spark):
    assert one(spark, None, lambda c: L.membership(c, ["CA"], "USA", "CAN")) == "CAN"
    assert one(spark, "CA", lambda c: L.membership(c, ["CA"], "USA", "CAN")) == "USA"


def test_fill_keeps_null_group(spark):
    rows = [(None, None), (None, "Library"), (None, "Shop"), ("Public", "Shop")]
    df = spark.createDataFrame(rows, "owner string, grp string")
    out = projections.fill_from_group(df, "owner", "grp", ["Library"], "Public", "Private")
    assert [r.owner for r in out.collect()] == [None, "Public", "Private", "Public"]


def test_paste_and_split(spark):
    df = spark.createDataFrame([("Public", None)], "a string, b string")
    pasted = projections.paste_columns(df, ["a", "b"], "k")
    assert pasted.first().k == "Public/NA"
    row = projections.split_key(pasted, "k", ["x", "y", "z"]).first()
    assert (row.x, row.y, row.z) == ("Public", "NA", None)


@pytest.mark.parametrize(("p", "c"), [(0.5, 0.0), (1.5, 2.0), (0.51, 1.0), (None, None)])
def test_class_rounds_half_to_even(spark, p, c):
    assert one(spark, p, T.to_class, "double") == c


@pytest.mark.parametrize(
    ("name", "word", "found"),
    [("harvest", "rv", False), ("the r v park", "r v", True), ("rv", "rv", True), ("my rv", "rv", True)],
)
def test_contains_word(spark, name, word, found):
    assert one(spark, name, lambda c: T.contains_word(c, word)) is found


def test_text_functions(spark):
    assert one(spark, "Hi, there. Ok?! Yes-no", T.clean_text) == "Hi there Ok Yes-no"
    assert one(spark, "A,B/C", T.normalize_name) == "ab c"
    assert one(spark, "don't  STOP_me\tnow", T.sequence_tokens) == ["don't", "stop", "me", "now"]
    assert one(spark, "A bc dé_1 x22", T.word_tokens) == ["bc", "dé_1", "x22"]
    assert one(spark, "  a \t b\nc ", T.tokens) == ["a", "b", "c"]
    assert one(spark, None, T.clean_text) is None
    assert one(spark, "Gtype_zoo", lambda c: T.strip_prefix(c, "Gtype_")) == "zoo"


def test_ngrams(spark):
    grams = lambda c: T.word_ngrams(c, 1, 3)
    assert one(spark, ["a", "b", "c"], grams, "array<string>") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, ["a"], grams, "array<string>") == ["a"]
    assert one(spark, [], grams, "array<string>") == []
    kept = lambda c: T.drop_words(c, ["the"])
    assert one(spark, ["x", "the", "x"], kept, "array<string>") == ["x", "x"]


@pytest.mark.parametrize(
    ("ids", "side", "padded"),
    [
        ([1, 2, 3, 4], "pre", [2, 3, 4]),
        ([1], "pre", [0, 0, 1]),
        ([1, 2, 3, 4], "post", [1, 2, 3]),
        ([1], "post", [1, 0, 0]),
        ([], "pre", [0, 0, 0]),
        ([1, 2, 3], "pre", [1, 2, 3]),
    ],
)
def test_padding(spark, ids, side, padded):
    assert one(spark, ids, lambda c: T.pad_sequence(c, 3, side), "array<bigint>") == padded


def test_filters_drop_null(spark):
    df = spark.createDataFrame([("Other",), ("Shop",), (None,)], "g string")
    assert [r.g for r in filters.exclude(df, "g", "Other", "Unknown").collect()] == ["Shop"]
    access = spark.createDataFrame([("Public",), ("Restricted",), (None,)], "access_type string")
    assert filters.access_filter(access, "P").count() == 1
    assert filters.access_filter(access, "R").count() == 1
    assert filters.access_filter(access, "").count() == 3


def test_labels(spark):
    df = spark.createDataFrame([("positive",), ("Negative",), ("x",), (None,)], "s string")
    assert [r.n for r in projections.encode_label(df, "s", "n").collect()] == [1.0, 0.0, None, None]
    coded = spark.createDataFrame([("POSITIVE",), ("NEUTRAL",), (None,)], "s string")
    assert [r.i for r in projections.indicator(coded, "s", "POSITIVE", "i").collect()] == [1, 0, None]


@pytest.mark.parametrize("broadcast", [True, False])
def test_dimension_join(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "loc int, name string")
    dims = spark.createDataFrame([(1, "one"), (None, "none"), (1, "uno")], "id int, name string")
    plain = joins.join_dimension(facts, dims, "loc", "id")
    assert sorted((r.loc, r.name, r.name_dim) for r in plain.collect()) == [
        (1, "a", "one"), (1, "a", "uno"), (1, "b", "one"), (1, "b", "uno"),
    ]
    safe = joins.join_dimension(facts, dims, "loc", "id", null_safe=True)
    assert safe.count() == 5
    assert safe.filter("loc is null").first().name_dim == "none"


def test_duplicate_labels_multiply_rows(spark):
    predictions = spark.createDataFrame([(1, "P"), (2, "N")], "id int, p string")
    human = spark.createDataFrame([(1, "x"), (1, "y")], "id int, h string")
    assert joins.join_labels(predictions, human, "id").count() == 3


def test_lookup_both_ways(spark):
    table = {"CA": "California", "NY": "New York"}
    df = spark.createDataFrame([("CA",), ("ZZ",)], "c string")
    assert [r.n for r in joins.lookup(df, "c", table, "n").orderBy("c").collect()] == ["California", None]
    names = spark.createDataFrame([("New York",)], "n string")
    assert joins.lookup(names, "n", table, "c", invert=True).first().c == "NY"
