"""Tokens picked from texts that hold none."""

from pyspark.sql import functions as F

from reviewfold.functions import text as T


def test_a_text_without_a_token_gives_null(spark):
    rows = [(1, ""), (2, " \n\t "), (3, None), (4, "  one  two "), (5, "one")]
    df = spark.createDataFrame(rows, "id int, review string")
    got = {r.id: (r.first, r.last, r.second) for r in df.select("id", T.pick(F.col("review"), 1).alias("first"), T.pick(F.col("review"), -1).alias("last"), T.pick(F.col("review"), 2).alias("second")).collect()}
    assert got == {1: (None,) * 3, 2: (None,) * 3, 3: (None,) * 3, 4: ("one", "two", "two"), 5: ("one", "one", None)}
