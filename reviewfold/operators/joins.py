"""Joins and lookups.

Each join broadcasts its right side only when that side is of checked small
size; otherwise it is a salted shuffle join (see ``skew``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.operators.skew import AUTO, skew_join


def join_labels(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Left outer join; a key that occurs twice among the labels doubles its rows.

    ``on`` identifies a row, so no key is hot and nothing is salted.
    """
    return skew_join(df, labels, on, "left", salts=1)


def join_dimension(
    df: DataFrame,
    dim: DataFrame,
    left_key: str,
    right_key: str,
    suffix: str = "_dim",
    null_safe: bool = False,
    salts: int = AUTO,
) -> DataFrame:
    """Inner join of facts with a dimension whose key has another name.

    Columns of the dimension that clash with a fact column get ``suffix``. The
    key keeps its fact-side name. With ``null_safe`` a NULL key matches a NULL
    key; it is joined on a text form of the key so that it stays an equi-join.
    Hot keys of the facts are measured and salted by their share; ``salts=1`` is for
    facts already reduced to one row per key.
    """
    clash = (set(df.columns) - {left_key}) & (set(dim.columns) - {right_key})
    right = dim.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})
    if not null_safe:
        return skew_join(df, right.withColumnRenamed(right_key, left_key), left_key, salts=salts)

    # Two columns stand for one nullable key: "is NULL" and the value or a filler.
    def flagged(frame: DataFrame, key: str) -> DataFrame:
        text = F.coalesce(F.col(key).cast("string"), F.lit(""))
        return frame.withColumns({"_no_key": F.col(key).isNull(), "_key": text})

    joined = skew_join(flagged(df, left_key), flagged(right, right_key).drop(right_key), ["_no_key", "_key"], salts=salts)
    return joined.drop("_no_key", "_key")


def semi_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return skew_join(df, other.select(key).distinct(), key, "left_semi")


def attach_tier(df: DataFrame, tiers: DataFrame, key: str, tier: str = "tier", default: str = "Mid") -> DataFrame:
    """Tier of each row's group, ``default`` where the group has none."""
    joined = skew_join(df, tiers.select(key, tier), key, "left", salts=AUTO)
    return joined.withColumn(tier, F.coalesce(F.col(tier), F.lit(default)))


def lookup_vectors(vocab: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary with its word vectors; NULL where a word has none.

    Words are unique on both sides, so no key is hot and a plain join is right.
    """
    return vocab.join(vectors, word, "left")


def missing_words(vocab: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    return vocab.join(vectors.select(word), word, "left_anti")


def lookup(
    df: DataFrame,
    col: str,
    table: DataFrame | Mapping,
    out: str,
    code: str = "code",
    name: str = "name",
    invert: bool = False,
) -> DataFrame:
    """Name of a code, or with ``invert`` the code of a name; NULL if unknown."""
    if isinstance(table, Mapping):
        table = df.sparkSession.createDataFrame(list(table.items()), [code, name])
    source, target = (name, code) if invert else (code, name)
    pairs = table.select(F.col(source).alias(col), F.col(target).alias(out))
    return skew_join(df, pairs, col, "left")
