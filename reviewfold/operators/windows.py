"""Per-row group figures, first rows, orders and top-k.

The group figures are an aggregate joined back, not a window over the group: a
window would sort all rows of a hot group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.functions.labels import POSITIVE
from reviewfold.operators.ordering import ranked
from reviewfold.operators.skew import AUTO, skew_join


def with_group_count(df: DataFrame, key: str, out: str = "count") -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return skew_join(df, counts, key, "left", salts=AUTO)


def with_group_rate(df: DataFrame, key: str, label: str, out: str = "prob") -> DataFrame:
    """Negative rate of the row's group; ``df`` holds valid labels only."""
    positives = F.count(F.when(F.col(label) == POSITIVE, 1))
    rates = df.groupBy(key).agg((F.lit(1.0) - positives / F.count(F.lit(1))).alias(out))
    return skew_join(df, rates, key, "left", salts=AUTO)


def with_segment_count(df: DataFrame, segment: str, out: str = "count") -> DataFrame:
    """Rows of the segment before any label filter."""
    return with_group_count(df, segment, out)


def first_per_key(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """First row of each key, all columns kept; ``order_by`` must be unique.

    Spark keeps one row per key and input partition before the shuffle, so a hot
    key costs no more than any other.
    """
    first = Window.partitionBy(key).orderBy(order_by)
    return df.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def segment_constant(df: DataFrame, segment: str, col: str, out: str) -> DataFrame:
    """Value of a column that is constant within the segment."""
    return df.groupBy(segment).agg(F.max(col).alias(out))


def rank_categories(df: DataFrame, by: str, key: str, out: str = "rank") -> DataFrame:
    """Categories by descending value, ties by name."""
    return ranked(df, [F.col(by).desc(), F.col(key).asc()], out)


def order_by_list(df: DataFrame, col: str, values: Sequence[str], reverse: bool = False) -> DataFrame:
    """Rows of the listed values in the order of the list."""
    listed = list(reversed(values)) if reverse else list(values)
    rows = [(value, i) for i, value in enumerate(listed, 1)]
    order = df.sparkSession.createDataFrame(rows, f"{col} string, ordinal int")
    return df.join(F.broadcast(order), col).orderBy("ordinal")


def top_segments(df: DataFrame, segment: str, k: int, within: str | None = None, n: Column | None = None) -> DataFrame:
    """The ``k`` largest segments by rows, overall or in each ``within``.

    ``n`` replaces the row count, for pre-aggregated input.
    """
    size = F.count(F.lit(1)) if n is None else F.sum(n)
    groups = [segment] if within is None else [within, segment]
    counts = df.dropna(subset=groups).groupBy(*groups).agg(size.alias("n"))
    if within is None:
        best = counts.orderBy(F.desc("n"), segment).limit(k)
        order = Window.orderBy(F.desc("n"), segment)
    else:
        best = counts
        order = Window.partitionBy(within).orderBy(F.desc("n"), segment)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
