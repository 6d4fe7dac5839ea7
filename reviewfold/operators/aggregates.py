"""Aggregations. Every one combines on the map side before it shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.distributions import t_ppf
from reviewfold.functions.labels import NEGATIVE, POSITIVE
from reviewfold.operators.ordering import running_totals


def count_by(df: DataFrame, *groups: str, out: str = "n") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(out))


def _weighted(weight: str | None) -> Column:
    return F.lit(1) if weight is None else F.col(weight)


def count_where(df: DataFrame, predicates: Mapping[str, Column], weight: str | None = None) -> DataFrame:
    """Many filtered counts in one scan; ``weight`` counts pre-aggregated rows."""
    size = _weighted(weight)
    return df.agg(*[F.coalesce(F.sum(F.when(p, size)), F.lit(0)).alias(name) for name, p in predicates.items()])


def crosstab_margins(
    df: DataFrame,
    row: str,
    rows: Sequence[Any],
    cols: str | Sequence[str],
    levels: Mapping[str, Any],
    weight: str | None = None,
) -> DataFrame:
    """Contingency table with a total row and a total column.

    ``levels`` maps a column title to a value of ``cols``, or to a tuple of
    values when ``cols`` names several columns. Rows and cells outside the
    listed levels are left out of the totals too.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    cells = {
        title: _all([F.col(c) == F.lit(v) for c, v in zip(names, _as_tuple(value), strict=True)])
        for title, value in levels.items()
    }
    counts = (
        df.filter(F.col(row).isin(list(rows)))
        .groupBy(row, *names)
        .agg(F.sum(_weighted(weight)).alias("_n"))
        .filter(_any(list(cells.values())))
    )
    table = counts.rollup(row).agg(
        *[F.coalesce(F.sum(F.when(cell, F.col("_n"))), F.lit(0)).alias(title) for title, cell in cells.items()],
        F.sum("_n").alias("Total"),
        F.grouping(row).alias("_margin"),
    )
    label = F.when(F.col("_margin") == 1, F.lit("Total")).otherwise(F.col(row).cast("string"))
    return table.select(label.alias(row), *cells, "Total")


def _as_tuple(value: Any) -> tuple:
    return value if isinstance(value, tuple) else (value,)


def _all(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def _any(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def label_counts(df: DataFrame, *entity: str, label: str) -> DataFrame:
    """Rows, positives and valid labels per entity.

    One narrow aggregate over the fact table. Every report starts here: what
    follows works on one row per entity, whatever the number of rows of a hot
    entity was.
    """
    value = F.col(label)
    return df.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(F.when(value == POSITIVE, 1)).alias("n_pos"),
        F.count(F.when(value == NEGATIVE, 1)).alias("n_neg"),
    )


def rate_column(positives: str = "n_pos", negatives: str = "n_neg") -> Column:
    """Negative share of the valid labels; NULL without any."""
    n = F.col(positives) + F.col(negatives)
    return F.when(n > 0, F.lit(1.0) - F.col(positives) / n)


def entity_rate(
    df: DataFrame, entity: str, label: str, keep: Sequence[str] = (), order_by: str | None = None, out: str = "prob"
) -> DataFrame:
    """Negative rate and number of valid labels per entity.

    ``keep`` carries attributes of the entity's first row in ``order_by``.
    """
    valid = df.filter(F.col(label).isin(POSITIVE, NEGATIVE))
    positives = F.count(F.when(F.col(label) == POSITIVE, 1))
    aggs = [F.count(F.lit(1)).alias("n"), (F.lit(1.0) - positives / F.count(F.lit(1))).alias(out)]
    if keep:
        if order_by is None:
            raise ValueError("keeping attributes of the first row needs an order")
        aggs.append(F.min_by(F.struct(*keep), F.col(order_by)).alias("_kept"))
    rates = valid.groupBy(entity).agg(*aggs)
    return rates.select(entity, "n", out, *[F.col("_kept")[k].alias(k) for k in keep])


def group_summary(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    groups = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_dev")
    )


def mean_ci(df: DataFrame, group: str | Sequence[str], value: str, conf: float = 0.95) -> DataFrame:
    """Mean, standard error and t-based confidence interval per group."""
    groups = [group] if isinstance(group, str) else list(group)
    stats = group_summary(df, groups, value).withColumn("std_err", F.col("std_dev") / F.sqrt("n"))
    reach = t_ppf(F.lit(1.0 - (1.0 - conf) / 2.0), (F.col("n") - 1).cast("double")) * F.col("std_err")
    return stats.withColumn("_reach", reach).select(
        *groups,
        "mean",
        (F.col("mean") - F.col("_reach")).alias("low_ci"),
        (F.col("mean") + F.col("_reach")).alias("high_ci"),
        "std_err",
        "n",
    )


def _value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in order, with the rows up to and including each."""
    counts = df.select(value).dropna().groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return running_totals(counts, [F.col(value)], {"_upto": "_n"})


def _type7(value: str, prob: float) -> Column:
    """Linear interpolation between the two order statistics around ``prob``."""
    at = (F.col("_upto_all") - 1) * F.lit(float(prob))
    low = F.floor(at)
    high = F.least(low + 1, F.col("_upto_all") - 1)
    first = F.col("_upto") - F.col("_n")

    def order_statistic(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position < F.col("_upto")), F.col(value)))

    share = F.max(at - low)
    below = order_statistic(low)
    return below + share * (order_statistic(high) - below)


def quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear (type 7) quantiles, one row per probability.

    Works on counts per distinct value spread over range partitions, so no task
    holds all values, as the built-in exact percentile would.
    """
    row = _value_counts(df, col).agg(*[_type7(col, p).alias(f"_q{i}") for i, p in enumerate(probs)])
    pairs = [F.struct(F.lit(float(p)).alias("prob"), F.col(f"_q{i}").alias("value")) for i, p in enumerate(probs)]
    return row.select(F.inline(F.array(*pairs)))


def six_number_summary(df: DataFrame, value: str) -> DataFrame:
    counts = _value_counts(df, value)
    return counts.agg(
        F.min(value).alias("min"),
        _type7(value, 0.25).alias("q1"),
        _type7(value, 0.5).alias("median"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        _type7(value, 0.75).alias("q3"),
        F.max(value).alias("max"),
    )


def histogram(
    df: DataFrame, value: str, width: float, low: float, high: float, by: str, levels: Sequence[Any]
) -> DataFrame:
    """Right-closed bins of equal width; the first one includes its low edge.

    Every level of ``by`` gets every bin, empty ones included. A value outside
    ``[low, high]`` is an error, so none is left out in silence.
    """
    bins = round((high - low) / width)
    steps = F.round((F.col(value) - F.lit(low)) / F.lit(width), 9)
    bin_no = F.greatest(F.lit(1), F.ceil(steps)).cast("int")
    outside = (F.col(value) < low) | (F.col(value) > high)
    message = F.concat(F.lit("value outside the histogram: "), F.col(value).cast("string"))
    bin_no = F.when(outside, F.raise_error(message).cast("int")).otherwise(bin_no)
    inside = df.filter(F.col(value).isNotNull() & F.col(by).isin(list(levels)))
    counts = inside.groupBy(F.col(by), bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(level,) for level in levels], [by]).withColumn(
        "bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))
    )
    joined = grid.join(counts, [by, "bin"], "left")
    edge = F.round(F.lit(low) + F.col("bin") * F.lit(width), 9)
    return joined.select(by, "bin", edge.alias("upper_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def run_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, extremes and population deviation of each metric over the runs."""
    stats = ("mean", "min", "max", "std_pop")
    row = df.agg(
        *[
            f(m).alias(f"{m}_{s}")
            for m in metrics
            for s, f in zip(stats, (F.avg, F.min, F.max, F.stddev_pop), strict=True)
        ]
    )
    lines = [
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{s}").alias(s) for s in stats]) for m in metrics
    ]
    return row.select(F.inline(F.array(*lines)))


def corpus_stats(df: DataFrame, tokens: Column) -> DataFrame:
    size = F.size(tokens)
    return df.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.max(size).cast("bigint").alias("max_tokens"),
        F.sum(size).alias("n_tokens"),
    )
