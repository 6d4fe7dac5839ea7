"""Group-level inference: Welch tests, Kolmogorov-Smirnov, tiers, reports.

The rows are reduced to one line of moments per group in a single aggregate;
the formulas and the p-values work on those lines only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.distributions import kolmogorov_sf, t_two_sided
from reviewfold.functions.labels import TIER_DISPLAY
from reviewfold.operators.aggregates import group_summary, label_counts, quantiles, rate_column
from reviewfold.operators.ordering import running_totals
from reviewfold.operators.projections import relabel_ordered
from reviewfold.storage import materialize

_EPSILON = 2.220446049250313e-16


def _moments(value: Column, prefix: str) -> list[Column]:
    return [
        F.count(value).alias(f"n_{prefix}"),
        F.avg(value).alias(f"mean_{prefix}"),
        F.var_samp(value).alias(f"var_{prefix}"),
    ]


def _welch_columns(df: DataFrame) -> DataFrame:
    """Add t, df and the reason why they are NULL, from both groups' moments."""
    share_x = F.col("var_x") / F.col("n_x")
    share_y = F.col("var_y") / F.col("n_y")
    error = F.sqrt(share_x + share_y)
    few = (F.col("n_x") < 2) | (F.col("n_y") < 2)
    flat = error <= 10 * _EPSILON * F.greatest(F.abs("mean_x"), F.abs("mean_y"))
    reason = F.when(few, F.lit("not enough observations")).when(flat, F.lit("data are constant"))
    freedom = (share_x + share_y) * (share_x + share_y) / (
        share_x * share_x / (F.col("n_x") - 1) + share_y * share_y / (F.col("n_y") - 1)
    )
    return (
        df.withColumn("reason", reason)
        .withColumn("t", F.when(F.col("reason").isNull(), (F.col("mean_x") - F.col("mean_y")) / error))
        .withColumn("df", F.when(F.col("reason").isNull(), freedom))
    )


_WELCH = ("t", "df", "mean_x", "mean_y", "n_x", "n_y", "reason")


def welch_test(df: DataFrame, value: str, group: str, a: Any, b: Any, p_value: bool = True) -> DataFrame:
    """Two-sample t-test without equal variances, one row."""
    inside = df.filter(F.col(group).isin([a, b]))
    of = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    tested = _welch_columns(inside.agg(*_moments(of(a), "x"), *_moments(of(b), "y"))).select(*_WELCH)
    return tested.withColumn("p_value", t_two_sided("t", "df")) if p_value else tested


def welch_pairwise(
    df: DataFrame, value: str, group: str, pairs: Sequence[tuple[Any, Any]], p_value: bool = True
) -> DataFrame:
    """The same test for a list of group pairs, from one aggregate over the rows."""
    used = sorted({g for pair in pairs for g in pair})
    moments = df.filter(F.col(group).isin(used)).groupBy(group).agg(*_moments(F.col(value), "g"))
    of = lambda g, f: F.max(F.when(F.col(group) == F.lit(g), F.col(f)))
    fields = ("n_g", "mean_g", "var_g")
    lines = [
        F.struct(
            F.lit(a).alias("group_x"),
            F.lit(b).alias("group_y"),
            *[F.coalesce(of(g, f), F.lit(0)).alias(f"n_{s}") if f == "n_g" else of(g, f).alias(f"{f[:-1]}{s}")
              for g, s in ((a, "x"), (b, "y")) for f in fields],
        )
        for a, b in pairs
    ]
    tested = _welch_columns(moments.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines")))
    tested = tested.select("group_x", "group_y", *_WELCH)
    return tested.withColumn("p_value", t_two_sided("t", "df")) if p_value else tested


def segment_tests(
    df: DataFrame,
    segment: str,
    owner: str,
    cost: str,
    entity: str,
    label: str,
    segments: Sequence[str] | None = None,
    owners: Sequence[str] = ("Public", "Private"),
    costs: tuple[str, str] = ("Free", "Paid"),
    counted: bool = False,
    p_value: bool = True,
) -> DataFrame:
    """Free against paid inside each ownership, for all segments in one job.

    ``df`` has one row per review, or with ``counted`` one row per entity with
    the columns of ``label_counts``. ``n_rows`` is the number of reviews in the
    segment before the label filter; the rate of an entity uses valid labels.
    """
    scope = df if segments is None else df.filter(F.col(segment).isin(list(segments)))
    keys = [segment, owner, cost, entity]
    counts = scope if counted else label_counts(scope, *keys, label=label)
    counts = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_all", "n_pos", "n_neg")])
    rated = counts.withColumn("prob", rate_column())
    cell = lambda o, c: F.when((F.col(owner) == o) & (F.col(cost) == c), F.col("prob"))
    aggs = [F.sum("n_all").alias("n_rows")]
    for i, o in enumerate(owners):
        aggs += _moments(cell(o, costs[0]), f"{i}_x") + _moments(cell(o, costs[1]), f"{i}_y")
    wide = rated.groupBy(segment).agg(*aggs).filter(F.col(segment).isNotNull())
    fields = [f"{m}_{s}" for m in ("n", "mean", "var") for s in ("x", "y")]
    lines = [
        F.struct(
            F.lit(o).alias("owner_group"), *[F.col(f"{f[:-2]}_{i}{f[-2:]}").alias(f) for f in fields]
        )
        for i, o in enumerate(owners)
    ]
    long = wide.select(segment, "n_rows", F.inline(F.array(*lines)))
    tested = _welch_columns(long).select(segment, "owner_group", "n_rows", *_WELCH)
    return tested.withColumn("p_value", t_two_sided("t", "df")) if p_value else tested


def ks_two_sample(df: DataFrame, value: str, group: str, a: Any, b: Any) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p-value.

    Rows become counts per distinct value first, and the running counts are
    spread over range partitions of the value. Without a value in one of the
    groups the distance and the p-value are NULL.
    """
    of = lambda g: F.count(F.when(F.col(group) == F.lit(g), 1))
    inside = df.filter(F.col(group).isin([a, b]) & F.col(value).isNotNull())
    counts = inside.groupBy(value).agg(of(a).alias("_a"), of(b).alias("_b"))
    running = running_totals(counts, [F.col(value)], {"_fa": "_a", "_fb": "_b"})
    share = lambda c: F.try_divide(F.col(c), F.col(f"{c}_all"))
    gap = F.abs(share("_fa") - share("_fb"))
    result = running.agg(F.max(gap).alias("d"), *[F.coalesce(F.max(c), F.lit(0)).alias(n) for c, n in (("_fa_all", "n_x"), ("_fb_all", "n_y"))])
    root = F.sqrt(F.try_divide(F.col("n_x") * F.col("n_y"), F.col("n_x") + F.col("n_y")))
    return result.withColumn("p_value", kolmogorov_sf(F.col("d") * root))


def tier_groups(df: DataFrame, group: str, value: str, probs: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Group means with their quartile tier, strict on both sides."""
    # One row a group, written down, so that the facts are read once.
    means = materialize(group_summary(df, group, value).withColumnRenamed("n", "count_locations"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    low, high = (quantiles(means, "mean", probs).agg(at(p)).scalar() for p in probs)
    tier = F.when(F.col("mean") < low, F.lit("Low")).when(F.col("mean") > high, F.lit("High")).otherwise(F.lit("Mid"))
    return means.withColumn("tier", tier)


def display_tiers(df: DataFrame, tier: str = "tier", out: str = "tier_display") -> DataFrame:
    """Tier as it is displayed, with its position."""
    return relabel_ordered(df, tier, list(TIER_DISPLAY), list(TIER_DISPLAY.values()), out)


def format_report(tests: DataFrame, segment: str, names: dict[str, str] | None = None) -> DataFrame:
    """One text line per segment from the result of ``segment_tests``: the two
    means and the p-value of both ownerships, then the number of reviews."""
    of = lambda o, c: F.max(F.when(F.col("owner_group") == o, F.col(c)))
    figures = [of(o, c) for o in ("Public", "Private") for c in ("mean_x", "mean_y", "p_value")]
    named = F.col(segment)
    if names:
        pairs = [F.lit(part) for pair in names.items() for part in pair]
        named = F.coalesce(F.element_at(F.create_map(*pairs), F.col(segment)), F.col(segment))
    shown = [F.coalesce(F.format_string("%.2f", f), F.lit("NA")) for f in figures]
    line = F.concat_ws(" & ", F.max(named), *shown, F.concat(F.max("n_rows").cast("string"), F.lit(r" \\")))
    return tests.groupBy(segment).agg(line.alias("line"))
