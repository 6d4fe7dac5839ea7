"""Spreading small inputs over the cluster before work that is heavy per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Inputs up to this many bytes may be dealt out again, however many cores there are.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the input is too small to fill all cores.

    Splitting texts costs far more than reading them, and a small table often
    sits in one row group that one task would have to work through. An input
    over ``SPREAD_BYTES``, or with a full scan partition for every core, is
    returned as it is, and so is one that was dealt out before. The rows are the
    same either way.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    conf = spark._jsparkSession.sessionState().conf()
    plan = df._jdf.queryExecution().optimizedPlan()
    full = int(str(plan.stats().sizeInBytes())) >= min(SPREAD_BYTES, cores * conf.filesMaxPartitionBytes())
    return df if full or _dealt_out(plan) else df.repartition(cores)


def _dealt_out(plan) -> bool:
    """True when only narrow steps lie above an earlier repartition."""
    while plan.nodeName() in ("Project", "Filter", "Generate"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("Repartition")


def one_per_element(df: DataFrame, keep: Sequence[str], elements: Column, out: str) -> DataFrame:
    """One row per array element.

    The outer form with a filter above it: for a plain explode the optimizer
    adds a test that the array has elements and pushes it to the scan, so the
    array would be built twice.
    """
    return df.select(*keep, F.explode_outer(elements).alias(out)).filter(F.col(out).isNotNull())
