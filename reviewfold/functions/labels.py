"""Label and code expressions with explicit NULL rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two sentiment classes and their numbers.
POSITIVE = "POSITIVE"
NEGATIVE = "NEGATIVE"
CLASS_NUMBER = {NEGATIVE: 0.0, POSITIVE: 1.0}
CLASS_NAME = {0.0: NEGATIVE, 1.0: POSITIVE}
# Area codes, and performance tiers as they are displayed. A low
# negative rate is a high performance, so the display order is turned round.
AREA_TITLE = {0: "Rural", 1: "Urban Cluster", 2: "Urban Center"}
TIER_DISPLAY = {
    "Low": "High (< 25th percentile)",
    "Mid": "Mid (25-75th percentile)",
    "High": "Low (> 75th percentile)",
}


def case_map(col: Column, mapping: Mapping[Any, Any], default: Any = None) -> Column:
    """Value from ``mapping``; ``default`` for other values, NULL for NULL."""
    chain = F.when(col.isNull(), F.lit(None))
    for key, value in mapping.items():
        chain = chain.when(col == F.lit(key), F.lit(value))
    return chain.otherwise(F.lit(default))


def membership(col: Column, values: Iterable[Any], yes: Any, no: Any) -> Column:
    """``yes`` for listed values; NULL counts as not listed."""
    return F.when(F.coalesce(col.isin(list(values)), F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def filled(col: Column, group: Column, values: Iterable[Any], yes: Any, no: Any) -> Column:
    """Keep ``col``; where it is NULL derive it from ``group``; NULL group stays NULL."""
    return (
        F.when(col.isNotNull(), col)
        .when(group.isin(list(values)), F.lit(yes))
        .when(group.isNotNull(), F.lit(no))
    )


def resolved(predicted: Column, human: Column) -> Column:
    """Prediction, flipped to the other class where a human label differs from it."""
    label = F.upper(human)
    differs = label.isNotNull() & (predicted != label)
    return (
        F.when(differs & (predicted == POSITIVE), F.lit(NEGATIVE))
        .when(differs & (predicted == NEGATIVE), F.lit(POSITIVE))
        .otherwise(predicted)
    )


def indicator(col: Column, value: Any) -> Column:
    """1 where equal to ``value``, 0 for another value, NULL for NULL."""
    return F.when(col.isNull(), F.lit(None).cast("int")).when(col == F.lit(value), F.lit(1)).otherwise(F.lit(0))
