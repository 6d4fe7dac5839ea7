"""Row filters with explicit NULL behaviour; every one reaches the scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.labels import NEGATIVE, POSITIVE


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def equal(df: DataFrame, col: str, value: Any) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def exclude(df: DataFrame, col: str, *values: Any) -> DataFrame:
    """Drop listed values, and rows where the column is NULL."""
    return df.filter(~F.col(col).isin(list(values)))


def valid_labels(df: DataFrame, col: str, values: Sequence[str] = (POSITIVE, NEGATIVE)) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def access_filter(df: DataFrame, level: str, col: str = "access_type") -> DataFrame:
    """``P`` keeps Public, ``R`` keeps Restricted, any other level keeps all."""
    wanted = {"P": "Public", "R": "Restricted"}.get(level)
    return df if wanted is None else df.filter(F.col(col) == wanted)
