"""Projections that derive, recode or relabel columns (narrow, no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions import labels
from reviewfold.functions.text import paste, split_part


def classify_membership(df: DataFrame, col: str, values: Iterable[Any], yes: Any, no: Any, out: str) -> DataFrame:
    return df.withColumn(out, labels.membership(F.col(col), values, yes, no))


def fill_from_group(
    df: DataFrame, col: str, group_col: str, values: Iterable[Any], yes: Any, no: Any, out: str | None = None
) -> DataFrame:
    return df.withColumn(out or col, labels.filled(F.col(col), F.col(group_col), values, yes, no))


def case_label(df: DataFrame, col: str, mapping: Mapping[Any, Any], default: Any, out: str) -> DataFrame:
    return df.withColumn(out, labels.case_map(F.col(col), mapping, default))


def recode(df: DataFrame, col: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Replace listed values, leave all others as they are."""
    return df.replace(dict(mapping), subset=[col])


def encode_label(df: DataFrame, col: str, out: str, mapping: Mapping[str, float] = labels.CLASS_NUMBER) -> DataFrame:
    """Class name in any case to its number; an unknown name gives NULL."""
    return df.withColumn(out, labels.case_map(F.upper(F.col(col)), mapping))


def decode_label(df: DataFrame, col: str, out: str, mapping: Mapping[float, str] = labels.CLASS_NAME) -> DataFrame:
    return df.withColumn(out, labels.case_map(F.col(col), mapping))


def resolve_label(df: DataFrame, predicted: str, human: str, out: str) -> DataFrame:
    return df.withColumn(out, labels.resolved(F.col(predicted), F.col(human)))


def indicator(df: DataFrame, col: str, value: Any, out: str) -> DataFrame:
    return df.withColumn(out, labels.indicator(F.col(col), value))


def relabel_ordered(df: DataFrame, col: str, levels: Sequence[Any], shown: Sequence[str], out: str) -> DataFrame:
    """Display label, and its 1-based position as ``<out>_ordinal``."""
    label = labels.case_map(F.col(col), dict(zip(levels, shown, strict=True)))
    ordinal = labels.case_map(F.col(col), {level: i for i, level in enumerate(levels, 1)})
    return df.withColumns({out: label, f"{out}_ordinal": ordinal})


def paste_columns(df: DataFrame, cols: Sequence[str], out: str, sep: str = "/") -> DataFrame:
    return df.withColumn(out, paste([F.col(c) for c in cols], sep))


def split_key(df: DataFrame, col: str, names: Sequence[str], sep: str = "/") -> DataFrame:
    return df.withColumns({name: split_part(F.col(col), i, sep) for i, name in enumerate(names)})
