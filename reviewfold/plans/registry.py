"""Registry of named queries with their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewfold.plans.inputs import Inputs, with_inputs

Body = Callable[[Inputs], DataFrame]
_BODIES: dict[str, Body] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Body], Body]:
    """Register a query; ``oracle`` is the DuckDB text with the same result."""

    def add(body: Body) -> Body:
        if name in _BODIES:
            raise ValueError(f"query {name} is registered twice")
        _BODIES[name] = body
        if oracle is not None:
            _ORACLES[name] = with_inputs(oracle)
        return body

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round sums of doubles, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def text_of(col: Column | str, sep: str = " ") -> Column:
    """Array as one text, so that results compare the same in both engines."""
    column = F.col(col) if isinstance(col, str) else col
    return F.array_join(column.cast("array<string>"), sep)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from reviewfold.plans import catalog  # noqa: F401  registers on import

    def runner(body: Body) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: body(Inputs(spark, sf_dir))

    return {name: runner(body) for name, body in _BODIES.items()}


def all_oracles() -> dict[str, str]:
    from reviewfold.plans import catalog  # noqa: F401

    return dict(_ORACLES)
