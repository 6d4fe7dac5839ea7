"""Seeded holdout splits of exact size.

A row's place is decided by ``md5(id:seed)``: the rows with the smallest keys
are the test set. Only the border between the two sets has to be found. It is
narrowed down with histograms of the key's leading digits, at most 65,536 lines
per seed, so no step sorts the table and the split itself is a plain comparison
with a literal: no shuffle, and the same rows after any recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 4
_SORTABLE = 50_000


@dataclass(frozen=True)
class Border:
    """Largest key of the test set; rows with an equal key are cut by id."""

    seed: Any
    key: str
    id: Any


def holdout_key(id_col: str, seed: Any) -> Column:
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), seed_text))


def in_test(id_col: str, border: Border) -> Column:
    key = holdout_key(id_col, border.seed)
    return (key < border.key) | ((key == border.key) & (F.col(id_col) <= F.lit(border.id)))


def holdout_borders(df: DataFrame, id_col: str, test_size: float, seeds: Sequence[int]) -> list[Border]:
    """Border of each seed's split; ``id_col`` must identify a row.

    The test set has ``ceil(test_size * rows)`` rows. What reaches the driver is
    one line per seed.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1, both excluded")
    keyed = (
        df.select(id_col)
        .withColumn("_seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
        .withColumn("_key", holdout_key(id_col, F.col("_seed")))
    )
    spark = df.sparkSession
    order = Window.partitionBy("_seed").orderBy("_lead")
    whole = Window.partitionBy("_seed")
    open_rows, found = keyed, {}
    need: dict[int, int] = {}
    length = 0
    while len(found) < len(seeds):
        length += _DIGITS
        lead = F.substring("_key", 1, length)
        bins = open_rows.groupBy("_seed", lead.alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
        placed = bins.select(
            "_seed",
            "_lead",
            "_n",
            F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
            F.sum("_n").over(whole).alias("_total"),
        )
        if need:
            wanted = spark.createDataFrame(list(need.items()), "_seed int, _need bigint")
            placed = placed.join(F.broadcast(wanted), "_seed")
        else:
            placed = placed.withColumn("_need", F.ceil(F.lit(float(test_size)) * F.col("_total")))
        edge = placed.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        edges = edge.select("_seed", "_lead", "_n", (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_rest"))
        rows = edges.collect()
        if not rows:
            return []
        leads = spark.createDataFrame([(r._seed, r._lead) for r in rows], "_seed int, _lead string")
        inside = keyed.withColumn("_lead", F.substring("_key", 1, length)).join(
            F.broadcast(leads), ["_seed", "_lead"], "left_semi"
        )
        need = {r._seed: r._rest for r in rows}
        if max(r._n for r in rows) <= _SORTABLE or length >= 32:
            ranks = spark.createDataFrame(list(need.items()), "_seed int, _need bigint")
            by_key = Window.partitionBy("_seed").orderBy("_key", id_col)
            last = (
                inside.withColumn("_rank", F.row_number().over(by_key))
                .join(F.broadcast(ranks), "_seed")
                .filter("_rank = _need")
            )
            found = {r._seed: Border(r._seed, r._key, r[id_col]) for r in last.collect()}
            break
        open_rows = inside
    return [found[int(s)] for s in seeds]


def holdout_split(
    df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 22
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; disjoint, complete and of exact size."""
    borders = holdout_borders(df, id_col, test_size, [seed])
    if not borders:
        return df, df.limit(0)
    is_test = in_test(id_col, borders[0])
    return df.filter(~is_test), df.filter(is_test)


def holdout_assignments(
    df: DataFrame, id_col: str, runs: int, test_size: float = 0.2, seed: int = 22
) -> DataFrame:
    """One row per (run, id) with ``is_test``; run ``r`` uses ``seed + r``.

    All borders are found in one pass; the assignment is a map over the ids.
    """
    borders = holdout_borders(df, id_col, test_size, [seed + r for r in range(runs)])
    flags = [F.struct(F.lit(r).alias("run"), in_test(id_col, b).alias("is_test")) for r, b in enumerate(borders)]
    if not flags:
        return df.select(F.lit(0).alias("run"), id_col, F.lit(False).alias("is_test"))
    return df.select(id_col, F.inline(F.array(*flags))).select("run", id_col, "is_test")
