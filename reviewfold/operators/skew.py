"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
#: Salts by measure: a key is hot from this share of the rows on.
AUTO, HOT_SHARE = 0, 1 / 64
# Counters of the sketch: so many that every hot key stays in it.
_COUNTERS = int(4 / HOT_SHARE)
# Pieces of a hot key for each task that its share would fill: small ones, since several may meet in a task.
_PIECES = 8
# Plan nodes whose output is never larger than their input, so the size of the
# files below them bounds the size of the result.
_SHRINKING = {"Project", "Filter", "Aggregate", "LogicalRelation", "LocalRelation", "RelationV2"}


def _only_shrinks(plan) -> bool:
    if not any(plan.nodeName().startswith(name) for name in _SHRINKING):
        return False
    children = plan.children()
    return all(_only_shrinks(children.apply(i)) for i in range(children.size()))


def broadcast_limit(df: DataFrame) -> int:
    """Bytes the session allows to be broadcast; 0 if it allows none."""
    return max(0, df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def fits_broadcast(df: DataFrame, measured: int | None = None) -> bool:
    """True when ``df`` is known to be within the session's broadcast limit.

    ``measured`` is a number of bytes the caller found. Without it the
    optimizer's estimate is trusted only for plans that cannot outgrow the files
    they read.
    """
    limit = broadcast_limit(df)
    if limit == 0:
        return False
    if measured is not None:
        return measured <= limit
    plan = df._jdf.queryExecution().optimizedPlan()
    return _only_shrinks(plan) and int(str(plan.stats().sizeInBytes())) <= limit


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


class _Counters:
    """Misra-Gries counters of 64-bit keys: a key's counter is below its count by at most
    the rows seen over the number of counters."""

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.rows += len(keys)
        both = np.concatenate([self.keys, keys])
        weight = np.concatenate([self.counts, np.ones(len(keys), np.int64)])
        self.keys, where = np.unique(both, return_inverse=True)
        counts = np.bincount(where, weight, minlength=len(self.keys)).astype(np.int64)
        if len(counts) > self.size:
            counts -= np.partition(counts, -self.size - 1)[-self.size - 1]
        self.keys, self.counts = self.keys[counts > 0], counts[counts > 0]


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> dict[int, float]:
    """Hash of each key that holds at least ``share`` of the rows, and about its share.

    One scan of the key columns. A task keeps a bounded number of counters, Spark adds
    them up, and at most about ``4 / share`` keys come back; no hot key is missed. The
    shares are too low by a quarter of ``share`` at most. NULL keys are one key.
    """
    size = max(_COUNTERS, int(4 / share))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counters(size)
        for batch in batches:
            found.add(batch.column(0).to_numpy(zero_copy_only=False))
        # The last row carries the number of rows.
        keys_, counts = np.append(found.keys, 0), np.append(found.counts, found.rows)
        total = np.arange(len(keys_)) == len(keys_) - 1
        yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(keys_), pa.array(counts)], names=["total", "hash", "n"])

    rows = df.select(_key_hash(keys).alias("hash")).mapInArrow(sketch, "total boolean, hash long, n long")
    sums = rows.groupBy("total", "hash").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("total").desc(), F.col("n").desc()).limit(size + 1).collect()
    if not top or not top[0].n:
        return {}
    n = top[0].n
    return {r.hash: r.n / n for r in top[1:] if r.n >= (share - 1 / size) * n}


def _salts_of(hot: dict[int, float], tasks: int, key: Column) -> Column:
    """Salts of a key: as many as its share of the tasks, in small pieces; 1 for most keys."""
    if not hot:
        return F.lit(1)
    pairs = [x for h, share in hot.items() for x in (F.lit(h).cast("long"), F.lit(max(2, math.ceil(_PIECES * share * tasks))))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1))


def _salted_by_share(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Shuffle join in which only the hot keys are salted, each by its share of the rows.

    A row's salt is its place in its partition, so identical rows are spread too; only
    the right rows of hot keys are copied. Any salt gives the same result.
    """
    conf = left.sparkSession._jsparkSession.sessionState().conf()
    tasks = max(conf.numShufflePartitions(), left.sparkSession.sparkContext.defaultParallelism)
    hot = heavy_keys(left, keys)
    if not hot:
        return left.join(right, keys, how)
    salts = _salts_of(hot, tasks, _key_hash(keys))
    spread = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
    right_bytes: int | None = None,
) -> DataFrame:
    """Join on equal names, with ``left`` as the side that may have hot keys.

    A right side of checked size is broadcast and ``left`` is not
    shuffled. Otherwise each left row gets a salt from a hash of its values and
    every right row is repeated once per salt, so a hot key is spread over
    ``salts`` tasks. Both inputs of the join are then plain shuffles on
    ``(key, salt)``, which lets adaptive execution split what is still large,
    such as many identical rows. The result is the same for any salt. With
    ``salts=1``, for a left side already reduced to one row per key, the join is
    left to the optimizer. With ``salts=AUTO`` the hot keys of ``left`` are measured
    first, which reads its keys once more, and only they are salted, by their share.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep or drop left rows can be salted")
    if fits_broadcast(right, right_bytes):
        return left.join(F.broadcast(right), keys, how)
    if salts == 1:
        return left.join(right, keys, how)
    if salts == AUTO:
        return _salted_by_share(left, right, keys, how)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
