"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key is hashed, and a walk of pseudo-random jumps gives its shard. There is
no ring table: with one more shard a key either stays or moves to the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import rank_within, texts_of

# Fixed values of the published algorithm.
_MULTIPLIER = 2862933555777941757
_NUMERATOR = float(1 << 31)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each 64-bit key, in steps for all keys at once."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            state[live] = state[live] * np.uint64(_MULTIPLIER) + np.uint64(1)
            step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            jump = ((shard[live] + 1) * (_NUMERATOR / step)).astype(np.int64)
            inside = jump < n_shards
            live = live[inside]
            shard[live] = jump[inside]
    return shard


def shard_documents(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", grown: bool = True
) -> DataFrame:
    """Shard of every row by its id, and a gapless place within the shard.

    The text itself is never shuffled. Rows with one id go to one shard; each
    row has a slot of its own, repeated rows too. A NULL id has a fixed key. A
    NULL text has no bytes, so size 1. An empty table gives no rows.
    """
    body = F.encode(F.col("body"), "UTF-8")
    facts = texts_of(docs, id_col, text_col).select(
        "doc", (F.octet_length("body") + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    keyed = facts.withColumn("key", F.xxhash64(F.col("doc")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            columns = [*batch.columns[:3], pa.array(jump_hash(keys, n_shards), pa.int32())]
            columns.append(pa.array(jump_hash(keys, n_shards + 1), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "size", "text_crc32", "shard", "grown_shard"])

    kind = facts.schema["doc"].dataType.simpleString()
    placed = keyed.mapInArrow(place, f"doc {kind}, size long, text_crc32 long, shard int, grown_shard int")
    order = [F.col("doc"), F.col("size"), F.col("text_crc32")]
    spread = max(64, docs.sparkSession.sparkContext.defaultParallelism)
    slotted = rank_within(placed, ["shard"], order, "slot", spread)
    return slotted.select(
        F.col("doc").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        *([F.col("grown_shard")] if grown else []),
    )
