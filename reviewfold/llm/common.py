"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewfold.storage import new_path

#: The white space of every contract here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor means reading the table again, and later
    steps see one fixed set of rows.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, body)``: the id and the text with NULL as the empty text.

    Only these two columns go on, so other columns of any name do no harm.
    """
    return docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body")
    )


def squeeze(text: Column) -> Column:
    """Text without any white space."""
    return F.translate(text, SPACES, "")


def n_buckets(df: DataFrame, bytes_each: int, size: Column) -> int:
    """Buckets so that one holds about ``bytes_each`` of the measured size."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // bytes_each))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``max_bytes`` of a binary column.

    A single longer value is a slice of its own.
    """
    ends = np.asarray(lengths(batch.column(column)), dtype=np.int64).cumsum()
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def lengths(values: pa.Array) -> np.ndarray:
    """Byte length of each value of a string or binary array."""
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)


def split_sums(lengths_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each of the consecutive stretches ``lengths_``."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(lengths_)
    return ends[stops] - ends[stops - lengths_]


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, spread: int = 64) -> DataFrame:
    """Rows of each key numbered from 0 without a gap, in no given order.

    A key may hold most of the rows: its rows are ranked in ``spread`` groups
    chosen by a hash of ``order``, and each group begins where the ones before
    it end. The counts have ``spread`` rows for a key at most.
    """
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(*order), F.lit(spread)))
    local = Window.partitionBy(*keys, "_deal").orderBy(*order)
    ranked = dealt.withColumn("_at", F.row_number().over(local) - 1)
    before = Window.partitionBy(*keys).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_deal").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_deal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(starts, [*keys, "_deal"]).withColumn(out, F.col("_start") + F.col("_at")).drop(
        "_deal", "_at", "_start"
    )


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(mod))
