"""CSV whose quoted fields hold line breaks, read in parallel.

Whether a line break ends a record depends on whether the number of quotes before it
is even, which only the start of the file tells. The quotes of every file block are
counted by one task; a prefix over the blocks, one row each, gives the parity at the
start of every block. Then each block knows its records, and only the lines of records
with line breaks are exchanged and joined up, also across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewfold.sources.tables import CSV_OPTIONS


def _quotes(line: Column) -> Column:
    """Quotes in a line; with doubled quotes as escapes, an odd number opens or closes a field."""
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(file, block, at, line)``: a block's lines in the order of ``at``."""
    raw = spark.read.option("lineSep", "\n").text(path)
    # The bytes as they are, whatever the encoding; a blank before a line break is no part of it.
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace(text, "\r$", "").alias("line"),
    )


def record_texts(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """``(file, record)``: every record of the files as one text, without the headers and
    without empty lines. The windows hold one file block, or one row per block of a file."""
    lines = _lines(spark, path, encoding).withColumn("quotes", _quotes(F.col("line")))
    in_block = Window.partitionBy("file", "block").orderBy("at")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({"before": F.coalesce(F.sum("quotes").over(so_far), F.lit(0)), "number": F.row_number().over(in_block)})
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = blocks.select("file", "block", F.pmod(F.coalesce(F.sum("total").over(earlier), F.lit(0)), F.lit(2)).alias("inside"))
    known = placed.join(parity, ["file", "block"])
    begins = F.pmod(F.col("inside") + F.col("before"), F.lit(2)) == 0
    closes = F.pmod(F.col("inside") + F.col("before") + F.col("quotes"), F.lit(2)) == 0
    known = known.withColumns({"begins": begins, "closes": closes})
    body = known.filter(~(F.col("begins") & (F.col("block") == 0) & (F.col("number") == 1))) if header else known
    single = body.filter("begins and closes and line <> ''").select("file", F.col("line").alias("record"))

    # Lines of longer records, numbered by the line that begins each.
    heads = F.max(F.when(F.col("begins"), F.col("at"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    parted = known.withColumn("head", heads).filter("not (begins and closes)")
    # A block's last open record goes on in the blocks that have not begun one yet.
    last = known.filter("begins").groupBy("file", "block").agg(F.max("at").alias("last"))
    carried = blocks.join(last, ["file", "block"], "left").select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    parted = parted.join(carried, ["file", "block"]).withColumn("head", F.coalesce("head", "carried"))
    entry = F.struct("block", "at", "line")
    joined = parted.groupBy("file", "head").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    first_line = known.filter((F.col("block") == 0) & (F.col("number") == 1)).select("file", F.col("at").alias("head"))
    if header:
        joined = joined.join(first_line, ["file", "head"], "left_anti")
    return single.unionByName(joined.select("file", F.array_join("lines.line", "\n").alias("record")))


def read_records(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a declared schema, as ``read_table`` with ``multi_line`` gives it, by as
    many tasks as the files have blocks. A record that does not fit the schema is an
    error; an empty field is NULL. A record is gathered in one row."""
    wanted = schema.simpleString() if isinstance(schema, StructType) else schema
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"} | {"mode": "FAILFAST"}
    texts = record_texts(spark, path, encoding, header)
    wanted = wanted.removeprefix("struct<").removesuffix(">") if isinstance(schema, StructType) else wanted
    return texts.select(F.from_csv("record", wanted, options).alias("_r")).select("_r.*")
