"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, an external sort brings
equal ones next to each other, and each row is compared in full with the one
before it. The sort key is a short prefix, the digest and then the text itself,
so the splitters stay short whatever the texts are. A tie-break by id spreads a
hot group over neighbouring partitions; the runs at the partition borders are
put together from two small rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.llm.common import squeeze, stored, texts_of

# Bytes of text that go to one range partition.
PARTITION_BYTES = 32 << 20
PREFIX_CHARS = 16


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts of one sorted partition.

    ``edge`` carries the text of the partition's first row and, on an extra row
    with NULL ``points``, of its last row, for the comparison across borders.
    """
    names = ["part", "doc", "points", "digest", "run", "edge"]
    run, before, last = -1, None, None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        norm = batch.column("norm")
        new = np.ones(rows, dtype=bool)
        if rows > 1:
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        edge: list[str | None] = [None] * rows
        if last is None:
            edge[0] = norm[0].as_py()
        else:
            new[0] = norm[0].as_py() != before
        runs = run + np.cumsum(new)
        run, before, last = int(runs[-1]), norm[rows - 1].as_py(), batch.slice(rows - 1)
        kept = [batch.column(n) for n in names[:4]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(runs, pa.int64()), pa.array(edge, pa.string())], names=names)
    if last is not None:
        kept = [last.column("part"), last.column("doc"), pa.nulls(1, pa.int64()), last.column("digest")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([run], pa.int64()), pa.array([before], pa.string())], names=names
        )


def _borders(edges: DataFrame) -> DataFrame:
    """One row per partition with rows: its last run and the run, here or in an
    earlier partition, that its first run belongs to.

    Neighbouring partitions are compared by full text in a join; the windows
    see one row a partition and no text.
    """
    firsts = edges.filter("points is not null").select(F.col("part"), F.col("edge").alias("first_text"))
    lasts = edges.filter("points is null").select("part", F.col("run").alias("last_run"), F.col("edge").alias("last_text"))
    in_order = Window.orderBy("part")
    order = lasts.select(
        "part", "last_run", F.lag("part").over(in_order).alias("prior"), F.lag("last_run").over(in_order).alias("prior_run")
    )
    before = lasts.select(F.col("part").alias("prior"), "last_text")
    compared = order.join(firsts, "part").join(before, "prior", "left")
    same = F.coalesce(F.col("first_text") == F.col("last_text"), F.lit(False))
    here = F.struct(F.col("part").alias("part"), F.lit(0).cast("long").alias("run"))
    there = F.struct(F.col("prior").alias("part"), F.col("prior_run").alias("run"))
    roots = compared.select(
        "part", "last_run", F.when(~same, here).when(F.col("prior_run") > 0, there).alias("root")
    )
    back = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return roots.select("part", "last_run", F.last("root", ignorenulls=True).over(back).alias("root"))


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``, with the row that stays of its equal texts.

    Columns: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``points``, the code points of the original text. Of equal texts the one
    with most code points in the original stays, then the smallest id (NULL
    last). NULL is the empty text; all texts of white space alone are one group.
    Of repeated rows with the same id exactly one is kept. An empty table gives
    no rows. ``normalise`` is an expression over ``body``.
    """
    base = texts_of(docs, id_col, text_col)
    norm = squeeze(F.col("body")) if normalise is None else normalise
    rows = base.select("doc", F.length("body").cast("long").alias("points"), norm.alias("norm"))
    rows = rows.withColumn("digest", F.sha2("norm", 256))
    size = base.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    prefix = F.substring("norm", 1, PREFIX_CHARS)
    ranged = rows.repartitionByRange(int(parts), prefix, "digest", F.xxhash64("doc"))
    ordered = ranged.sortWithinPartitions(prefix, "digest", "norm").withColumn("part", F.spark_partition_id())
    kind = base.schema["doc"].dataType.simpleString()
    numbered = stored(
        ordered.mapInArrow(_number_runs, f"part int, doc {kind}, points long, digest string, run long, edge string"),
        "content-sort",
    )
    borders = F.broadcast(_borders(numbered.filter("edge is not null").select("part", "points", "run", "edge")))
    run = Window.partitionBy("part", "run")
    best_first = run.orderBy(F.desc("points"), F.col("doc").isNull(), "doc")
    local = numbered.filter("points is not null").select(
        "part",
        "run",
        "doc",
        "points",
        "digest",
        F.row_number().over(best_first).alias("place"),
        F.first("doc").over(best_first).alias("here_id"),
        F.count(F.lit(1)).over(run).alias("here_size"),
    )
    # At most two runs of a partition touch a border.
    touching = (
        local.filter("place = 1")
        .join(borders, "part")
        .filter("run = 0 or run = last_run")
        .select(
            F.when(F.col("run") == 0, F.col("root")).otherwise(F.struct("part", "run")).alias("root"),
            F.struct(-F.col("points"), F.col("doc").isNull(), "doc", "part", "run").alias("key"),
            "here_size",
        )
    )
    whole = Window.partitionBy("root")
    joined_runs = touching.select(
        F.col("key.part").alias("part"),
        F.col("key.run").alias("run"),
        F.min("key").over(whole).alias("best"),
        F.sum("here_size").over(whole).alias("whole_size"),
    )
    result = local.join(F.broadcast(joined_runs), ["part", "run"], "left")
    is_best = F.col("best").isNull() | ((F.col("best.part") == F.col("part")) & (F.col("best.run") == F.col("run")))
    return result.select(
        F.col("doc").alias(id_col),
        F.when(F.col("best").isNull(), F.col("here_id")).otherwise(F.col("best.doc")).alias("keep_id"),
        F.coalesce("whole_size", "here_size").alias("group_size"),
        ((F.col("place") == 1) & is_best).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "points",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all
    their columns. Of repeated rows with one id and text one stays."""
    kept = content_groups(docs, id_col, text_col).filter("kept")
    keys = kept.select(
        F.col(f"`{id_col}`").alias("__id"), F.col("text_sha256").alias("__digest"), F.col("points").alias("__points")
    )
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = {"__own_digest": F.sha2(squeeze(body), 256), "__own_points": F.length(body).cast("long")}
    same = (
        F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
        & (F.col("__own_digest") == F.col("__digest"))
        & (F.col("__own_points") == F.col("__points"))
    )
    found = docs.withColumns(own).join(keys, same, "left_semi")
    return found.dropDuplicates([id_col, "__own_digest", "__own_points"]).drop(*own)
