"""Where intermediate data may live.

On a cluster every intermediate file goes to the shared folder named by
``spark.checkpoint.dir``. A machine-local temporary folder is used only by a
local master, where the driver and the executors are one process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="reviewfold-")
    spark.conf.set(_SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/reviewfold-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Used where two later steps must see the very same physical partitions, so a
    recomputation after an executor loss may not place rows differently.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
