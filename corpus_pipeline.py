"""A corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
it as Parquet and reads it again for the next one. All but the last return the
columns of ``documents``.

In every stage a NULL text counts as empty, NULL and repeated ids lose no row but
copies, extra columns stay as they are, very long texts are read whole, ties go to the
smallest id, NULL labels teach nothing, and an empty table gives no rows.

Whole rows travel to the Python workers and back in every stage, on both sides with
room for a batch. A stage lowers ``spark.sql.execution.arrow.maxRecordsPerBatch`` of the
session to ``BATCH_ROWS``; a smaller setting stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewfold.llm.common import crc_mod, read_table, stored
from reviewfold.llm.content_sort import drop_copies
from reviewfold.llm.near_dup import drop_near_duplicates
from reviewfold.llm.packing import pack
from reviewfold.llm.spans import drop_repeated_spans
from reviewfold.llm.toxicity import fit_toxicity

#: Rows that an executor and its worker hold at once.
BATCH_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with the session's Arrow batches bounded. What it returns is run
    later, so the setting stays."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(_ARROW_ROWS))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return bounded


@_in_small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel model does not reject. It learns from the
    labels of the documents at hand whose crc32(doc_id as text) mod 5 is not 0."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    return fit_toxicity(docs, labels, train=crc_mod("doc", 5) != 0).without_toxic(docs)


@_in_small_batches
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


@_in_small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: sets of five-word shingles
    with a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, threshold=80)


@_in_small_batches
def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of passages that stand elsewhere before; a text
    may become empty. ``n_chars`` follows the text."""
    cut = drop_repeated_spans(docs).drop("n_sentences", "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_spans),
    ("best_fit_packing", packed),
]

#: SQL cannot express the model of the first stage and the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
