"""Token counts of whole texts with batches balanced by bytes.

The encoding happens in an Arrow function that returns lengths only. Texts are
grouped into slices of about equal bytes and long ones are cut into safe pieces
(see ``pieces``), so memory does not follow the longest text's token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import slices, split_sums, texts_of
from reviewfold.llm.pieces import PieceEncoder, load_tokenizer, tokenizer_path

BATCH_BYTES = 8 << 20
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(load_tokenizer(path))
    return _ENCODERS[path]


def token_counts(
    docs: DataFrame,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    The vocabulary must drop white space, as ``word_bpe_49k.json`` does. A NULL
    or empty text has no bytes and no tokens. Repeated rows are counted each on
    their own; an empty table gives no rows.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    base = texts_of(docs, id_col, text_col).select("doc", F.encode("body", "UTF-8").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in slices(whole, 1, batch_bytes):
                pieces = [text.split() for text in batch.column(1).to_pylist()]
                numbers, counts, _, _ = encoder.encode(pieces)
                n_pieces = np.fromiter(map(len, pieces), np.int64, len(pieces))
                n_tokens = split_sums(n_pieces, counts[numbers] if len(numbers) else np.zeros(0, np.int64))
                n_bytes = pc.binary_length(batch.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                    names=["doc", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = base.schema["doc"].dataType.simpleString()
    counted = base.mapInArrow(count, f"doc {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("doc", id_col)
