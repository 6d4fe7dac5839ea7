"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most one sequence. Only the number of
pieces of each length reaches the planner, which runs best-fit decreasing over
counts; a plan entry says which sequences take a piece of that length and at
which offset. The pieces then take the planned slots by their rank within the
length, so no document passes through the driver and nothing is packed in one
task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import rank_within, slices, stored, texts_of
from reviewfold.llm.pieces import RankedEncoder, tokenizer_path

SEQUENCE_TOKENS = 2048
BATCH_BYTES = 4 << 20
_ENCODERS: dict[str, RankedEncoder] = {}


def _encoder(path: str, ranks: str) -> RankedEncoder:
    if path not in _ENCODERS:
        from public_tokenizers import PATTERN

        _ENCODERS[path] = RankedEncoder(path, ranks, PATTERN)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, capacity: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc, piece, start, length, ids_crc32, row)``: every text's ids, then
    ``separator``, cut into pieces of ``capacity`` of which the first may be
    shorter. ``row`` tells repeated rows apart."""
    path, ranks = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    base = texts_of(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, ranks)
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                source, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = encoder.encode(text)
                    ids.append(separator)
                    n = len(ids)
                    if n <= capacity:
                        bounds = [0, n]
                    else:
                        bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    raw = memoryview(np.array(ids, dtype="<u4")).cast("B")
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        source.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "piece", "start", "length", "ids_crc32"])

    kind = base.schema["doc"].dataType.simpleString()
    cuts = base.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long")
    return cuts.withColumn("row", F.monotonically_increasing_id())


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    ``counts`` maps a length to its number of pieces. Returns
    ``(length, first_rank, n, first_sequence, offset)``: the pieces of this
    length with ranks from ``first_rank`` go, in order, to ``n`` sequences from
    ``first_sequence`` at ``offset``. Sequences with the same content so far
    are handled together, so the work follows the number of lengths.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, number)]
    used, plan = 0, []
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                first, number = open_bins[room].pop()
                if not open_bins[room]:
                    rooms[room] = False
            else:
                room, first = capacity, used
                number = -(-left // (capacity // length))
                used += number
            taken = min(left, number)
            if taken < number:
                open_bins.setdefault(room, []).append((first + taken, number - taken))
                rooms[room] = True
            plan.append((length, rank, taken, first, capacity - room))
            if room > length:
                open_bins.setdefault(room - length, []).append((first, taken))
                rooms[room - length] = True
            left, rank = left - taken, rank + taken
    return plan


def pack(
    docs: DataFrame,
    capacity: int = SEQUENCE_TOKENS,
    separator: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    A NULL or empty text is one piece with only the separator. Repeated rows
    are packed each on their own. Every sequence but the last of a plan entry is
    as full as best-fit decreasing makes it. An empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, capacity, separator, id_col, text_col), "pieces")
    # At most ``capacity`` rows, whatever the size of the input.
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    plan = np.array(plan_best_fit(counts, capacity), dtype=np.int64).reshape(-1, 5)
    by_length = {int(n): plan[plan[:, 0] == n, 1:] for n in np.unique(plan[:, 0])}
    spread = max(16, docs.sparkSession.sparkContext.defaultParallelism)
    ranked = rank_within(pieces, ["length"], [F.col("row")], "rank", spread)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                slots = by_length[int(n)]
                at = np.searchsorted(slots[:, 0], rank[mine], "right") - 1
                sequence[mine] = slots[at, 2] + rank[mine] - slots[at, 0]
                offset[mine] = slots[at, 3]
            kept = [batch.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32")]
            names = ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    kind = pieces.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("doc", id_col)
