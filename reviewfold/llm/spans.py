"""Substring deduplication by runs of words at the bounds of sentences.

A text is cut into sentences. At every bound half of ``min_words`` words are
hashed forward and as many backward. A repeated passage of ``min_words`` words
has that many on one side of each bound inside it, so its whole sentences are
covered by runs inside it, wherever its own ends cut a sentence. A sentence too
long for two runs to cover is a run itself. Runs are brought together by their
128-bit hash, and every sentence whose words all lie under runs that stand
earlier elsewhere is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewfold.llm.common import slices, texts_of

MIN_WORDS = 40
BATCH_BYTES = 16 << 20
# What goes back to Spark at once: rows of runs, and bytes of cut texts.
_ROWS, _CUT_BYTES = 1 << 16, 4 << 20
# After a stop and white space, or at a line's end.
_BOUNDARY = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")
# A span packs its first word, its number of words and a tag of the text.
_START, _COUNT, _TAG = 26, 10, 27


def sentences(text: bytes) -> list[bytes]:
    """Consecutive pieces of the text; put together they are the text."""
    cuts = [m.end() for m in _BOUNDARY.finditer(text)]
    bounds = [0, *cuts] if cuts and cuts[-1] == len(text) else [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] if text else []


def _tag(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) & ((1 << _TAG) - 1)


def _half(min_words: int) -> int:
    return -(-min_words // 2)


def runs_of(pieces: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, number, hashes)`` of the runs of words of a text's sentences.

    Words are compared without regard to A-Z case and white space. Equal words
    at one place are one run.
    """
    words, bounds = [], [0]
    for piece in pieces:
        words += piece.lower().split()
        if len(words) > bounds[-1]:
            bounds.append(len(words))
    if len(words) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    half = _half(min_words)
    places = {(b, half) for b in bounds if b + half <= len(words)}
    places.update((b - half, half) for b in bounds if b >= half)
    places.update((a, b - a) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 2 * half)
    digests = b"".join([xxhash.xxh3_128_digest(b" ".join(words[a : a + n])) for a, n in places])
    first, number = np.array(list(places), dtype=np.int64).T
    return first, number, np.frombuffer(digests, np.uint64).reshape(-1, 2)


def _spans(base: DataFrame, min_words: int) -> DataFrame:
    """``(h1, h2, doc, span, later)``: every run; ``later`` if it is known to stand
    earlier elsewhere. Runs that meet within a batch are settled there, so a
    passage of a third of all texts sends one row a batch."""
    kind = base.schema["doc"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                rows, spans, values = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    first, number, value = runs_of(sentences(text), min_words)
                    if len(first):
                        span = (first << (_COUNT + _TAG)) | (np.minimum(number, (1 << _COUNT) - 1) << _TAG) | _tag(text)
                        rows.append(np.full(len(first), row))
                        spans.append(span)
                        values.append(value)
                if not rows:
                    continue
                row, span, value = np.concatenate(rows), np.concatenate(spans), np.concatenate(values)
                rank = pc.rank(batch.column(0), null_placement="at_end", tiebreaker="dense").to_numpy()
                order = np.lexsort((span, rank[row], value[:, 1], value[:, 0]))
                row, span, value = row[order], span[order], value[order]
                same = np.zeros(len(row), dtype=bool)
                same[1:] = (value[1:] == value[:-1]).all(axis=1)
                begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(row))))
                # A repeated row is the same place, not a later one.
                own = (rank[row] == rank[row[begin]]) & (span == span[begin])
                columns = [pa.array(value[:, k].view(np.int64)) for k in (0, 1)]
                columns += [batch.column(0).take(pa.array(row)), pa.array(span), pa.array(same & ~own)]
                runs = pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "span", "later"])
                for start in range(0, len(row), _ROWS):
                    yield runs.slice(start, _ROWS)

    rows = base.select("doc", F.encode("body", "UTF-8").alias("body"))
    return rows.mapInArrow(hashed, f"h1 long, h2 long, doc {kind}, span long, later boolean")


def _repeats(spans: DataFrame) -> DataFrame:
    """``(doc, span)`` of every run that stands earlier elsewhere."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[pa.RecordBatch] = []  # the first row of the run that is going on
        for batch in batches:
            settled = batch.column("later").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(settled)).select(["doc", "span"])
            rows = pa.Table.from_batches([*lead, batch.filter(pa.array(~settled))]).combine_chunks()
            if not rows.num_rows:
                continue
            h1, h2, span = (rows.column(c).to_numpy() for c in ("h1", "h2", "span"))
            doc = rows.column("doc").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
            later = ((doc != doc[begin]) | (span != span[begin])) & ~new
            lead = rows.slice(int(begin[-1]), 1).to_batches()
            yield from rows.select(["doc", "span"]).filter(pa.array(later)).to_batches()

    where = F.when(F.col("later"), F.xxhash64("doc", "span")).otherwise(F.col("h1"))
    dealt = spans.repartition(where).sortWithinPartitions("h1", "h2", F.col("doc").asc_nulls_last(), "span")
    kind = spans.schema["doc"].dataType.simpleString()
    return dealt.mapInArrow(stream, f"doc {kind}, span long")


def drop_repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """All rows and columns of ``docs`` with the sentences under a repeated run
    removed from the text, and ``n_sentences`` and ``n_removed`` behind them.

    Every whole sentence inside a repeated passage of ``min_words`` words or more
    goes, also where the passage begins or ends within a sentence; those cut
    sentences stay. A shorter passage goes where it holds half as many words
    from a bound of sentences on, or up to one.

    The first place of a run is the one of the smallest id (NULL last), then the
    earliest in its text; runs may repeat within a text. A NULL text stays NULL,
    with no sentences. A text with fewer than ``min_words`` words has no run.
    Repeated rows of one id and text count as one place, so none of them is
    emptied. An empty table gives no rows.
    """
    if not 0 < min_words < 1 << _COUNT:
        raise ValueError(f"min_words must be between 1 and {(1 << _COUNT) - 1}")
    repeats = _repeats(_spans(texts_of(docs, id_col, text_col), min_words))
    # At most three runs for each sentence of one text.
    found = repeats.groupBy("doc").agg(F.collect_set("span").alias("spans"))
    place, at = docs.columns.index(text_col), docs.columns.index(id_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = F.encode(F.col(f"c{place}").cast("string"), "UTF-8")
    joined = plain.withColumn(f"c{place}", body).join(found, F.col(f"c{at}").eqNullSafe(F.col("doc")), "left").drop("doc")
    fields = [T.StructField(f.name, T.StringType() if i == place else f.dataType) for i, f in enumerate(docs.schema)]
    schema = T.StructType([*fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    half = _half(min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place, _CUT_BYTES)):
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(fields)).to_pylist(), strict=True):
                kept, n, gone = _without(text, spans or [], half)
                texts.append(kept)
                counts.append(n)
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(fields))]
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(cut, schema)


def _without(text: bytes | None, spans: list[int], half: int) -> tuple[str | None, int, int]:
    """The text without the sentences under the spans, its number of sentences
    and how many went."""
    if text is None:
        return None, 0, 0
    pieces = sentences(text)
    tag = _tag(text) if spans else 0
    mine = [s for s in spans if s & ((1 << _TAG) - 1) == tag]
    if not mine:
        return text.decode("utf-8"), len(pieces), 0
    ends = np.cumsum([len(p.split()) for p in pieces])
    edge = np.zeros(ends[-1] + 1, dtype=np.int64)
    for span in mine:
        start, number = span >> (_COUNT + _TAG), (span >> _TAG) & ((1 << _COUNT) - 1)
        edge[start] += 1
        # What is longer is a whole sentence.
        edge[start + number if number <= half else ends[np.searchsorted(ends, start, "right")]] -= 1
    bare = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] == 0)])
    starts = np.concatenate([[0], ends[:-1]])
    gone = bare[ends] == bare[starts]
    # A piece without words goes with the words around it.
    for i in np.flatnonzero(ends == starts):
        gone[i] = 0 < ends[i] < ends[-1] and bare[ends[i] + 1] == bare[ends[i] - 1]
    kept = b"".join(p for p, g in zip(pieces, gone, strict=True) if not g)
    return kept.decode("utf-8"), len(pieces), int(gone.sum())
