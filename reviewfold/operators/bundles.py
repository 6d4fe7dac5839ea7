"""Texts that meet a table of words in bundles.

A join of every word of every text with a wide row per word moves that row once per
text and word. Here texts are dealt out in bundles of a bounded number of words. A
bundle asks the table once for each of its distinct words, and one task then holds
the texts of a bundle beside the rows of its words, and nothing else. What is moved
is the texts and, per bundle, its distinct words with their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.operators.layout import spread

#: Bundles of a small input for each core, so that no core waits for another.
_PER_CORE = 4
#: Text bytes for each block of terms that answers the bundles.
BLOCK_BYTES = 16 << 20
#: Words that a bundle holds at least, if a smaller one only served to fill the cores.
_LEAST_WORDS = 20_000


def deal_out(df: DataFrame, id_col: str, words: Column, size: int, keep: Sequence[str] = (), joined: bool = False) -> DataFrame:
    """``(id, keep, _words, _bundle)``: bundles of about ``size`` words. All rows of an id
    are in one bundle; rows without an id are spread. ``joined`` words, none of which may
    hold a blank, travel as one text."""
    texts = spread(df).select(id_col, *keep, words.alias("_words"))
    n_words = texts.agg(F.sum(F.greatest(F.size("_words"), F.lit(0)).cast("long"))).first()[0] or 0
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bundles = max(1, -(-n_words // size), min(_PER_CORE * cores, n_words // _LEAST_WORDS))
    parts = max(spark._jsparkSession.sessionState().conf().numShufflePartitions(), cores)
    hashed = F.when(F.col(id_col).isNull(), F.xxhash64("_words")).otherwise(F.xxhash64(id_col))
    dealt = texts.withColumn("_bundle", F.pmod(hashed, F.lit(bundles)))
    dealt = dealt.withColumn("_words", F.array_join("_words", " ")) if joined else dealt
    return dealt.repartition(min(bundles, parts), "_bundle")


def meet(
    dealt: DataFrame,
    id_col: str,
    asked: Callable[[pa.ListArray], Iterable[pa.Array]],
    table: DataFrame,
    on: str,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """``work(texts, rows)`` of every bundle: its texts, and the rows of ``table`` whose
    ``on`` is among the words that ``asked`` gives for its lists of words. A text without
    an id asks for nothing."""

    def distinct(texts: pa.Table) -> pa.Table:
        words = pc.unique(pa.chunked_array(asked(_lists_of(texts, id_col)), pa.string()).drop_null())
        return pa.table([pa.repeat(texts.column("_bundle")[0], len(words)), words], names=["_asking", on])

    # Both sides read one exchange of the texts.
    found = dealt.groupBy("_bundle").applyInArrow(distinct, f"_asking long, `{on}` string").join(table, on)
    return dealt.groupBy("_bundle").cogroup(found.groupBy("_asking")).applyInArrow(work, schema)


def meet_terms(
    dealt: DataFrame,
    id_col: str,
    n_bytes: int,
    low: int,
    high: int,
    table: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """As ``meet``, for the sequences of ``low`` to ``high`` words and a table with a ``term``.

    There are about as many distinct sequences as words, so a row for each would be many
    times the texts. A bundle asks with sorted 32-bit numbers of its sequences, one list for
    each block of the table, and gets the rows whose term has such a number, in a compressed
    list. ``work`` compares the terms themselves, so a row too many does no harm.
    ``n_bytes`` is the size of all texts and gives the number of blocks."""
    spark = dealt.sparkSession
    parts = max(spark._jsparkSession.sessionState().conf().numShufflePartitions(), spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))

    def ask(texts: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate(_placed(_sequence_hashes(_lists_of(texts, id_col), low, high), blocks)))
        block, key = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        blobs = [pa.compress(np.diff(key[a:b], prepend=np.uint32(0)).tobytes(), "zstd", asbytes=True) for a, b in zip(starts, np.append(starts, len(block))[1:], strict=True)]
        columns = [pa.array(block[starts], pa.int64()), pa.repeat(texts.column("_bundle")[0], len(starts)), pa.array(np.diff(starts, append=len(block)), pa.int64()), pa.array(blobs, pa.binary())]
        return pa.table(columns, names=["_block", "_asking", "_size", "_blob"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = _placed([_hashes(batch.column("term"))[0]], blocks)[0]
            columns = [pa.array(x.astype(np.int64)) for x in (placed >> np.uint64(32), placed & np.uint64(0xFFFFFFFF))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_block", "_number"])

    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        # In the order of the terms, so that lists compress well.
        rows = rows.take(pc.sort_indices(rows.column("term"))).combine_chunks()
        numbers, blobs = rows.column("_number").to_numpy(), []
        rows = rows.drop_columns(["_block", "_number"])
        for size, blob in zip(asked.column("_size").to_pylist(), asked.column("_blob"), strict=True):
            key = np.cumsum(np.frombuffer(pa.decompress(blob.as_buffer(), 4 * size, "zstd"), np.uint32), dtype=np.int64)
            at = np.searchsorted(key, numbers)
            blobs.append(packed(rows.take(pa.array(np.flatnonzero(key[np.minimum(at, size - 1)] == numbers)))))
        return pa.table([asked.column("_asking"), pa.array(blobs, pa.binary())], names=["_asking", "_found"])

    kept = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in table.schema])

    def together(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return work(texts, pa.concat_tables([kept.empty_table(), *(unpacked(b).cast(kept) for b in answers.column("_found"))]))

    asks = dealt.groupBy("_bundle").applyInArrow(ask, "_block long, _asking long, _size long, _blob binary").repartition(min(blocks, parts), "_block")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", _block long, _number long"
    numbered = table.mapInArrow(number, kinds).repartition(min(blocks, parts), "_block")
    found = asks.groupBy("_block").cogroup(numbered.groupBy("_block")).applyInArrow(answer, "_asking long, _found binary")
    return dealt.groupBy("_bundle").cogroup(found.groupBy("_asking")).applyInArrow(together, schema)


_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


_BASE = 0x9E3779B97F4A7C15


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its bytes times powers of an odd number, and the power that
    follows its last byte."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    with np.errstate(over="ignore"):
        powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(data), x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1]))
        start, end = offsets[:-1] - first, offsets[1:] - first
        return (sums[end] - sums[start]) * inverse[start], powers[end - start]


def _sequence_hashes(lists: pa.ListArray, low: int, high: int) -> Iterator[np.ndarray]:
    """``_hashes`` of the sequences of ``low`` to ``high`` words joined by a blank, without writing them."""
    own, power = _hashes(lists.flatten())
    line = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    for n in range(low, high + 1):
        many = max(0, len(own) - n + 1)
        whole = np.flatnonzero(line[:many] == line[n - 1 : n - 1 + many])
        with np.errstate(over="ignore"):
            found, after = own[whole], power[whole]
            for k in range(1, n):
                found = found + after * (np.uint64(ord(" ") + 1) + np.uint64(_BASE) * own[whole + k])
                after = after * np.uint64(_BASE) * power[whole + k]
        yield found


def _placed(hashes: Iterable[np.ndarray], blocks: int) -> list[np.ndarray]:
    """Block of each hash in the upper 32 bits, its number in the lower ones."""
    out = []
    with np.errstate(over="ignore"):
        for x in hashes:
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(32))
            out.append((((x >> np.uint64(33)) % np.uint64(blocks)) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
    return out


def _lists_of(texts: pa.Table, id_col: str) -> pa.ListArray:
    lists = texts.column("_words").combine_chunks()
    if not pa.types.is_list(lists.type):
        lists = pc.split_pattern(pc.if_else(pc.equal(lists, ""), pa.scalar(None, lists.type), lists), " ")
    return pc.if_else(texts.column(id_col).combine_chunks().is_valid(), lists, pa.scalar(None, lists.type))


def sequences(lists: pa.ListArray, low: int, high: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The sequences of ``low`` to ``high`` words of each list, and the places of the lists."""
    words = lists.flatten()
    line = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    for n in range(low, high + 1):
        many = max(0, len(words) - n + 1)
        whole = np.flatnonzero(line[:many] == line[n - 1 : n - 1 + many])
        parts = [words.slice(k, many).take(pa.array(whole)) for k in range(n)]
        yield line[whole], parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


class TermBundle:
    """How often each text of a bundle holds each term that the table answered for.

    A text's terms are the sequences of ``low`` to ``high`` of its words; rows with equal
    ids are one text. Postings are in the order of the texts."""

    def __init__(self, texts: pa.Table, rows: pa.Table, id_col: str, low: int, high: int):
        ids = texts.column(id_col).combine_chunks()
        coded = ids.dictionary_encode(null_encoding="encode")
        self.ids, self.text = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms, self.rows = rows.column("term").combine_chunks(), rows
        width, keys = max(1, len(self.terms)), []
        for line, terms in sequences(_lists_of(texts, id_col), low, high):
            place = pc.index_in(terms, value_set=self.terms)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            keys.append(self.text[line[found]] * width + place.drop_null().to_numpy(zero_copy_only=False))
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        self.post_text, self.post_term = np.divmod(key, width)
        self.tf = tf.astype(float)

    def numbers(self, column: str) -> np.ndarray:
        """A column of the table by posting."""
        return self.rows.column(column).to_numpy()[self.post_term]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the postings of each text."""
        return np.bincount(self.post_text, values, len(self.ids))
