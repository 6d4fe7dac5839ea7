"""Texts in bundles, for steps that need a corpus-wide fact about every word.

A row per word would make the shuffles many times larger than the texts. Here
documents are dealt into bundles of bounded size by a hash, compressed; a
bundle's distinct words go out in blocks by the hash of the word, one Spark
group per block answers each distinct word once, and the answers come back to
the bundle by position in its sorted words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import n_buckets, split_sums, texts_of

BUNDLE_BYTES = 24 << 20
_FLUSH_BYTES = 32 << 20
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def pack_table(batch: pa.RecordBatch | pa.Table) -> bytes:
    """Compressed bytes of a table."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def text_bundles(docs: DataFrame, id_col: str, text_col: str, bundle_bytes: int = BUNDLE_BYTES, **extra: Column):
    """``(bundle, blob)``: the documents of a bundle in one or more blobs.

    A blob is a table of ``doc``, ``body`` (UTF-8) and the ``extra`` columns
    over ``doc`` and ``body``.
    """
    base = texts_of(docs, id_col, text_col)
    n = n_buckets(base, bundle_bytes, F.octet_length("body").cast("long"))
    rows = base.select(
        F.pmod(F.xxhash64("doc", "body"), F.lit(n)).cast("int").alias("bundle"),
        "doc",
        F.encode("body", "UTF-8").alias("body"),
        *[column.alias(name) for name, column in extra.items()],
    )

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bundle = table.column("bundle").to_numpy()
        order = np.argsort(bundle, kind="stable")
        found, starts = np.unique(bundle[order], return_index=True)
        content = table.drop_columns("bundle")
        stops = [*starts[1:], len(order)]
        blobs = [pack_table(content.take(pa.array(order[a:b]))) for a, b in zip(starts, stops, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["bundle", "blob"]
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _FLUSH_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(deal, "bundle int, blob binary"), n


def texts_in(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for blob in blobs:
        yield unpack_table(blob.as_py())


class Words:
    """The words of a bundle as numbers of its sorted distinct words."""

    def __init__(self, token_lists: Iterator[Sequence[bytes]]):
        number = _Numbering()
        parts, self.sizes = [], []
        for tokens in token_lists:
            codes = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            parts.append(codes)
            self.sizes.append(len(codes))
        self.distinct = sorted(number)
        rank = np.empty(len(number), dtype=np.int32)
        rank[np.fromiter(map(number.__getitem__, self.distinct), np.int32, len(number))] = np.arange(len(number))
        self.codes = rank[np.concatenate(parts)] if parts else np.zeros(0, np.int32)
        self.sizes = np.array(self.sizes, dtype=np.int64)

    @classmethod
    def lower_cased(cls, bodies: pa.Array, end: bytes) -> Words:
        """The lower-cased words of each text (binary, UTF-8) and one ``end``, no word itself.

        Arrow's ASCII functions change A to Z only, and cut at U+0020 and U+0009
        to U+000D only.
        """
        lists = pc.ascii_split_whitespace(pc.ascii_lower(bodies.view(pa.string())))
        encoded = lists.flatten().dictionary_encode()
        distinct = pa.concat_arrays([encoded.dictionary, pa.array([end.decode()])])
        order = pc.sort_indices(distinct).to_numpy()
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        found = rank[encoded.indices.to_numpy()]
        distinct = distinct.take(pa.array(order)).view(pa.binary()).to_pylist()
        # White space at a text's ends leaves an empty word there, the first in order.
        blank = int(distinct[0] == b"")
        kept = found >= blank
        words = cls.__new__(cls)
        words.distinct = distinct[blank:]
        words.sizes = split_sums(pc.list_value_length(lists).to_numpy().astype(np.int64), kept.astype(np.int64)) + 1
        words.codes = np.full(int(words.sizes.sum()), rank[-1] - blank, dtype=np.int32)
        inside = np.ones(len(words.codes), dtype=bool)
        inside[np.cumsum(words.sizes) - 1] = False
        words.codes[inside] = found[kept] - blank
        return words

    def blocks(self, n_blocks: int) -> list[np.ndarray]:
        """Positions of the distinct words of each block."""
        block = np.fromiter(map(zlib.crc32, self.distinct), np.uint32, len(self.distinct)) % np.uint32(n_blocks)
        order = np.argsort(block, kind="stable")
        bounds = np.searchsorted(block[order], np.arange(n_blocks + 1))
        return [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class _Numbering(dict):
    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def word_requests(
    bundles: DataFrame,
    n_blocks: int,
    words_of: Callable[[list[pa.Table]], Words],
    facts_of: Callable[[list[pa.Table], Words], dict[str, np.ndarray]] | None = None,
) -> DataFrame:
    """``(block, bundle, blob)``: the distinct words of each bundle, in blocks.

    A blob is a table of ``word`` and what ``facts_of`` adds per distinct word.
    """

    def ask(table: pa.Table) -> pa.Table:
        bundle = table.column("bundle")[0].as_py()
        tables = list(texts_in(table.column("blob")))
        words = words_of(tables)
        facts = facts_of(tables, words) if facts_of else {}
        distinct = pa.array(words.distinct, pa.binary())
        rows = []
        for block, mine in enumerate(words.blocks(n_blocks)):
            if len(mine):
                columns = {"word": distinct.take(pa.array(mine))} | {k: pa.array(v[mine]) for k, v in facts.items()}
                rows.append((block, bundle, pack_table(pa.table(columns))))
        return pa.table(
            {
                "block": pa.array([r[0] for r in rows], pa.int32()),
                "bundle": pa.array([r[1] for r in rows], pa.int32()),
                "blob": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return bundles.groupBy("bundle").applyInArrow(ask, "block int, bundle int, blob binary")


def answer_words(requests: DataFrame, answer: Callable[[list[pa.Table]], list[pa.Table]]) -> DataFrame:
    """``(bundle, block, blob)``: one group per block sees all its words.

    ``answer`` gets the requests of a block, a table per bundle, and returns for
    each a table with a row per word.
    """

    def reply(table: pa.Table) -> pa.Table:
        asked = [unpack_table(b.as_py()) for b in table.column("blob")]
        answers = answer(asked)
        return pa.table(
            {
                "bundle": table.column("bundle"),
                "block": table.column("block"),
                "blob": pa.array([pack_table(t) for t in answers], pa.binary()),
            }
        )

    return requests.groupBy("block").applyInArrow(reply, "bundle int, block int, blob binary")


def combined_words(asked: list[pa.Table]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of several requests, and each request's words as numbers."""
    words = pa.concat_arrays([c for t in asked for c in t.column("word").chunks]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    return words.dictionary.to_pylist(), np.split(codes, np.cumsum([t.num_rows for t in asked])[:-1])


def with_answers(
    bundles: DataFrame,
    answers: DataFrame,
    n_blocks: int,
    words_of: Callable[[list[pa.Table]], Words],
    finish: Callable[..., pa.Table],
    schema: str,
    more: DataFrame | None = None,
) -> DataFrame:
    """Bring the answers of every bundle's words back to its texts.

    ``finish`` gets the bundle's tables, its words and a table of answers with
    a row per distinct word, in order. If there are ``more`` answers in the same
    columns, it also gets the list of a bundle's tables among them, by block.
    """

    handed = more is not None

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = list(texts_in(left.column("blob")))
        words = words_of(tables)
        mine = words.blocks(n_blocks)
        found = {b.as_py(): unpack_table(x.as_py()) for b, x in zip(right.column("block"), right.column("blob"), strict=True)}
        others = [found[b] for b in sorted((b for b in found if b < 0), reverse=True)]
        blocks = sorted(b for b in found if b >= 0)
        facts = pa.concat_tables([found[b] for b in blocks])
        at = np.concatenate([mine[b] for b in blocks])
        inverse = np.empty(len(at), dtype=np.int64)
        inverse[at] = np.arange(len(at))
        return finish(tables, words, facts.take(pa.array(inverse)), *([others] if handed else []))

    if handed:
        # Their blocks are numbered from -1 down.
        answers = answers.unionByName(more.withColumn("block", -1 - F.col("block")))
    return bundles.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(meet, schema)
