"""Language-model scores from a log-frequency Bloom filter.

After Talbot and Osborne (2007): an n-gram of count c is entered once for each
level 1 to 1 + floor(log2 c), and a lookup probes level after level until one
is missing. The filter is cut into segments by the bigram's hash, sized by the
bigrams it holds. A bundle of texts sends the hashes of its distinct bigrams to
their segments, with their training counts; the task that builds a segment also
looks up what was sent to it, and the levels come back by position. So no task
holds more than one segment, and the texts are scored in one pass, however large
the filter is. Word counts are exact and come from one group per block of words
(see ``bundles``).

A token w after v has the probability
``(1 - mix) * p1(w) + mix * c(v w) / c(v)`` with the unigram estimate
``p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``; after a v that was never seen it
has ``p1(w)``. c(v w) is the filter's quantised count, at most c(v).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.bundles import (
    Words,
    answer_words,
    combined_words,
    pack_table,
    text_bundles,
    texts_in,
    unpack_table,
    with_answers,
    word_requests,
)
from reviewfold.llm.common import stored

MIX = 0.15
BITS_PER_ENTRY = 8
PROBES = 5
# Text of a bundle: what a worker holds. Bigrams that are probed at once stay in its cache.
BUNDLE_BYTES = 10 << 20
_AT_ONCE = 1 << 16
# Bigrams a segment is planned for.
SEGMENT_TOKENS = 8 << 20
# Of no effect since segments are no longer broadcast in rounds.
ROUND_BYTES = 192 << 20
# Bigrams are known by 48 bits of a hash; their first bits name the segment.
_HASH_BITS = 48
# No word holds white space: the mark of the end, and of the place before a text.
_END = b"\n"


def _words(tables: list[pa.Table]) -> Words:
    return Words.lower_cased(pa.concat_arrays([c for t in tables for c in t.column("body").chunks]), _END)


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For every token the 48-bit hash of (word before, word), and the number of
    the word before. Before a text's first word stands the end mark."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), np.uint64, len(words.distinct))
    codes = words.codes
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    firsts = np.cumsum(words.sizes) - words.sizes
    before[firsts] = codes[firsts + words.sizes - 1]
    with np.errstate(over="ignore"):
        pair = hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes]
    return _mix64(pair) >> np.uint64(64 - _HASH_BITS), before


def _trained(tables: list[pa.Table]) -> np.ndarray:
    return np.concatenate([t.column("train").to_numpy() for t in tables])


@dataclass(frozen=True)
class Filter:
    """Segments of the filter that are at hand: number -> (bits, bytes)."""

    segment_bits: int
    parts: dict[int, tuple[int, np.ndarray]]

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Quantised count of each bigram; 0 if it was not entered."""
        # Each bigram is looked up once, segment by segment: the bits of one lie together.
        order = np.argsort(pairs)
        ordered = pairs[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), ordered[1:] != ordered[:-1]]))
        distinct = ordered[starts]
        found = np.zeros(len(distinct), dtype=np.int8)
        segment = distinct >> np.uint64(_HASH_BITS - self.segment_bits)
        for number, (bits, raw) in self.parts.items():
            first, last = np.searchsorted(segment, np.array([number, number + 1], np.uint64))
            for at in range(first, last, _AT_ONCE):
                live, step = np.arange(at, min(at + _AT_ONCE, last)), 1
                while len(live):
                    live = live[_entered(distinct[live], step, bits, raw)]
                    found[live] = step
                    step += 1
        level = np.empty(len(pairs), dtype=np.int8)
        level[order] = np.repeat(found, np.diff(np.append(starts, len(pairs))))
        return level


def _entered(pairs: np.ndarray, level: int, bits: int, raw: np.ndarray) -> np.ndarray:
    """Positions of the bigrams all of whose bits at a level are set. What misses
    one is not looked up further once that pays for the copy."""
    left = np.arange(len(pairs))
    a, b = _mixed(pairs, level)
    found = np.ones(len(left), dtype=bool)
    for k in range(PROBES):
        where = _place(a, b, k, bits)
        found &= (raw[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 == 1
        if np.count_nonzero(found) < 0.7 * len(found):
            left, a, b = left[found], a[found], b[found]
            found = np.ones(len(left), dtype=bool)
    return left[found]


def _mixed(pairs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a bigram at one level."""
    with np.errstate(over="ignore"):
        a = _mix64(pairs + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        return a, _mix64(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit position of bigrams, from their two hashes."""
    with np.errstate(over="ignore"):
        # The high part of a product maps the hash to the range without a division.
        return (((a + np.uint64(k) * b) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def expected_count(level: np.ndarray) -> np.ndarray:
    """Middle of the counts 2^(level-1) to 2^level - 1; 0 for level 0."""
    return np.where(level > 0, (3.0 * 2.0 ** (level - 1.0) - 1.0) / 2.0, 0.0)


def _segment(table: pa.Table) -> pa.Table:
    """Build one segment from the counts of every bundle."""
    pairs, counts = _entries([unpack_table(b.as_py()) for b in table.column("blob")])
    order, starts = _stretches(pairs)
    bits, raw = _built(pairs[order][starts], np.add.reduceat(counts[order], starts))
    return pa.table(
        {
            "segment": table.column("segment").slice(0, 1),
            "bits": pa.array([bits], pa.int64()),
            "raw": pa.array([raw.tobytes()], pa.binary()),
        }
    )


def _entries(found: list[pa.Table]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of several tables with their counts, one after the other."""
    return np.concatenate([_joined(t) for t in found]), np.concatenate([t.column("n").to_numpy() for t in found])


def _stretches(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal bigrams together, and the first place of each in it."""
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _built(pairs: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of bits and bytes of a segment that holds these distinct bigrams."""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    bits = min(max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8), (1 << 32) - 8)
    raw = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        a, b = _mixed(pairs[levels >= level], level)
        for k in range(PROBES):
            raw[_place(a, b, k, bits)] = True
    return bits, np.packbits(raw, bitorder="little")


def _answered(table: pa.Table, segment_bits: int) -> pa.Table:
    """Build one segment and look up in it all bigrams that were sent to it, each once."""
    number = table.column("segment")[0].as_py()
    found = [unpack_table(b.as_py()) for b in table.column("blob")]
    pairs, counts = _entries(found)
    order, starts = _stretches(pairs)
    distinct, total = pairs[order[starts]], np.add.reduceat(counts[order], starts)
    del pairs, counts
    entered = total > 0
    bits, raw = _built(distinct[entered], total[entered])
    level = np.empty(len(order), np.int8)
    level[order] = np.repeat(Filter(segment_bits, {number: (bits, raw)}).counts(distinct), np.diff(np.append(starts, len(order))))
    ends = np.cumsum([t.num_rows for t in found])
    blobs = [pack_table(pa.table({"level": pa.array(part)})) for part in np.split(level, ends[:-1])]
    return pa.table({"bundle": table.column("bundle"), "block": table.column("segment"), "blob": pa.array(blobs, pa.binary())})


def _joined(t: pa.Table) -> np.ndarray:
    high = t.column("high").to_numpy().astype(np.uint64)
    return (high << np.uint64(32)) | t.column("low").to_numpy().astype(np.uint64)


def _levels(bundles: DataFrame, segment_bits: int) -> DataFrame:
    """``(bundle, block, blob)``: the filter's level of every distinct bigram of every
    bundle, in the order of the bigrams; a block is a segment."""

    def ask(table: pa.Table) -> pa.Table:
        tables = list(texts_in(table.column("blob")))
        words = _words(tables)
        pairs, trained = _bigrams(words)[0], np.repeat(_trained(tables), words.sizes)
        order, starts = _stretches(pairs)
        counts = np.add.reduceat(trained[order].astype(np.int64), starts)
        pairs = pairs[order[starts]]
        segment = (pairs >> np.uint64(_HASH_BITS - segment_bits)).astype(np.int64)
        bounds = np.searchsorted(segment, np.arange((1 << segment_bits) + 1))
        rows = []
        for number, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b > a:
                mine = pairs[a:b]
                # Sorted, the high part compresses to almost nothing.
                content = {
                    "high": pa.array((mine >> np.uint64(32)).astype(np.uint16)),
                    "low": pa.array((mine & np.uint64(0xFFFFFFFF)).astype(np.uint32)),
                    "n": pa.array(counts[a:b]),
                }
                rows.append((number, pack_table(pa.table(content))))
        return pa.table(
            {
                "segment": pa.array([r[0] for r in rows], pa.int32()),
                "bundle": pa.array([table.column("bundle")[0].as_py()] * len(rows), pa.int32()),
                "blob": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    asked = bundles.groupBy("bundle").applyInArrow(ask, "segment int, bundle int, blob binary")
    return asked.groupBy("segment").applyInArrow(lambda table: _answered(table, segment_bits), "bundle int, block int, blob binary")


def _word_counts(bundles: DataFrame, n_blocks: int) -> DataFrame:
    """Exact training count of every word of every bundle, and the totals of a
    block in rows without a bundle."""

    def own_counts(tables: list[pa.Table], words: Words) -> dict[str, np.ndarray]:
        mine = words.codes[np.repeat(_trained(tables), words.sizes)]
        return {"n": np.bincount(mine, minlength=len(words.distinct)).astype(np.int64)}

    def answer(asked: list[pa.Table]) -> list[pa.Table]:
        distinct, codes = combined_words(asked)
        total = np.zeros(len(distinct), dtype=np.int64)
        for c, t in zip(codes, asked, strict=True):
            total[c] += t.column("n").to_numpy()
        sums = {"N": int(total.sum()), "V": int((total > 0).sum())}
        # Each block's totals travel with its first answer.
        tables = [pa.table({"c": pa.array(total[c])}) for c in codes]
        tables[0] = tables[0].replace_schema_metadata({k: str(v) for k, v in sums.items()})
        return tables

    return answer_words(word_requests(bundles, n_blocks, _words, own_counts), answer)


def _totals(answers: DataFrame) -> tuple[int, int]:
    """N and V from the answers' marks."""

    def read(batches):
        for batch in batches:
            n = v = 0
            for blob in batch.column("blob"):
                marks = pa.ipc.open_stream(blob.as_py()).schema.metadata or {}
                n, v = n + int(marks.get(b"N", 0)), v + int(marks.get(b"V", 0))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v], pa.int64())], names=["n", "v"])

    row = answers.select("blob").mapInArrow(read, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    mix: float = MIX,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Score every text with a model of those for which ``train`` holds.

    ``train`` is an expression over ``doc``, the id; NULL counts as false.
    Columns: the id, ``held_out`` (not used for training), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10). A NULL
    or empty text is one end token. Without training texts every token has the
    estimate of an unseen one. Repeated rows count and are scored each on their
    own. An empty table gives no rows. ``round_bytes`` has no effect any more.
    """
    bundles, n_bundles = text_bundles(docs, id_col, text_col, BUNDLE_BYTES, train=F.coalesce(train, F.lit(False)))
    answers = stored(_word_counts(bundles, n_bundles), "word-counts")
    n_tokens, n_distinct = _totals(answers)
    segment_bits = max(1, math.ceil(math.log2(max(1, n_tokens) / SEGMENT_TOKENS + 1)))
    levels = _levels(bundles, segment_bits)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, held_out boolean, n_tokens long, n_known long, base_score double, gain double"

    def finish(tables: list[pa.Table], words: Words, facts: pa.Table, found: list[pa.Table]) -> pa.Table:
        c = facts.column("c").to_numpy()
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_distinct + 1)))
        pairs, before = _bigrams(words)
        order, starts = _stretches(pairs)
        level = np.empty(len(pairs), np.int8)
        level[order] = np.repeat(np.concatenate([t.column("level").to_numpy() for t in found]), np.diff(np.append(starts, len(pairs))))
        context_count = c[before].astype(float)
        known = context_count > 0
        p1 = (10.0**base)[words.codes[known]]
        share = np.minimum(expected_count(level[known]), context_count[known]) / context_count[known]
        gain = np.zeros(len(pairs))
        gain[known] = np.log10((1.0 - mix) * p1 + mix * share) - base[words.codes[known]]
        return pa.table(
            {
                "doc": _column(tables, "doc"),
                "held_out": pa.array(~_trained(tables)),
                "n_tokens": pa.array(words.sizes),
                "n_known": pa.array(_by_text(words, c[words.codes] > 0).astype(np.int64)),
                "base_score": pa.array(_by_text(words, base[words.codes])),
                "gain": pa.array(_by_text(words, gain)),
            }
        )

    whole = with_answers(bundles, answers, n_bundles, _words, finish, schema, more=levels)
    return whole.select(
        F.col("doc").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("base_score") + F.col("gain")).alias("score"),
    )


def _column(tables: list[pa.Table], name: str) -> pa.ChunkedArray:
    return pa.chunked_array([c for t in tables for c in t.column(name).chunks], type=tables[0].schema.field(name).type)


def _by_text(words: Words, values: np.ndarray) -> np.ndarray:
    starts = np.cumsum(words.sizes) - words.sizes
    return np.add.reduceat(values.astype(float), starts)
