"""Bags of terms and TF-IDF as relations: one row per (text, term).

The relational form has no limit on the number of terms. ``models`` builds
sparse ML vectors from the same terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.text import drop_words, word_ngrams, word_tokens
from reviewfold.operators.bundles import TermBundle, deal_out, meet, sequences
from reviewfold.operators.layout import one_per_element, spread

DEFAULT_MIN_DF = 2
DEFAULT_MAX_DF = 0.95
#: Words whose n-grams are counted at once, and distinct terms a task holds before it sends them.
PART_WORDS, HELD_TERMS = 1 << 20, 1 << 22
#: Text bytes for each group in which counts of terms are added up.
GROUP_BYTES = 8 << 20
#: Words of a bundle of texts that is weighed in one place.
BUNDLE_WORDS = 1_000_000
_HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: Column, stop_words: Iterable[str] = (), low: int = 1, high: int = 3) -> Column:
    """Bag of n-grams of a text: words, stop words removed, then n-grams."""
    return word_ngrams(drop_words(word_tokens(text), stop_words), low, high)


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """Number of texts each term occurs in. A term is made distinct inside its
    row, so no shuffle is needed before the count."""
    each = one_per_element(spread(df), [], F.array_distinct(terms), "term")
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def kept_terms(frequencies: DataFrame, n_texts: int, min_df: int = DEFAULT_MIN_DF, max_df: float = DEFAULT_MAX_DF):
    """Terms in at least ``min_df`` texts and at most a ``max_df`` share."""
    return frequencies.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df) * n_texts)))


def ngram_frequency(df: DataFrame, text: str, stop_words: Iterable[str] = (), low: int = 1, high: int = 3) -> DataFrame:
    """``document_frequency`` of the n-grams of a text. A task counts the distinct n-grams
    of many texts by numbers and sends each term once, in compressed lists for groups of
    terms; the group of a term follows from the hashes of its words, so a group's size
    is bounded by the number of groups, whatever term is frequent."""
    spark = df.sparkSession
    n_bytes = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(spark._jsparkSession.sessionState().conf().numShufflePartitions(), spark.sparkContext.defaultParallelism)
    groups = max(parts, -(-n_bytes // GROUP_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lists in word_slices(batch.column(0), PART_WORDS):
                for found in _counted(lists, low, high, groups):
                    held.append(found)
                    size += len(found[0])
                if size >= HELD_TERMS:
                    yield from _sent(held)
                    held, size = [], 0
        if size:
            yield from _sent(held)

    words = spread(df.select(text)).select(drop_words(word_tokens(F.col(text)), stop_words).alias("_words"))
    lists = words.mapInArrow(count, "group long, size long, terms binary, times binary")
    dealt = lists.repartition(min(groups, parts), "group")
    return dealt.groupBy("group").applyInArrow(_added_up, "term string, df long")


def word_slices(lists: pa.ListArray, words: int) -> Iterator[pa.ListArray]:
    """Stretches of lists with about ``words`` words; a longer list is one of its own."""
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, base + words, "right")))
        yield lists.slice(start, stop - start)
        start, base = stop, ends[stop - 1]


def _counted(lists: pa.ListArray, low: int, high: int, groups: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each length of n-grams the distinct ones, in how many lists they stand, and their groups."""
    for terms, group, df, _, _ in postings(lists, low, high, groups):
        yield terms, df, group


def postings(lists: pa.ListArray, low: int, high: int, groups: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-grams the distinct ones, their groups, in how many lists they
    stand, and term by term the places of these lists and how often the term stands there."""
    words, each = lists.flatten(), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    code, line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), each)
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    place, width = np.arange(len(words)), max(1, len(coded.dictionary))
    gram, mixed = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
    for n in range(1, high + 1):
        place = place[: max(0, len(words) - n + 1)] if n == 1 else place[place + n - 1 < len(words)]
        place = place[line[place] == line[place + n - 1]]
        if not len(place):
            return
        last = code[place + n - 1]
        # Sequences are numbered by that of the words before the last and the last word.
        _, first, number = np.unique(gram[place] * width + last, return_index=True, return_inverse=True)
        gram[place], mixed[place] = number, (mixed[place] + hashes[last]) * _HASH_FACTOR
        if n < low:
            continue
        pairs = np.sort(number * len(lists) + line[place])
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        texts, at = np.divmod(pairs[starts], len(lists))
        parts = [words.take(pa.array(place[first] + k)) for k in range(n)]
        terms = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        group = ((mixed[place[first]] >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        yield terms, group, np.bincount(texts, minlength=len(first)), at, np.diff(starts, append=len(pairs))


def _sent(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row for each group with its terms and their counts."""
    group = np.concatenate([h[2] for h in held])
    order = np.argsort(group, kind="stable")
    terms, times, group = pa.concat_arrays([h[0] for h in held]).take(pa.array(order)), np.concatenate([h[1] for h in held])[order], group[order]
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    # No word holds a line break.
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), terms), "\n")
    for a, b, text in zip(np.append(0, ends), ends, texts, strict=False):
        text = text.as_buffer().to_pybytes()
        row = [int(group[a]), len(text), pa.compress(text, "zstd", asbytes=True), pa.compress(times[a:b].tobytes(), "zstd", asbytes=True)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["group", "size", "terms", "times"])


def _added_up(rows: pa.Table) -> pa.Table:
    """The terms of a group with their sums."""
    terms, times = [], []
    for size, names, counts in zip(*(rows.column(c).to_pylist() for c in ("size", "terms", "times")), strict=True):
        text = pa.array([pa.decompress(names, size, "zstd", asbytes=True)], pa.binary()).cast(pa.string())
        terms.append(pc.split_pattern(text, "\n").flatten())
        times.append(np.frombuffer(pa.decompress(counts, 8 * len(terms[-1]), "zstd", asbytes=True), np.int64))
    coded = pa.concat_arrays(terms).dictionary_encode()
    sums = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate(times)).astype(np.int64)
    return pa.table([coded.dictionary, pa.array(sums)], names=["term", "df"])


def prune_terms(
    df: DataFrame,
    text: str,
    stop_words: Iterable[str] = (),
    min_df: int = DEFAULT_MIN_DF,
    max_df: float = DEFAULT_MAX_DF,
    low: int = 1,
    high: int = 3,
) -> DataFrame:
    return kept_terms(ngram_frequency(df, text, stop_words, low, high), df.count(), min_df, max_df)


@dataclass(frozen=True)
class TermWeights:
    """Inverse document frequencies of the training texts."""

    idf: DataFrame
    n_texts: int
    stop_words: tuple[str, ...] = ()
    low: int = 1
    high: int = 3

    def transform(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """L2-normalized weights of every kept term, one row per (text, term). Texts meet
        the terms in bundles: a text moves once, a term once for each bundle that holds it.
        Rows with equal ids are one text."""
        low, high = self.low, self.high
        words = drop_words(word_tokens(F.col(text)), self.stop_words)
        dealt = deal_out(df.withColumn("_key", F.xxhash64(id_col)), "_key", words, BUNDLE_WORDS, [id_col])

        def weigh(texts: pa.Table, rows: pa.Table) -> pa.Table:
            ids = texts.column(id_col).combine_chunks().dictionary_encode(null_encoding="encode")
            at = texts.column_names.index("_key")
            bundle = TermBundle(texts.set_column(at, "_key", ids.indices), rows, "_key", low, high)
            raw = bundle.tf * bundle.numbers("idf")
            length = np.sqrt(bundle.by_text(raw * raw))
            names = [ids.dictionary.take(bundle.ids).take(pa.array(bundle.post_text)), bundle.terms.take(pa.array(bundle.post_term))]
            numbers = [pa.array(bundle.tf.astype(np.int64)), pa.array(raw / length[bundle.post_text])]
            return pa.table([*names, *numbers], names=[id_col, "term", "tf", "weight"])

        kind = df.schema[id_col].dataType.simpleString()
        schema = f"`{id_col}` {kind}, term string, tf long, weight double"
        return meet(dealt, "_key", lambda lists: [terms for _, terms in sequences(lists, low, high)], self.idf.select("term", "idf"), "term", weigh, schema)


def fit_term_weights(
    train: DataFrame,
    text: str,
    stop_words: Iterable[str] = (),
    min_df: int = DEFAULT_MIN_DF,
    max_df: float = DEFAULT_MAX_DF,
    low: int = 1,
    high: int = 3,
) -> TermWeights:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    stop = tuple(stop_words)
    n_texts = train.count()
    kept = kept_terms(ngram_frequency(train, text, stop, low, high), n_texts, min_df, max_df)
    idf = kept.withColumn("idf", F.log(F.lit(1.0 + n_texts) / (F.col("df") + 1)) + 1)
    return TermWeights(idf, n_texts, stop, low, high)
