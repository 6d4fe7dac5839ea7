"""Vocabulary, id sequences, padding and embedding rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.text import hex_uniform, pad_sequence
from reviewfold.operators.bundles import deal_out
from reviewfold.operators.joins import lookup_vectors
from reviewfold.operators.layout import one_per_element, spread
from reviewfold.operators.ordering import ranked
from reviewfold.operators.skew import broadcast_limit

_HEX_GROUPS = 4
# Bytes of a broadcast word at most, with its id; a vocabulary with longer words is never broadcast.
HEAD_WORD_BYTES = 128
# Words of a bundle of texts that is encoded in one place.
ENCODE_WORDS = 2_000_000
# The word that stands for every unknown word.
OOV_WORD = "Out_Of_Vocab_Token"


def build_vocab(df: DataFrame, tokens: Column) -> DataFrame:
    """Words by falling frequency with ids from 1; ties go by the word itself."""
    words = one_per_element(spread(df), [], tokens, "word")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [F.col("n").desc(), F.col("word").asc()], "token_id")


def with_oov(vocab: DataFrame, word: str = OOV_WORD) -> DataFrame:
    """Vocabulary plus the unknown word, whose id follows the last word's."""
    row = vocab.agg(
        F.lit(word).alias("word"),
        F.lit(0).cast("bigint").alias("n"),
        (F.coalesce(F.max("token_id"), F.lit(0)) + 1).alias("token_id"),
    )
    return vocab.select("word", "n", "token_id").unionByName(row)


def encode_tokens(df: DataFrame, id_col: str, tokens: Column, vocab: DataFrame, out: str = "token_ids") -> DataFrame:
    """Id sequence of each text; a word outside the vocabulary gets the OOV id,
    one more than the number of words.

    The texts are moved once, in bundles. A bundle asks for each of its distinct words
    once, whatever their number, and the ids come back by their place in its list, so
    neither a word of a text nor an answer carries a text's id. A vocabulary within the
    session's broadcast limit is broadcast. Rows with equal ids are one text, their words
    by position. A text without words gives an empty list, a NULL word the OOV id.
    """
    known = vocab.select("word", F.col("token_id").cast("bigint").alias("token_id"))
    size, widest = known.agg(F.count(F.lit(1)), F.max(F.octet_length("word"))).first()
    if size * HEAD_WORD_BYTES <= broadcast_limit(known) and (widest or 0) <= HEAD_WORD_BYTES - 32:
        known = F.broadcast(known)
    dealt = deal_out(df.withColumn("_key", F.xxhash64(id_col)), "_key", tokens, ENCODE_WORDS, [id_col])
    kind = df.schema[id_col].dataType.simpleString()

    def ask(texts: pa.Table) -> pa.Table:
        words = _distinct(texts)
        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.table({"_asking": texts.column("_bundle").slice(0, 1).combine_chunks(), "_asked": lists})

    def encode(texts: pa.Table, answers: pa.Table) -> pa.Table:
        places, numbers = (answers.column(c).to_numpy().astype(np.int64) for c in ("_place", "token_id"))
        ids, lists = _encoded(texts, id_col, places, numbers, size + 1)
        return pa.table([ids, lists], names=[id_col, out])

    # Both sides read one exchange of the texts.
    asked = dealt.groupBy("_bundle").applyInArrow(ask, "_asking long, _asked array<string>")
    words = asked.select("_asking", F.posexplode("_asked").alias("_place", "word"))
    answers = words.join(known, "word").select("_asking", "_place", "token_id")
    return dealt.groupBy("_bundle").cogroup(answers.groupBy("_asking")).applyInArrow(encode, f"`{id_col}` {kind}, `{out}` array<bigint>")


def _distinct(texts: pa.Table) -> pa.Array:
    """The words of a bundle in order, the same list whatever the order of its texts."""
    words = pc.unique(texts.column("_words").combine_chunks().flatten()).drop_null()
    return words.take(pc.sort_indices(words))


def _encoded(texts: pa.Table, id_col: str, places: np.ndarray, numbers: np.ndarray, oov: int) -> tuple[pa.Array, pa.Array]:
    """The distinct ids of a bundle and the numbers of their words; ``places`` are those of
    ``_distinct``. A word that stands several times in the vocabulary gives all its numbers."""
    words = _distinct(texts)
    bare = np.append(np.setdiff1d(np.arange(len(words)), places), len(words))
    places, numbers = np.append(places, bare), np.append(numbers, np.full(len(bare), oov))
    numbers = numbers[np.lexsort((numbers, places))]
    count = np.bincount(places)
    lists = texts.column("_words").combine_chunks()
    each = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    word = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), len(words)).to_numpy(zero_copy_only=False)
    ids = texts.column(id_col).combine_chunks().dictionary_encode(null_encoding="encode")
    text = np.repeat(ids.indices.to_numpy(zero_copy_only=False), each)
    position = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
    many = count[word]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = numbers[np.repeat((np.cumsum(count) - count)[word], many) + within]
    text, position = np.repeat(text, many), np.repeat(position, many)
    if len(ids.dictionary) < len(ids):
        order = np.lexsort((found, position, text))
        text, found = text[order], found[order]
    ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(ids.dictionary)))).astype(np.int32)
    return ids.dictionary, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int64)))


def longest(df: DataFrame, col: str) -> int:
    """Length of the longest sequence; one number."""
    return df.agg(F.max(F.size(col))).first()[0] or 0


def pad_sequences(df: DataFrame, col: str, maxlen: int, side: str = "pre", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, pad_sequence(F.col(col), maxlen, side))


def random_vector(word: Column, dims: int, seed: int, low: float = -0.25, high: float = 0.25) -> Column:
    """Vector drawn from the word itself, so any executor draws the same one.

    One digest gives four components.
    """
    blocks = F.sequence(F.lit(0), F.lit((dims - 1) // _HEX_GROUPS))
    digests = F.transform(blocks, lambda b: F.md5(F.concat(word, F.lit(f":{seed}:"), b.cast("string"))))

    def quad(digest: Column) -> Column:
        return F.array(*[hex_uniform(digest, group) * (high - low) + low for group in range(_HEX_GROUPS)])

    return F.slice(F.flatten(F.transform(digests, quad)), 1, dims)


def draw_vectors(words: Sequence[str], dims: int, seed: int, low: float = -0.25, high: float = 0.25) -> np.ndarray:
    """``random_vector`` of each word, to the last bit, inside a task."""
    ends = [f":{seed}:{b}".encode() for b in range((dims - 1) // _HEX_GROUPS + 1)]
    drawn = b"".join(hashlib.md5(word + end, usedforsecurity=False).digest() for word in map(str.encode, words) for end in ends)
    uniform = np.frombuffer(drawn, ">u4").reshape(len(words), len(ends) * _HEX_GROUPS)[:, :dims] / 4294967296.0
    return uniform * (high - low) + low


def embedding_table(vocab: DataFrame, vectors: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    """One vector per id: the word's own, or a random one; id 0 is zeros."""
    found = lookup_vectors(vocab.select("word", "token_id"), vectors)
    known = F.col("vector").isNotNull()
    rows = found.select(
        "token_id",
        "word",
        known.alias("in_vectors"),
        F.when(known, F.col("vector").cast("array<double>"))
        .otherwise(random_vector(F.col("word"), dims, seed))
        .alias("vector"),
    )
    padding = vocab.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("token_id"),
        F.lit(None).cast("string").alias("word"),
        F.lit(False).alias("in_vectors"),
        F.array_repeat(F.lit(0.0), dims).alias("vector"),
    )
    return rows.unionByName(padding)
