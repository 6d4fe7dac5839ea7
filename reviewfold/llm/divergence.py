"""How far the sources of a language differ in their words.

A text's bytes are lowered and its separators blanked by one ``bytes.translate``,
``bytes.split`` gives the terms and a ``Counter`` per document their
frequencies. What leaves a task is sparse: one row per language, source and
term, with occurrences and documents. All later arithmetic is on whole numbers.

A pair of sources is compared over all kept terms, most of which neither of
them holds. With ``z`` the probability of a term that a source does not hold,
the sum over all terms is ``V f(z, z)``, plus a correction for each term that
one of them holds (from a histogram of probabilities per source), plus one for
each term that both hold. So the work follows the occurring entries and not
terms times sources squared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.llm.common import stored
from reviewfold.operators.skew import skew_join

MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Entries a task holds before it sums them.
FLUSH_ENTRIES = 1_000_000
#: Longer texts are split in parts of about so many bytes, at separators.
PART_BYTES = 4 << 20
#: Entries of a term meet each other in lots of about so many.
PAIRS_AT_ONCE = 1_000_000

# A to Z are lowered, a to z and all bytes of characters beyond ASCII stay, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Frequencies of the terms of one document."""
    plain, counts, start = text.translate(_TABLE), Counter(), 0
    while start < len(plain):
        stop = plain.find(b" ", start + PART_BYTES)
        stop = len(plain) if stop < 0 else stop
        counts.update(plain[start:stop].split())
        start = stop
    return counts


def _sparse_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` in partial sums. Every document also gives
    the empty term, so that groups without terms are known."""

    def flush(groups: list[tuple[str, str]], at: list[int], terms: list[bytes], n: list[int]) -> pa.RecordBatch:
        table = pa.table({"at": pa.array(at, pa.int64()), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64())})
        sums = table.group_by(["at", "term"]).aggregate([("n", "sum"), ("n", "count")]).combine_chunks()
        where = sums.column("at").combine_chunks()
        named = [pa.array([g[k] for g in groups], pa.string()).take(where) for k in (0, 1)]
        term = sums.column("term").combine_chunks().cast(pa.string())
        columns = [*named, term, sums.column("n_sum").combine_chunks(), sums.column("n_count").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        at: list[int] = []
        terms: list[bytes] = []
        n: list[int] = []
        for batch in batches:
            for text, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = term_counts(text)
                terms.append(b"")
                n.append(0)
                terms.extend(found)
                n.extend(found.values())
                at.extend([number.setdefault(tuple(key), len(number))] * (len(found) + 1))
                if len(at) >= FLUSH_ENTRIES:
                    yield flush(list(number), at, terms, n)
                    number, at, terms, n = {}, [], [], []
        if at:
            yield flush(list(number), at, terms, n)

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _probability(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / total)``, digit by digit so that no product overflows."""
    value, rest = F.lit(1).cast("long"), count + 1
    for scale in (1_000_000, 1_000, 1):
        rest = rest * 1000
        value = value + F.call_function("div", rest, total) * scale
        rest = rest % total
    return value


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(entries: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: partial sums of what a term that both sources
    hold adds to the sum of terms that only one of them holds."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            size = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cells.flatten()
            lang = batch.column(0).dictionary_encode()
            names = flat.field("source").dictionary_encode()
            kind = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
            source = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            p, z = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("p", "z"))
            n_names = len(names.dictionary)
            partners, head = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
            pairs, start = np.cumsum(partners), 0
            while start < len(partners):
                base = pairs[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(pairs, base + PAIRS_AT_ONCE, "right")))
                each = partners[start:stop]
                left = np.repeat(np.arange(start, stop), each)
                right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each - head[start:stop], each)
                a, za, b, zb = p[left], z[left], p[right], z[right]
                value = (a - b) ** 2 // b - (a - zb) ** 2 // zb - (za - b) ** 2 // b + (za - zb) ** 2 // zb
                code, where = np.unique((kind[left] * n_names + source[left]) * n_names + source[right], return_inverse=True)
                sums = np.zeros(len(code), dtype=np.int64)
                np.add.at(sums, where, value)
                columns = [lang.dictionary.take(pa.array(code // n_names**2))]
                columns += [names.dictionary.take(pa.array(x)) for x in (code // n_names % n_names, code % n_names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names=["lang", "source", "item", "value"])
                start = stop

    return entries.mapInArrow(compare, "lang string, source string, item string, value long")


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` compares each source
    of a language with each other one over all kept terms, part ``term`` names the
    terms that a source uses more than its language, the ``top_terms`` first ones.

    A term is kept in a language if ``min_documents`` rows hold it. NULL in text,
    language or source counts as the empty text; every occurring pair of language
    and source takes part, also without any term. Repeated rows count again, ties go
    by the item's bytes, other columns are ignored, an empty table gives no rows. A
    very long text is split in parts at separators, so memory does not follow it
    beyond its bytes and its distinct terms.

    What is gathered per term is one entry per source that holds it.
    """
    named = {"body": text_col, "lang": lang_col, "source": source_col}
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in named.items()]
    base = docs.select(*plain).withColumn("body", F.encode("body", "UTF-8"))
    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    counts = _sparse_counts(base).groupBy("lang", "source", "term").agg(*sums)
    # At most one row per source: a small window, whatever the term's frequency.
    term = Window.partitionBy("lang", "term")
    spread = counts.select("*", F.sum("docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("total"))
    kept = spread.filter((F.col("term") == "") | (F.col("in_docs") >= min_documents)).drop("docs", "in_docs")
    kept = stored(kept, "term-counts")
    real = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    # One row of a term counts it for its language: the one of its first source.
    first = F.min("source").over(term) == F.col("source")
    langs = kept.filter(real).select("lang", "total", first.alias("first")).filter("first")
    langs = langs.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("size"))
    zero = F.coalesce(F.col("size"), F.lit(0)) > 0
    params = groups.join(langs, "lang", "left").select(
        "lang",
        "source",
        F.coalesce("size", F.lit(0)).alias("size"),
        F.when(zero, F.col("group_n") + F.col("size")).alias("group_all"),
        F.when(zero, F.col("lang_n") + F.col("size")).alias("lang_all"),
    )
    params = stored(params.withColumn("z", _probability(F.lit(0).cast("long"), F.col("group_all"))), "term-groups")
    width = F.octet_length("lang") + F.octet_length("source") + 64
    measured = params.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    entries = skew_join(kept.filter(real & (F.col("n") > 0)), params, ["lang", "source"], right_bytes=measured)
    entries = entries.select(
        "lang",
        "source",
        "term",
        "z",
        _probability(F.col("n"), F.col("group_all")).alias("p"),
        _probability(F.col("total"), F.col("lang_all")).alias("q"),
    )

    above = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    other = params.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"), F.col("size").alias("item_size"))
    # The result has a row for each of these pairs.
    pairs = params.join(other, "lang").filter("source <> item")
    basis = F.col("size") * _divergence(F.col("z"), F.col("item_z"))
    basis = pairs.select("lang", "source", "item", F.coalesce(basis, F.lit(0)).alias("value"))
    histogram = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    single = histogram.join(pairs, ["lang", "source"])
    p, z, item_z = F.col("p"), F.col("z"), F.col("item_z")
    as_group = single.select("lang", "source", "item", (F.col("times") * (_divergence(p, item_z) - _divergence(z, item_z))).alias("value"))
    as_item = single.select(
        "lang",
        F.col("item").alias("source"),
        F.col("source").alias("item"),
        (F.col("times") * (_divergence(item_z, p) - _divergence(item_z, z))).alias("value"),
    )
    gathered = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("entries"))
    shared = _shared_terms(gathered.select("lang", "entries")).filter("source <> item")
    parts = basis.unionByName(as_group).unionByName(as_item).unionByName(shared)
    total = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    paired = total.withColumn("rank", F.row_number().over(order))

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(paired, "pair").unionByName(part(terms, "term"))
