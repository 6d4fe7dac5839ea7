"""Logistic regression on TF-IDF with vocabulary and weights kept as tables.

The labelled texts of a fit are turned once into an inverted table: one row per
term with the texts that hold it and how often. Any number of runs, each with its
own training rows and so its own vocabulary, document frequencies and lengths, is
fitted in the same loop of passes over that table.

The weights of a linear model with an L2 penalty are a combination of the training
rows, ``w = X' a``, so the optimizer's state is one number per text and run, and
never one per term. A pass sends these numbers to the tasks; each one adds up, for
its terms, what the texts give to a term and what the term gives back to every
text: ``X X' a``. The partial sums are added in slices of rows by Spark. All inner
products that L-BFGS needs follow from such vectors, and so does an exact line
search. Which rows train a run is a bit per row and run that the pass reads, so a
run costs no job of its own, and the margins of its test rows come with the pass.

Every labelled text is used. What the driver holds is about twenty numbers for each
of them and run of one lot; the optimizer's past lies in a scratch file. The number of
terms is not bounded by anything.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewfold.functions.labels import CLASS_NAME, case_map
from reviewfold.functions.text import drop_words, to_class, word_tokens
from reviewfold.operators.aggregates import run_summary
from reviewfold.operators.bundles import TermBundle, deal_out, meet_terms, packed, unpacked
from reviewfold.operators.layout import spread
from reviewfold.operators.ordering import with_row_index
from reviewfold.operators.split import Border, holdout_borders, holdout_key
from reviewfold.operators.terms import DEFAULT_MAX_DF, DEFAULT_MIN_DF, GROUP_BYTES, HELD_TERMS, PART_WORDS, postings, word_slices
from reviewfold.storage import materialize, new_path

#: Numbers of one state vector: texts times the runs that are fitted together.
LOT_NUMBERS = 1 << 20
#: Entries of a block of terms and runs a task works on at once: enough that the calls themselves cost little.
BLOCK_ENTRIES, RUNS_AT_ONCE = 1 << 16, 64
#: Stretches up to this size are added up entry by entry, for all of them at once.
SHORT = 16
#: Rows whose partial sums are added in one place.
SLICE_NUMBERS = 1 << 17
#: Words of a bundle of texts that is scored in one place.
BUNDLE_WORDS = 500_000
HISTORY = 10
#: Bytes of the optimizer's past that stay in memory, enough for a lot of runs; a larger one lies in a file.
PAST_BYTES = 4 * HISTORY * 8 * LOT_NUMBERS
#: Norm of the gradient at which a fit ends: of a model, and of runs that only give metrics.
TOLERANCE, RUN_TOLERANCE = 1e-9, 1e-6

RUN_SCHEMA = "run int, n bigint, accuracy double, precision double, recall double, f1 double"
_MODEL_SCHEMA = "intercept double, n_texts bigint, stop_words array<string>, low int, high int"


def bounded_rows(df: DataFrame, id_col: str, max_rows: int | None) -> DataFrame:
    """About ``max_rows`` rows chosen by a hash of the id; all of them if there are fewer.
    No fit of this module calls it."""
    share = 1.0 if max_rows is None else max_rows / max(1, df.count())
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))


@dataclass(frozen=True)
class Inverted:
    """The labelled texts by term, and their labels in the order of their numbers."""

    terms: DataFrame
    rows: DataFrame
    labels: np.ndarray

    @classmethod
    def of(
        cls, df: DataFrame, id_col: str, text: str, label: str, stop_words: Iterable[str], low: int, high: int, min_df: int
    ) -> Inverted:
        """``id_col`` identifies a row; a row without a label is left out. A term in fewer
        than ``min_df`` texts is kept by no run."""
        known = df.filter(F.col(label).isNotNull()).select(id_col, text, F.col(label).cast("double").alias("_label"))
        rows = with_row_index(known, [F.col(id_col)], out="_row")
        # Every pass reads the table again: a part for each core, however small it is.
        conf = df.sparkSession._jsparkSession.sessionState().conf()
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, conf.numShufflePartitions())
        n_bytes = known.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        groups = max(parts, -(-n_bytes // GROUP_BYTES))
        words = drop_words(word_tokens(F.col(text)), stop_words)
        single = spread(rows.select("_row", text)).select(F.col("_row").cast("int").alias("row"), words.alias("words"))
        sent = single.mapInArrow(_posted(low, high, groups), _SENT_SCHEMA).repartition(min(groups, parts), "group")
        lists = sent.groupBy("group").applyInArrow(_listed(min_df), _BLOCK_SCHEMA)
        labels = rows.select("_row", "_label").orderBy("_row").toArrow().column("_label").to_numpy()
        # A task of a pass gives a sum for every row, so there are no more tasks than cores, however many parts.
        return cls(materialize(lists).coalesce(cores), rows.select(id_col, "_row"), labels)


_SENT_SCHEMA = "group long, terms binary, postings binary"
_BLOCK_SCHEMA = "terms array<string>, sizes binary, rows binary, tfs binary, by_row binary"


def _posted(low: int, high: int, groups: int) -> Callable:
    """Numbered lists of words to the distinct terms of many texts with their texts, in
    compressed lists for groups of terms: a term is sent once for all of these texts."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            first, numbers = 0, batch.column("row").to_numpy()
            for lists in word_slices(batch.column("words"), PART_WORDS):
                rows = numbers[first : first + len(lists)]
                first += len(lists)
                for terms, group, df, at, tf in postings(lists, low, high, groups):
                    held.append((terms, group, df, rows[at], tf))
                    size += len(at)
                if size >= HELD_TERMS:
                    yield from _grouped(held)
                    held, size = [], 0
        if size:
            yield from _grouped(held)

    return post


def _grouped(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A row for each group with its terms and their postings, in the order of the terms."""
    terms, (group, df, rows, tfs) = pa.concat_arrays([h[0] for h in held]), (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
    order = np.lexsort((pc.rank(terms).to_numpy(), group))
    starts, df = (np.cumsum(df) - df)[order], df[order]
    ends = np.cumsum(df)
    entry = np.arange(len(rows)) + np.repeat(starts - (ends - df), df)
    terms, group, rows, tfs = terms.take(pa.array(order)), group[order], rows[entry], tfs[entry]
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(firsts, np.append(firsts, len(group))[1:], strict=True):
        p, q = ends[a] - df[a], ends[b - 1]
        names = pa.table([terms.slice(a, b - a), pa.array(df[a:b], pa.int32())], names=["term", "df"])
        posted = pa.table([pa.array(rows[p:q], pa.int32()), pa.array(tfs[p:q], pa.int32())], names=["row", "tf"])
        blobs = [pa.array([packed(t)], pa.binary()) for t in (names, posted)]
        yield pa.RecordBatch.from_arrays([pa.array([group[a]], pa.int64()), *blobs], names=["group", "terms", "postings"])


def _listed(min_df: int) -> Callable:
    """The lists of a group to blocks, by the order of the terms and texts."""

    def merge(sent: pa.Table) -> pa.Table:
        names = pa.concat_tables([unpacked(b) for b in sent.column("terms")]).combine_chunks()
        posted = pa.concat_tables([unpacked(b) for b in sent.column("postings")]).combine_chunks()
        coded = names.column("term").combine_chunks().dictionary_encode()
        rank = pc.rank(coded.dictionary).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
        term = np.repeat(rank, names.column("df").to_numpy())
        order = np.lexsort((posted.column("row").to_numpy(), term))
        # A stretch of equal numbers is a term; what stands in too few texts goes before its name is written out.
        sizes = np.bincount(term)
        order = order[sizes[term[order]] >= min_df]
        sorted_terms = coded.dictionary.take(pc.sort_indices(coded.dictionary))
        table = posted.take(pa.array(order)).add_column(0, "term", sorted_terms.take(pa.array(term[order] - 1)))
        blocks = list(_packed(min_df)(iter(table.combine_chunks().to_batches())))
        empty = {"terms": pa.list_(pa.string())} | dict.fromkeys(("sizes", "rows", "tfs", "by_row"), pa.binary())
        return pa.Table.from_batches(blocks) if blocks else pa.schema(empty).empty_table()

    return merge


def _packed(min_df: int) -> Callable:
    """Sorted entries to blocks: the terms in at least ``min_df`` texts with their texts, and
    the order of the entries by text. Every pass reads the blocks as they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = _starts(table.column("term"))
            # The last term may go on in the next batch.
            yield from _blocks_of(table.slice(0, starts[-1]), starts[:-1], min_df)
            rest = table.slice(starts[-1])
        if rest is not None:
            yield from _blocks_of(rest, np.zeros(1, np.int64), min_df)

    return pack


def _starts(terms: pa.ChunkedArray) -> np.ndarray:
    """Places at which another term begins."""
    flat = terms.combine_chunks()
    changes = pc.not_equal(flat.slice(1), flat.slice(0, len(flat) - 1)).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(changes) + 1)


def _blocks_of(table: pa.Table, starts: np.ndarray, min_df: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(starts, append=table.num_rows)
    kept = np.flatnonzero(sizes >= min_df)
    if not len(kept):
        return
    held = np.repeat(sizes >= min_df, sizes)
    rows, tfs = (table.column(c).to_numpy()[held].astype(np.int32) for c in ("row", "tf"))
    terms, sizes = table.column("term").combine_chunks().take(pa.array(starts[kept])), sizes[kept]
    ends, first = np.cumsum(sizes), 0
    while first < len(kept):
        base = ends[first] - sizes[first]
        stop = max(first + 1, int(np.searchsorted(ends, base + BLOCK_ENTRIES, "right")))
        size = sizes[first:stop]
        # Terms by how many texts hold them, and texts by how many terms they hold: equal stretches are added up together.
        by_size = np.argsort(size, kind="stable")
        entry = np.argsort(np.repeat(np.argsort(by_size), size), kind="stable")
        row, tf = rows[base : ends[stop - 1]][entry], tfs[base : ends[stop - 1]][entry]
        _, inverse, held_terms = np.unique(row, return_inverse=True, return_counts=True)
        order = np.lexsort((row, held_terms[inverse])).astype(np.int32)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (size[by_size].astype(np.int32), row, tf, order)]
        names = pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), terms.slice(first, stop - first).take(pa.array(by_size)))
        yield pa.RecordBatch.from_arrays([names, *blobs], names=["terms", "sizes", "rows", "tfs", "by_row"])
        first = stop


class _Terms:
    """A block of the inverted table as numbers."""

    def __init__(self, sizes: bytes, rows: bytes, tfs: bytes, by_row: bytes):
        self.size, self.rows, self.tf, order = (np.frombuffer(x, np.int32) for x in (sizes, rows, tfs, by_row))
        ordered = self.rows[order]
        self.term_by_row, self.tf_by_row = np.repeat(np.arange(len(self.size)), self.size)[order], self.tf[order]
        row_starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.row_size = np.diff(row_starts, append=len(ordered))
        self.touched = ordered[row_starts]
        # Most terms stand once in a text; only the others are multiplied.
        self.many, self.many_by_row = np.flatnonzero(self.tf != 1), np.flatnonzero(self.tf_by_row != 1)

    def to_terms(self, per_row: np.ndarray) -> np.ndarray:
        given = per_row.take(self.rows, axis=0)
        given[self.many] *= self.tf[self.many, None]
        return _stretches(given, self.size)

    def texts_of(self, member: np.ndarray) -> np.ndarray:
        """In how many of the rows told by ``member`` each term stands, for each run."""
        return _stretches(member.take(self.rows, axis=0), self.size, np.int32)

    def to_rows(self, per_term: np.ndarray, out: np.ndarray, power: int = 1) -> None:
        given = per_term.take(self.term_by_row, axis=0)
        given[self.many_by_row] *= (self.tf_by_row[self.many_by_row].astype(float) ** power)[:, None]
        out[self.touched] += _stretches(given, self.row_size)


def _stretches(values: np.ndarray, sizes: np.ndarray, dtype: type = float) -> np.ndarray:
    """Sums of stretches of rows whose sizes rise; those of one size are added up at once."""
    width = values.shape[1]
    if width == 1:
        return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0, dtype=dtype)
    out, at, first = np.empty((len(sizes), width), dtype), 0, 0
    for size, n in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True):
        part, to = values[at : at + size * n].reshape(n, size, width), out[first : first + n]
        if size <= SHORT:
            to[:] = part[:, 0]
            for k in range(1, size):
                to += part[:, k]
        else:
            part.sum(axis=1, dtype=dtype, out=to)
        at, first = at + size * n, first + n
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[_Terms]:
    columns = [batch.column(c) for c in ("sizes", "rows", "tfs", "by_row")]
    for i in range(batch.num_rows):
        yield _Terms(*(c[i].as_buffer() for c in columns))


@dataclass(frozen=True)
class _Idf:
    """Inverse document frequencies of each run over its training rows."""

    member: np.ndarray
    table: np.ndarray

    def of(self, terms: _Terms) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed ``ln((1 + n) / (1 + df)) + 1`` of each term and run, 0 where it is
        not kept, and the document frequency."""
        df = terms.texts_of(self.member)
        return self.table[df, np.arange(df.shape[1])] if self.table.shape[1] > 1 else self.table[:, 0].take(df), df

    def runs(self, part: slice | np.ndarray) -> _Idf:
        return _Idf(np.ascontiguousarray(self.member[:, part]), self.table[:, part] if self.table.shape[1] > 1 else self.table)

    @classmethod
    def over(cls, member: np.ndarray, n_texts: np.ndarray, min_df: int, max_df: float) -> _Idf:
        """The values for every possible frequency; one column if all runs have as many texts."""
        sizes = n_texts[:1] if (n_texts == n_texts[0]).all() else n_texts
        df = np.arange(n_texts.max() + 1)[:, None]
        kept = (df >= min_df) & (df <= float(max_df) * sizes)
        return cls(np.ascontiguousarray(member.astype(np.int8)), np.where(kept, np.log((1.0 + sizes) / (1.0 + df)) + 1.0, 0.0))


def _sum_by_row(terms: DataFrame, shape: tuple[int, int], add: Callable, shared: tuple) -> np.ndarray:
    """Sum over all terms of what ``add(block, *shared, out)`` gives to the rows.

    A task adds up its terms; the sums are cut in slices of rows, which Spark adds
    in one group each; only the total comes back.
    """
    context = terms.sparkSession.sparkContext
    sent = context.broadcast(shared)
    n, width = shape
    step = max(1, SLICE_NUMBERS // width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are worked on in parts that lie together.
        parts = [slice(first, first + RUNS_AT_ONCE) for first in range(0, width, RUNS_AT_ONCE)]
        given = [[x.runs(p) if isinstance(x, _Idf) else np.ascontiguousarray(x[:, p]) for x in sent.value] for p in parts]
        sums = None
        for batch in batches:
            for block in _blocks(batch):
                sums = sums or [np.zeros((n, len(range(width)[p]))) for p in parts]
                for shared_part, out in zip(given, sums, strict=True):
                    add(block, *shared_part, out)
        if sums:
            out = np.concatenate(sums, axis=1)
            starts = list(range(0, n, step))
            blobs = [out[s : s + step].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(blobs, pa.binary())], names=["start", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(blob) for blob in table.column("sums").to_pylist())
        return pa.table({"start": table.column("start").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "start long, sums binary"
    parts = terms.drop("terms").mapInArrow(partial, schema).groupBy("start").applyInArrow(total, schema).toArrow()
    sent.destroy()
    out = np.zeros(shape)
    for start, blob in zip(parts.column("start").to_pylist(), parts.column("sums").to_pylist(), strict=True):
        out[start : start + step] = np.frombuffer(blob).reshape(-1, width)
    return out


def _add_squares(block: _Terms, idf: _Idf, out: np.ndarray) -> None:
    block.to_rows(idf.of(block)[0] ** 2, out, power=2)


def _add_product(block: _Terms, idf: _Idf, scaled: np.ndarray, out: np.ndarray) -> None:
    block.to_rows(block.to_terms(scaled) * idf.of(block)[0] ** 2, out)


@dataclass(frozen=True)
class Fitted:
    """State of a lot of fitted runs: a column per run, a row per labelled text."""

    alpha: np.ndarray
    margins: np.ndarray
    lengths: np.ndarray
    idf: _Idf
    gradient: np.ndarray
    passes: int


def fit_runs(
    table: Inverted,
    member: np.ndarray,
    C: float = 2.5,
    min_df: int = DEFAULT_MIN_DF,
    max_df: float = DEFAULT_MAX_DF,
    max_iter: int = 200,
    tolerance: float = TOLERANCE,
) -> Fitted:
    """L2 logistic regressions of all runs at once; ``member`` tells for each text and
    run whether it trains it.

    Each run minimizes its mean loss plus ``1 / (2 C n)`` times the squared norm, the
    intercept being the weight of a constant feature. L-BFGS goes on until the norm
    of every run's gradient is at most ``tolerance``; its steps are exact minima
    along the direction.
    """
    n_texts = member.sum(axis=0).astype(np.int64)
    if not member.size or not n_texts.all():
        raise ValueError("a run without a training row")
    idf = _Idf.over(member, n_texts, min_df, max_df)
    shape, held = member.shape, member.astype(bool)
    lengths = np.sqrt(_sum_by_row(table.terms, shape, _add_squares, (idf,)))
    inverse = np.divide(1.0, lengths, out=np.zeros(shape), where=lengths > 0)
    sign = np.where(table.labels > 0.5, 1.0, -1.0)[:, None]
    penalty = 1.0 / (C * n_texts)

    def product(vector: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """``X X' vector`` of some runs, the constant feature included."""
        vector, inverse_of = vector[:, runs], inverse[:, runs]
        return _sum_by_row(table.terms, vector.shape, _add_product, (idf.runs(runs), vector * inverse_of)) * inverse_of + vector.sum(axis=0)

    def slope(margins: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """The gradient as a combination of the rows."""
        rest = 1.0 / (1.0 + np.exp(np.clip(sign * margins, -700, 700)))
        return np.where(held, -sign * rest, 0.0) / n_texts + penalty * alpha

    dot = lambda x, y: np.einsum("nr,nr->r", x, y)
    alpha, margins = np.zeros(shape), np.zeros(shape)
    g = slope(margins, alpha)
    kg = product(g, np.arange(shape[1]))
    passes, past = 1, _Past(shape)
    norm = np.sqrt(np.maximum(dot(g, kg), 0.0))
    while norm.max() > tolerance and passes < max_iter:
        d, kd = _direction(g, kg, past, dot)
        step = _line_search(margins, kd, dot(alpha, margins), dot(alpha, kd), dot(d, kd), sign, held, n_texts, penalty)
        step = np.where(norm > tolerance, step, 0.0)
        alpha, margins = alpha + step * d, margins + step * kd
        after = slope(margins, alpha)
        # A run that has arrived takes no step, so its product is known.
        k_after, moved = kg.copy(), np.flatnonzero(norm > tolerance)
        k_after[:, moved] = product(after, moved)
        past.add(step * d, step * kd, after - g, k_after - kg)
        g, kg, passes = after, k_after, passes + 1
        norm = np.sqrt(np.maximum(dot(g, kg), 0.0))
    return Fitted(alpha, margins, lengths, idf, norm, passes)


class _Past:
    """The last ``HISTORY`` steps ``s`` and gradient changes ``y`` with their products ``ks``
    and ``ky``, oldest first. What would take more than ``PAST_BYTES`` lies in a scratch file
    of the driver and is read in stretches of rows."""

    def __init__(self, shape: tuple[int, int]):
        self._n, self._width = shape
        self._file = tempfile.TemporaryFile(prefix="reviewfold-") if 4 * HISTORY * 8 * self._n * self._width > PAST_BYTES else None
        self._held: list[tuple] = []
        self._added = 0

    def __len__(self) -> int:
        return min(self._added, HISTORY)

    def add(self, *vectors: np.ndarray) -> None:
        if self._file is None:
            self._held = [*self._held[1 - HISTORY :], vectors]
        else:
            self._file.seek(self._added % HISTORY * 32 * self._n * self._width)
            for vector in vectors:
                self._file.write(np.ascontiguousarray(vector, dtype=float).tobytes())
        self._added += 1

    def parts(self, i: int, *which: int) -> Iterator[tuple]:
        """Stretches of rows with those of the vectors ``which`` of the ``i``-th entry."""
        if self._file is None:
            yield slice(None), *(self._held[i][k] for k in which)
            return
        slot = (self._added - len(self) + i) % HISTORY
        step = max(1, SLICE_NUMBERS // self._width)
        for first in range(0, self._n, step):
            rows = min(step, self._n - first)
            found = []
            for k in which:
                self._file.seek(8 * self._width * ((slot * 4 + k) * self._n + first))
                found.append(np.frombuffer(self._file.read(8 * self._width * rows)).reshape(rows, self._width))
            yield slice(first, first + rows), *found


def _direction(g: np.ndarray, kg: np.ndarray, past: _Past, dot: Callable) -> tuple[np.ndarray, np.ndarray]:
    """L-BFGS direction and its product, from the steps ``s`` and gradient changes ``y``
    with their products; inner products are those of the weights."""
    q, kq, used = g.copy(), kg.copy(), []
    sy = yy = 0.0
    for i in reversed(range(len(past))):
        sy_i, q_ks, yy_i = (sum(x) for x in zip(*((dot(s, ky), dot(q[part], ks), dot(y, ky)) for part, s, ks, y, ky in past.parts(i, 0, 1, 2, 3)), strict=True))
        if not used:
            sy, yy = sy_i, yy_i
        rho = np.divide(1.0, sy_i, out=np.zeros_like(sy_i), where=sy_i > 0)
        a = rho * q_ks
        for part, y, ky in past.parts(i, 2, 3):
            q[part] -= a * y
            kq[part] -= a * ky
        used.append((a, rho))
    if used:
        scale = np.where((yy > 0) & (sy > 0), np.divide(sy, yy, out=np.ones_like(sy), where=yy > 0), 1.0)
        q *= scale
        kq *= scale
    for i, (a, rho) in enumerate(reversed(used)):
        b = rho * sum(dot(ky, q[part]) for part, ky in past.parts(i, 3))
        for part, s, ks in past.parts(i, 0, 1):
            q[part] += (a - b) * s
            kq[part] += (a - b) * ks
    return -q, -kq


def _line_search(margins, change, a_m, a_change, d_change, sign, held, n_texts, penalty) -> np.ndarray:
    """Minimum of each run's loss along its direction: Newton steps kept inside the
    interval in which the slope changes its sign."""
    low, high = np.zeros(margins.shape[1]), np.full(margins.shape[1], np.inf)
    t = np.ones(margins.shape[1])
    for _ in range(40):
        rest = np.where(held, 1.0 / (1.0 + np.exp(np.clip(sign * (margins + t * change), -700, 700))), 0.0)
        first = -(sign * rest * change).sum(axis=0) / n_texts + penalty * (a_change + t * d_change)
        second = (rest * (1 - rest) * change**2).sum(axis=0) / n_texts + penalty * d_change
        low, high = np.where(first < 0, t, low), np.where(first >= 0, t, high)
        move = np.divide(first, second, out=np.zeros_like(first), where=second > 0)
        guess = t - move
        inside = (guess > low) & (guess < high)
        nearer = np.where(np.isfinite(high), (low + np.where(np.isfinite(high), high, 0.0)) / 2, 2 * t)
        # A step below the last digit has arrived; halving the interval would leave the minimum again.
        after = np.where(inside | (guess == t), guess, nearer)
        if np.all(np.abs(after - t) <= 1e-10 * np.abs(t)):
            return after
        t = after
    return t


@dataclass(frozen=True)
class TermLogistic:
    """A fitted model: ``weights`` holds ``(term, df, idf, weight)``, a row per kept term."""

    weights: DataFrame
    intercept: float
    n_texts: int
    stop_words: tuple[str, ...] = ()
    low: int = 1
    high: int = 3

    def _met(self, df: DataFrame, id_col: str, text: str, keep: Sequence[str], work: Callable, schema: str) -> DataFrame:
        """``work(texts, bundle, tf * idf, length)`` of every bundle of texts beside the kept terms
        it holds. The texts are split and moved once, and a term once for each bundle."""

        low, high = self.low, self.high

        def each(texts: pa.Table, rows: pa.Table) -> pa.Table:
            bundle = TermBundle(texts, rows, id_col, low, high)
            given = bundle.tf * bundle.numbers("idf")
            return work(texts, bundle, given, np.sqrt(bundle.by_text(given * given)))

        words = drop_words(word_tokens(F.col(text)), self.stop_words)
        n_bytes = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        dealt = deal_out(df, id_col, words, BUNDLE_WORDS, keep, joined=True)
        return meet_terms(dealt, id_col, n_bytes, low, high, self.weights.select("term", "idf", "weight"), each, schema)

    def score(self, df: DataFrame, id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
        """Id, ``keep``, ``prob``, ``class`` and ``predicted`` of every row. ``id_col``
        identifies a row. A text without a kept term has the intercept's probability."""
        kept = [id_col, *[c for c in keep if c != id_col]]

        def margins(texts: pa.Table, bundle: TermBundle, given: np.ndarray, length: np.ndarray) -> pa.Table:
            return texts.select(kept).append_column("_margin", pa.array(_margins(bundle, given, length)[bundle.text]))

        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", _margin double"
        rows = self._met(df, id_col, text, kept[1:], margins, schema)
        scored = rows.withColumn("prob", 1.0 / (1.0 + F.exp(-(F.col("_margin") + self.intercept)))).drop("_margin")
        scored = scored.withColumn("class", to_class(F.col("prob")))
        return scored.withColumn("predicted", case_map(F.col("class"), CLASS_NAME))

    def attribution(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """``(id, term, attribution)``: absolute gradient of a text's probability with
        respect to each kept term it holds, for every row."""

        intercept = self.intercept

        def slopes(_: pa.Table, bundle: TermBundle, given: np.ndarray, length: np.ndarray) -> pa.Table:
            prob = _probabilities(bundle, given, length, intercept)
            slope = (prob * (1 - prob))[bundle.post_text] * np.abs(bundle.numbers("idf") * bundle.numbers("weight"))
            times = np.bincount(bundle.text, minlength=len(bundle.ids))[bundle.post_text]
            columns = [bundle.ids.take(pa.array(bundle.post_text.repeat(times))), bundle.terms.take(pa.array(bundle.post_term.repeat(times)))]
            return pa.table([*columns, pa.array(slope.repeat(times))], names=[id_col, "term", "attribution"])

        kind = df.schema[id_col].dataType.simpleString()
        return self._met(df, id_col, text, (), slopes, f"`{id_col}` {kind}, term string, attribution double")

    def gradient(self, df: DataFrame, id_col: str, text: str, label: str, C: float) -> DataFrame:
        """``(term, gradient)`` of the stated loss at these weights, from the texts and the
        table of weights alone; the intercept's row has a NULL term. All are 0 at the minimum."""

        intercept = self.intercept

        def sums(texts: pa.Table, bundle: TermBundle, given: np.ndarray, length: np.ndarray) -> pa.Table:
            """What a bundle adds to each term, and to the constant feature."""
            wrong = _probabilities(bundle, given, length, intercept)[bundle.text] - texts.column(label).to_numpy().astype(float)
            per_text = np.bincount(bundle.text, wrong, len(bundle.ids))
            values = given / length[bundle.post_text] * per_text[bundle.post_text]
            per_term = np.bincount(bundle.post_term, values, len(bundle.terms))
            return pa.table([pa.concat_arrays([bundle.terms, pa.nulls(1, bundle.terms.type)]), pa.array(np.append(per_term, wrong.sum()))], names=["term", "part"])

        parts = self._met(df.filter(F.col(label).isNotNull()), id_col, text, [label], sums, "term string, part double")
        total = parts.groupBy(F.col("term").alias("_term")).agg(F.sum("part").alias("_sum"))
        constant = self.weights.sparkSession.createDataFrame([(None, self.intercept)], "term string, weight double")
        every = self.weights.select("term", "weight").unionByName(constant)
        slope = F.coalesce("_sum", F.lit(0.0)) / self.n_texts + F.col("weight") * (1.0 / (C * self.n_texts))
        return every.join(total, F.col("term").eqNullSafe(F.col("_term")), "left").select("term", slope.alias("gradient"))

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        row = [(self.intercept, self.n_texts, list(self.stop_words), self.low, self.high)]
        SparkSession.active().createDataFrame(row, _MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> TermLogistic:
        spark = SparkSession.active()
        row = spark.read.schema(_MODEL_SCHEMA).parquet(f"{path}/model").first()
        weights = spark.read.schema("term string, df bigint, idf double, weight double").parquet(f"{path}/weights")
        return cls(weights, row.intercept, row.n_texts, tuple(row.stop_words), row.low, row.high)


def _margins(bundle: TermBundle, given: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the terms of each text give, without the intercept."""
    dot = bundle.by_text(given * bundle.numbers("weight"))
    return np.divide(dot, length, out=np.zeros_like(length), where=length > 0)


def _probabilities(bundle: TermBundle, given: np.ndarray, length: np.ndarray, intercept: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-_margins(bundle, given, length) - intercept))


def fit_term_logistic(
    train: DataFrame,
    id_col: str,
    text: str,
    label: str = "label",
    C: float = 2.5,
    stop_words: Iterable[str] = (),
    min_df: int = DEFAULT_MIN_DF,
    max_df: float = DEFAULT_MAX_DF,
    low: int = 1,
    high: int = 3,
    max_iter: int = 200,
) -> TermLogistic:
    """L2 logistic regression on TF-IDF of n-grams; see ``fit_runs`` for the loss.

    Every labelled text is used. Neither terms nor weights reach the driver.
    """
    stop = tuple(stop_words)
    table = Inverted.of(train, id_col, text, label, stop, low, high, min_df)
    if not len(table.labels):
        raise ValueError("no labelled text to fit on")
    fitted = fit_runs(table, np.ones((len(table.labels), 1)), C, min_df, max_df, max_iter)
    if not fitted.lengths.any():
        raise ValueError("no term is left after pruning; nothing to fit on")
    scaled = np.divide(fitted.alpha, fitted.lengths, out=np.zeros_like(fitted.alpha), where=fitted.lengths > 0)
    shared = table.terms.sparkSession.sparkContext.broadcast((fitted.idf, scaled))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_blocks(batch)):
                idf, df = shared.value[0].of(block)
                weight = block.to_terms(shared.value[1]) * idf
                kept = np.flatnonzero(idf[:, 0] > 0)
                columns = [batch.column("terms")[i].values.take(pa.array(kept))]
                columns += [pa.array(x[kept, 0]) for x in (df.astype(np.int64), idf, weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "idf", "weight"])

    path = new_path(train.sparkSession, "weights")
    weights = table.terms.mapInArrow(weigh, "term string, df long, idf double, weight double")
    weights.write.parquet(path)
    stored = train.sparkSession.read.schema(weights.schema).parquet(path)
    return TermLogistic(stored, float(fitted.alpha.sum()), len(table.labels), stop, low, high)


def holdout_runs(
    df: DataFrame,
    id_col: str,
    text: str,
    runs: int,
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 22,
    C: float = 2.5,
    stop_words: Iterable[str] = (),
    min_df: int = DEFAULT_MIN_DF,
    max_df: float = DEFAULT_MAX_DF,
    low: int = 1,
    high: int = 3,
    max_iter: int = 200,
    tolerance: float = RUN_TOLERANCE,
) -> DataFrame:
    """Metrics of ``runs`` random holdouts, one row per run, all fitted in one loop of
    passes (in lots, if texts times runs exceed ``LOT_NUMBERS``).

    Run ``r`` splits by ``seed + r`` as ``holdout_split`` does, and is fitted on its
    training rows as ``fit_term_logistic`` fits them. Without rows it is empty.
    """
    spark = df.sparkSession
    known = df.filter(F.col(label).isNotNull())
    borders = holdout_borders(known, id_col, test_size, [seed + r for r in range(runs)])
    if not borders:
        return spark.createDataFrame([], RUN_SCHEMA)
    table = Inverted.of(known, id_col, text, label, tuple(stop_words), low, high, min_df)
    lot = max(1, LOT_NUMBERS // len(table.labels))
    rows = []
    for first in range(0, runs, lot):
        is_test = _test_bits(table, id_col, borders[first : first + lot])
        fitted = fit_runs(table, ~is_test, C, min_df, max_df, max_iter, tolerance)
        rows += _metrics(first, fitted.margins, table.labels, is_test)
    return spark.createDataFrame(rows, RUN_SCHEMA)


def _test_bits(table: Inverted, id_col: str, borders: Sequence[Border]) -> np.ndarray:
    """Whether each text is in each run's test set, by the hash of its id."""
    kind = table.rows.schema[id_col].dataType
    given = [F.struct(F.lit(r).alias("run"), F.lit(str(b.seed)).alias("seed"), F.lit(b.key).alias("key"), F.lit(b.id).cast(kind).alias("id")) for r, b in enumerate(borders)]
    each = table.rows.select("_row", id_col, F.explode(F.array(*given)).alias("_border"))
    key = holdout_key(id_col, F.col("_border.seed"))
    inside = (key < F.col("_border.key")) | ((key == F.col("_border.key")) & (F.col(id_col) <= F.col("_border.id")))
    found = each.filter(inside).select("_row", "_border.run").toArrow()
    out = np.zeros((len(table.labels), len(borders)), dtype=bool)
    out[found.column("_row").to_numpy(), found.column("run").to_numpy()] = True
    return out


def _metrics(first: int, margins: np.ndarray, labels: np.ndarray, is_test: np.ndarray) -> list[tuple]:
    """Accuracy, precision, recall and F1 of each run on its test rows."""
    truth, guess = (labels > 0.5)[:, None] & is_test, (margins > 0) & is_test
    hit, guessed, true, n = ((x.sum(axis=0)).astype(float) for x in (truth & guess, guess, truth, is_test))
    right = n - (truth ^ guess).sum(axis=0)
    out = []
    for r in range(margins.shape[1]):
        precision = hit[r] / guessed[r] if guessed[r] else 0.0
        recall = hit[r] / true[r] if true[r] else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else None
        out.append((first + r, int(n[r]), float(right[r] / n[r]), float(precision), float(recall), None if f1 is None else float(f1)))
    return out


def summarize_runs(runs: DataFrame, metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    """Mean, spread and interval of each metric over the runs."""
    return run_summary(runs, metrics)


def certified_distance(gradient_norm: float, C: float, n_texts: int) -> float:
    """Farthest the weights can be from the minimum: the loss is strongly convex."""
    return gradient_norm * C * n_texts if math.isfinite(gradient_norm) else math.inf
