"""Exact top-k search by the threshold algorithm (Fagin, Lotem and Naor, 2001).

Every block of candidates has a list for each dimension, sorted by its value.
A query walks the lists of its dimensions together, downwards where its own
component is positive and upwards where it is negative, and scores in full each
vector it meets. No vector that was not met can score more than the sum of the
query's components times the values at the depth reached; once the kth score is
above that bound, the search of the block ends. Blocks of queries meet blocks of
candidates in equal keys, and the best of all blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 2048
# Depths at which the bound is looked at, as factors of the one before.
_FIRST_DEPTH, _DEEPER = 8, 4
_EXACT = float(1 << 53)
_INT64 = np.iinfo(np.int64)


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def is_usable(vector: str) -> Column:
    """False for a NULL vector and for one with a NULL or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(F.col(vector), bad), F.lit(False))


class SortedLists:
    """A block of vectors with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # Ties go to the smaller id, so the block is kept in the order of ids.
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)

    def _numbers(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and queries as doubles if every sum is exact so, else as integers without a limit."""
        most = float(np.abs(self.vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0))
        kind = float if most * max(1, queries.shape[1]) < _EXACT else object
        return self.vectors.astype(kind), queries.astype(kind)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best, the query's own id left out."""
        n = len(self.ids)
        vectors, asked = self._numbers(queries)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in query_ids]
        seen = np.zeros((len(query_ids), n), dtype=bool)
        for row, own in enumerate(query_ids):
            a, b = np.searchsorted(self.ids, [own, own + 1])
            seen[row, a:b] = True
        active = np.arange(len(query_ids))
        before, depth = 0, _FIRST_DEPTH
        while len(active) and depth < n:
            top = np.where(asked > 0, asked, 0)[active] @ self.sorted[n - depth].astype(asked.dtype)
            low = np.where(asked < 0, asked, 0)[active] @ self.sorted[depth - 1].astype(asked.dtype)
            bound, going, dense = top + low, [], []
            for row, limit in zip(active, bound, strict=True):
                up, down = queries[row] < 0, queries[row] > 0
                met = np.concatenate(
                    [self.order[before:depth, up].ravel(), self.order[n - depth : n - before, down].ravel()]
                )
                fresh = np.unique(met[~seen[row, met]])
                seen[row, fresh] = True
                best[row] = self._merge(best[row], fresh, vectors[fresh] @ asked[row], k)
                if len(best[row][1]) < k or best[row][1][-1] <= limit:
                    (dense if 2 * seen[row].sum() > n else going).append(row)
            self._finish(dense, best, seen, vectors, asked, k)
            active = np.array(going, dtype=int)
            before, depth = depth, depth * _DEEPER
        self._finish(list(active), best, seen, vectors, asked, k)
        return [(self.ids[at], score) for at, score in best]

    def _finish(self, rows: list[int], best: list, seen: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int):
        """Walk the rest of the lists at once: most vectors were met already."""
        for part in [rows[a : a + 64] for a in range(0, len(rows), 64)]:
            scores = vectors @ asked[part].T
            for column, row in enumerate(part):
                rest = np.flatnonzero(~seen[row])
                best[row] = self._merge(best[row], rest, scores[rest, column], k)

    def _merge(self, best: tuple, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > 4 * k and score.dtype != object:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= cut], score[score >= cut]
        at, score = np.concatenate([best[0], at]).astype(np.int64), np.concatenate([best[1], score])
        # Places are in the order of ids.
        order = sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k]
        return at[order], score[order]


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one for each id: of several rows the smallest vector."""
    ids = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks()
    vectors = flat.flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], vectors[first]


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best inner products.

    Queries are the rows for which ``is_query`` (over ``id``) holds; their
    candidates are all rows but those with their own id, of the same length.
    Equal scores go to the smaller id. Rows with a NULL id, a NULL or empty
    vector, or a NULL or non-finite component take no part; of several rows with
    one id the smallest vector does. Scores beyond 64 bits are cut to the
    nearest 64-bit value. With fewer candidates all are returned; an empty table
    gives no rows.
    """
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("raw"))
    usable = usable.filter(F.col("id").isNotNull() & is_usable("raw")).filter(F.size("raw") > 0)
    rows = usable.select("id", F.size("raw").alias("dims"), quantised("raw").alias("vector"))
    asks = F.coalesce(is_query, F.lit(False))
    n, n_queries = usable.agg(F.count(F.lit(1)), F.count_if(asks)).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    candidates = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = rows.filter(asks).withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            query_ids, queries = _block(left)
            for query, (ids, scores) in zip(query_ids, SortedLists(*_block(right)).search(query_ids, queries, k), strict=True):
                exact = [min(max(int(s), _INT64.min), _INT64.max) for s in scores]
                found.append((np.full(len(ids), query), ids, np.array(exact, dtype=np.int64)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["dims", "c", "q"]
    asked = asked.select(*[F.col(x).cast("long").alias(x) for x in keys], "id", "vector")
    candidates = candidates.select(*[F.col(x).cast("long").alias(x) for x in keys], "id", "vector")
    met = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
