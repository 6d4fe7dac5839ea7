"""Top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewfold.llm import topk
from reviewfold.llm.topk import SortedLists, top_k

SCHEMA = "vec_id long, embedding array<float>, id string, vector string, q int, c int, dims int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2, 3) for i, v in rows], SCHEMA)


def truth(rows, is_query, k):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        mine = [math.floor(256 * float(np.float32(x))) for x in v]
        usable[i] = min(usable.get(i, mine), mine)
    found = set()
    for i, v in usable.items():
        if is_query(i):
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in usable.items() if j != i and len(w) == len(v)]
            for rank, (score, j) in enumerate(sorted(scores)[:k], 1):
                found.add((i, rank, j, -score))
    return found


def rows_of(n, dims, seed, clustered=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = rng.normal(size=(n, dims)) * (0.1 if clustered else 1) + (centres[rng.integers(0, 5, n)] if clustered else 0)
    return [(i, [float(y) for y in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("clustered", [False, True])
def test_against_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rows = rows_of(600, 6, 1, clustered)
    found = top_k(frame(spark, rows), F.col("id") % 10 == 0, 5).collect()
    assert {tuple(r) for r in found} == truth(rows, lambda i: i % 10 == 0, 5)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0]),
        (10, None),
        (20, []),
        (30, [1.0, None]),
        (40, [float("nan"), 1.0]),
        (50, [float("inf"), 1.0]),
        (None, [1.0, 1.0]),
        (60, [1.0, 2.0]),
        (61, [1.0, 2.0]),
        (61, [1.0, 2.0]),
        (62, [0.5, 2.0]),
        (62, [1.0, -2.0]),
        (70, [1.0, 2.0, 3.0]),
        (80, [0.0, 0.0]),
        (90, [-1e-9, 0.0]),
    ]
    found = [tuple(r) for r in top_k(frame(spark, rows), F.col("id") % 10 == 0, 5).collect()]
    assert len(found) == len(set(found)) and set(found) == truth(rows, lambda i: i % 10 == 0, 5)


def test_scores_beyond_doubles(spark):
    rows = [(0, [3e14, 1.0]), (1, [3e14, 3.0]), (2, [-3e14, 5.0])]
    found = {(r.query_id, r.vec_id): r.score for r in top_k(frame(spark, rows), F.col("id") == 0, 5).collect()}
    assert found[0, 1] == (1 << 63) - 1 and found[0, 2] == -(1 << 63)


def test_empty_table(spark):
    assert top_k(frame(spark, []), F.lit(True), 5).count() == 0


def test_search_stops_before_the_end():
    """With one clear winner in each list the bound ends the search early."""
    n = 4000
    vectors = np.tile(np.arange(n)[:, None] % 50, (1, 3)).astype(np.int64)
    vectors[7] = 10_000
    lists = SortedLists(np.arange(n), vectors)
    finished = []
    lists._finish = lambda rows, *rest: finished.extend(rows)
    [(ids, scores)] = lists.search(np.array([n + 1]), np.array([[1, 1, 1]]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [30_000] and not finished
