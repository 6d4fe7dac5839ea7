"""Blocks of the inverted table against the dense matrix."""

import numpy as np
import pyarrow as pa

from reviewfold.operators import linear


def test_blocks_equal_the_dense_matrix(monkeypatch):
    """Terms that go on over batches, counts above 1, terms in one text, several runs."""
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 50)
    rng = np.random.default_rng(1)
    matrix = (rng.random((120, 60)) < rng.random((120, 1)) ** 4) * rng.integers(1, 4, (120, 60))
    term, row = np.nonzero(matrix)
    names = np.array([f"t{i:03d}" for i in range(120)])
    whole = pa.RecordBatch.from_pydict({"term": names[term], "row": pa.array(row, pa.int32()), "tf": pa.array(matrix[term, row], pa.int32())})
    batches = list(linear._packed(2)(whole.slice(i, 37) for i in range(0, whole.num_rows, 37)))
    found, given = [], rng.random((60, 5))
    out, squares = np.zeros((60, 5)), np.zeros((60, 5))
    for batch in batches:
        for i, block in enumerate(linear._blocks(batch)):
            at = [int(t[1:]) for t in batch.column("terms")[i].values.to_pylist()]
            found += at
            assert np.allclose(block.to_terms(given), matrix[at] @ given)
            assert np.allclose(block.to_terms(given[:, :1]), matrix[at] @ given[:, :1])
            assert np.array_equal(block.texts_of((given > 0.5).astype(np.int8)), (matrix[at] > 0).astype(int) @ (given > 0.5))
            block.to_rows(block.to_terms(given), out)
            block.to_rows(block.to_terms(given), squares, power=2)
    kept = np.flatnonzero((matrix > 0).sum(axis=1) >= 2)
    assert sorted(found) == kept.tolist()
    assert np.allclose(out, matrix[kept].T @ matrix[kept] @ given) and np.allclose(squares, matrix[kept].T ** 2 @ matrix[kept] @ given)
