"""Terms and their rows travel in packed lists: the same rows as a join would give, in far fewer bytes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewfold.functions.text import word_tokens
from reviewfold.operators import bundles, linear, terms

WORDS = [["aa", "bb", "aa", "éé", "zz"], [], None, ["cc"], ["aa", "bb"], ["日本", "aa", "bb"]]


def test_a_sequence_has_the_hash_of_its_text():
    lists = pa.array(WORDS, pa.list_(pa.string()))
    for sliced in (lists, lists.slice(3)):
        written = [bundles._hashes(t)[0] for _, t in bundles.sequences(sliced, 1, 3)]
        assert all(np.array_equal(a, b) for a, b in zip(written, bundles._sequence_hashes(sliced, 1, 3), strict=True))
    assert len(bundles._hashes(pa.array([], pa.string()))[0]) == 0
    many = pa.array([f"w{i} x{i % 97}" for i in range(200_000)])
    placed = bundles._placed([bundles._hashes(many)[0]], 16)[0]
    assert len(np.unique(placed)) > 199_990 and np.bincount((placed >> np.uint64(32)).astype(int), minlength=16).min() > 11_000


@pytest.mark.parametrize("size", [1 << 24, 40])
def test_terms_meet_their_rows(spark, monkeypatch, size):
    """Every term of every text that the table holds, and no other; NULL, blank and repeated ids included."""
    monkeypatch.setattr(bundles, "BLOCK_BYTES", size)
    texts = spark.createDataFrame([(i % 4 if i < 5 else None, " ".join(w) if w is not None else None) for i, w in enumerate(WORDS)], "id int, text string")
    known = ["aa", "aa bb", "bb aa éé", "zz", "日本 aa bb", "never", "é"]
    table = spark.createDataFrame([(t, float(i)) for i, t in enumerate(known)], "term string, weight double")

    def work(given, rows):
        bundle = bundles.TermBundle(given, rows, "id", 1, 3)
        out = [bundle.ids.take(pa.array(bundle.post_text)), bundle.terms.take(pa.array(bundle.post_term)), pa.array(bundle.numbers("weight") * bundle.tf)]
        return pa.table(out, names=["id", "term", "value"])

    for joined in (True, False):
        dealt = bundles.deal_out(texts, "id", word_tokens(F.col("text")), 3, joined=joined)
        got = bundles.meet_terms(dealt, "id", 200, 1, 3, table, work, "id int, term string, value double").collect()
        expected = {(0, "aa"): 0.0, (0, "aa bb"): 2.0, (0, "bb aa éé"): 2.0, (0, "zz"): 3.0}
        assert {(r.id, r.term): r.value for r in got} == expected | {(0, "aa"): 0.0}


def test_packed_lists_are_the_inverted_table(spark, monkeypatch):
    """Texts counted in small parts and sent early give each term once with all of its texts."""
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, i % 9 + 1)), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "", 1.0), (101, None, 0.0), (102, "w1 w2", None)], "id int, text string, label double")
    expected = {}
    for r in df.filter("label is not null").withColumn("t", terms.terms_of(F.col("text"), ("w3",))).collect():
        for t in r.t or []:
            expected.setdefault(t, {}).setdefault(r.id, 0)
            expected[t][r.id] += 1
    expected = {t: x for t, x in expected.items() if len(x) >= 2}
    for words, held in ((1 << 20, 1 << 22), (7, 5)):
        monkeypatch.setattr(linear, "PART_WORDS", words)
        monkeypatch.setattr(linear, "HELD_TERMS", held)
        table = linear.Inverted.of(df, "id", "text", "label", ("w3",), 1, 3, 2)
        ids = {r._row: r.id for r in table.rows.collect()}
        got = {}
        for r in table.terms.collect():
            size, row, tf = (np.frombuffer(x, np.int32) for x in (r.sizes, r.rows, r.tfs))
            for t, a, b in zip(r.terms, np.cumsum(size) - size, np.cumsum(size), strict=True):
                assert t not in got
                got[t] = {ids[i]: n for i, n in zip(row[a:b].tolist(), tf[a:b].tolist(), strict=True)}
        assert got == expected and len(table.labels) == 62
    plan = str(linear.TermLogistic(table.terms.limit(0).selectExpr("'x' as term", "1L as df", "1D as idf", "1D as weight"), 0.0, 2).score(df, "id", "text")._jdf.queryExecution().executedPlan().toString())
    assert "Generate" not in plan and "SortMergeJoin" not in plan
