"""Pipeline stages on empty tables, NULL and repeated ids, and clashing columns."""

import corpus_pipeline
import pytest

from reviewfold.llm.common import stored
from reviewfold.llm.near_dup import drop_near_duplicates
from tests.llm.samples import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, kept boolean, klass int, body string"


def table(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), 1, False, 2, "b") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def labelled(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_table(spark, tmp_path, name, stage):
    labelled(spark, tmp_path, [(1, 1), (2, None)])
    docs = table(spark, [])
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns


def test_near_copies_of_repeated_and_null_ids(spark):
    base = words(1, 60)
    other = words(2, 60)
    rows = [(1, base), (2, f"{base} more"), (2, other), (None, f"{other} again"), (None, words(3, 60)), (5, None), (5, ""), (None, f"{base} too")]
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(table(spark, rows)).collect()), key=repr)
    # NULL comes first, so the copies with NULL stay for their classes.
    assert kept == sorted([(None, f"{other} again"), (None, words(3, 60)), (5, None), (5, ""), (None, f"{base} too")], key=repr)


def test_all_stages_on_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, words(1, 60)), (1, words(2, 60)), (None, words(3, 60)), (None, words(4, 60)), (None, None), (7, ""), (8, f"{words(1, 60)} x")]
    labelled(spark, tmp_path, [(1, 0), (7, None), (None, 1)])
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
    texts = sorted(r.text or "" for r in docs.collect())
    assert texts == sorted(["", words(1, 60), words(2, 60), words(3, 60), words(4, 60)])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == 5
