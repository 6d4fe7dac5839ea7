"""Parallel reading of CSV with line breaks, against the reader that takes a file in one task."""

import random

import pytest

from reviewfold.sources import tables
from reviewfold.sources.records import read_records, record_texts
from reviewfold.storage import new_path

SCHEMA = "id int, text string, n double"


def random_rows(seed, n=120):
    rng = random.Random(seed)
    parts = ["word", " ", '"', "\n", "\n\n", ",", "é", "\\", '""', "'", "x" * 40]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 12))) or None, rng.choice([None, 1.5])) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "encoding"), [(1, "UTF-8"), (2, "UTF-8"), (3, "ISO-8859-1")])
def test_same_rows_as_one_task(spark, small_blocks, seed, encoding):
    path = new_path(spark, "records-test")
    tables.write_table(spark.createDataFrame(random_rows(seed), SCHEMA).coalesce(2), path, encoding=encoding)
    whole = tables.read_table(spark, path, SCHEMA, encoding=encoding, multi_line=True)
    parallel = read_records(spark, path, SCHEMA, encoding=encoding)
    assert sorted(map(repr, parallel.collect())) == sorted(map(repr, whole.collect()))
    blocks = spark.read.text(path).selectExpr("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert blocks > 10


def test_a_field_over_many_blocks(spark, small_blocks):
    path = new_path(spark, "records-test")
    long = "\n".join(f"line {i}, with, commas" for i in range(80))
    rows = [(1, "a", 1.0), (2, long, 2.0), (3, None, None), (4, f'"{long}"', 0.5), (5, "end", 1.0)]
    tables.write_table(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert sorted(map(tuple, read_records(spark, path, SCHEMA).collect())) == rows


def test_line_ends_blank_lines_and_headers(spark, small_blocks, tmp_path):
    body = '"i\nd",text,n\r\n1,"a\r\nb",1\r\n\r\n2,c,\n\n3,"",2'
    (tmp_path / "a.csv").write_bytes(body.encode())
    got = sorted(map(tuple, read_records(spark, str(tmp_path), SCHEMA).collect()))
    assert got == [(1, "a\nb", 1.0), (2, "c", None), (3, None, 2.0)]
    assert record_texts(spark, str(tmp_path), header=False).count() == 4


def test_no_record_breaks_in_silence(spark):
    path = new_path(spark, "records-test")
    tables.write_table(spark.createDataFrame([(1, "one\ntwo", 1.0), (2, "x", 2.0)], SCHEMA), path)
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_table(spark, path, SCHEMA).collect()


def test_a_run_written_twice_is_there_once(spark):
    path = new_path(spark, "runs-test")
    schema = "score double, run string"
    for run, scores in (("a", [0.1]), ("b", [0.2, 0.3]), ("a", [0.4]), ("b", [0.2, 0.3])):
        tables.write_run(spark.createDataFrame([(s,) for s in scores], "score double"), path, run)
    assert sorted(map(tuple, tables.read_runs(spark, path, schema).collect())) == [(0.2, "b"), (0.3, "b"), (0.4, "a")]
