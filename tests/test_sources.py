"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from reviewfold.sources import tables
from reviewfold.storage import new_path


def test_csv_keeps_awkward_text(spark):
    rows = [(1, ' lead, "quoted"\nnext\\line '), (2, None), (3, "é ß")]
    # An empty field is a missing value when it is read, quoted or not.
    df = spark.createDataFrame([*rows, (4, "")], "id int, text string")
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = new_path(spark, "csv-test")
        tables.write_table(df, path, encoding=encoding)
        read = tables.read_table(spark, path, "id int, text string", encoding=encoding, multi_line=True)
        assert sorted(map(tuple, read.collect())) == [*rows, (4, None)]


def test_row_index_has_gaps_after_a_filter(spark):
    df = spark.createDataFrame([(7, "a"), (3, None), (5, "c")], "id int, text string")
    for base in (0, 1):
        path = new_path(spark, "index-test")
        tables.write_table(df, path, row_index=True, order_by=[F.col("id")], base=base, keep=F.col("text").isNotNull())
        read = tables.read_table(spark, path, "row_index bigint, id int, text string").collect()
        assert sorted(map(tuple, read)) == [(base + 1, 5, "c"), (base + 2, 7, "a")]
    with pytest.raises(ValueError):
        tables.write_table(df, new_path(spark, "index-test"), row_index=True)


def test_locations_with_sentinels(spark):
    path = new_path(spark, "locations-test")
    lines = [
        '{"real":{"id":1,"name":"A","accessType":"Public"},"placeSpecifics":{"types":["zoo","park"]},"poi":"Park"}',
        '{"real":{"id":2,"name":"B","accessType":null},"placeSpecifics":-1,"poi":-1}',
    ]
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)
    a, b = tables.read_locations(spark, path).orderBy("real.id").collect()
    assert a.placeSpecifics.types == ["zoo", "park"] and a.poi == "Park"
    assert b.placeSpecifics is None and b.poi is None


def test_rules_get_ordinals(spark):
    path = new_path(spark, "rules-test")
    line = '{"category":"Zoo","category_idx":4,"rules":[{"options":[],"keywords":["zoo"]},{"options":["PRINT"],"keywords":[]}]}'
    spark.createDataFrame([(line,)], "value string").write.text(path)
    rows = tables.load_rules(spark, path).orderBy("rule_idx").collect()
    assert [(r.category, r.category_idx, r.rule_idx) for r in rows] == [("Zoo", 4, 0), ("Zoo", 4, 1)]
    assert rows[0].keywords == ["zoo"] and rows[1].options == ["PRINT"]


def test_append_and_report(spark):
    log = new_path(spark, "log-test")
    for i in range(3):
        tables.append_table(spark.createDataFrame([(i, i / 3)], "run int, score double"), log)
    read = tables.read_table(spark, log, "run int, score double", header=False)
    assert sorted(map(tuple, read.collect())) == [(i, i / 3) for i in range(3)]
    report = new_path(spark, "report-test")
    tables.write_report(spark.createDataFrame([("b", 2), ("a", 1)], "line string, k int"), report, ["k"])
    assert [r.value for r in spark.read.text(report).collect()] == ["a", "b"]


def test_one_line_per_row_is_split(spark):
    """Without line breaks in fields a file can be read by several tasks."""
    path = new_path(spark, "csv-split")
    tables.write_table(spark.range(20_000).selectExpr("id", "concat('text \"', id, '\", ', id) as text").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = tables.read_table(spark, path, "id bigint, text string")
        assert read.rdd.getNumPartitions() > 1
        assert read.filter("text = concat('text \"', id, '\", ', id)").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
