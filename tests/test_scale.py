"""Joins with hot keys, distributed orders and exact splits."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewfold.operators import ordering, split, windows
from reviewfold.operators.skew import AUTO, _Counters, _salts_of, heavy_keys, skew_join
from tests.conftest import SF_DIR


def hot_rows(n=3000):
    rng = random.Random(4)
    return [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 200)}", rng.random()) for i in range(n)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salts", [1, 7, 16, AUTO])
def test_salted_join_equals_plain(spark, no_broadcast, how, salts):
    left = spark.createDataFrame(hot_rows(), "id int, k string, v double")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, w int")
    key = lambda rows: sorted(map(repr, rows))
    assert key(skew_join(left, right, "k", how, salts).collect()) == key(left.join(right, "k", how).collect())


def test_hot_keys_are_found_and_no_others(spark):
    """A third of the rows, a key at the border, many small keys and NULL keys."""
    rows = ["a"] * 4000 + ["b"] * 200 + [None] * 900 + [f"k{i % 5000}" for i in range(6900)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(k,) for k in rows], "k string").repartition(7)
    named = {r.h: r.k for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    found = {named[h]: share for h, share in heavy_keys(df, ["k"]).items()}
    assert set(found) == {"a", "b", None}
    for key, n in (("a", 4000), ("b", 200), (None, 900)):
        assert n / 12_000 - 1 / 256 <= found[key] <= n / 12_000
    assert heavy_keys(df.filter("k like 'k%'"), ["k"]) == {}
    assert heavy_keys(df.limit(0), ["k"]) == {}


@pytest.mark.parametrize("seed", range(4))
def test_counters_miss_by_a_bounded_number(seed):
    rng = random.Random(seed)
    counters, exact = _Counters(16), Counter()
    for _ in range(30):
        batch = [rng.randrange(5) if rng.random() < 0.5 else rng.randrange(10**6) for _ in range(rng.randrange(200))]
        exact.update(batch)
        counters.add(np.array(batch, dtype=np.int64))
    kept = dict(zip(counters.keys.tolist(), counters.counts.tolist(), strict=True))
    assert counters.rows == sum(exact.values()) and len(kept) <= 16
    assert all(0 <= n - kept.get(k, 0) <= counters.rows / 16 for k, n in exact.items())


def test_identical_rows_of_a_hot_key_fill_all_tasks(spark, no_broadcast):
    """A third of the rows are one repeated row; each task gets about its share, and the
    other side is copied for the hot key alone."""
    left = spark.createDataFrame([(0, "hot")] * 6000 + [(i, f"k{i}") for i in range(12_000)], "id int, k string").repartition(5)
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(12_000)], "k string, w int")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = skew_join(left, right, "k", "left", salts=AUTO)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        salts = _salts_of(heavy_keys(left, ["k"]), 16, F.xxhash64("k"))
        copies = {r.k: r.n for r in right.select("k", salts.alias("n")).collect() if r.n > 1}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 18_000 and len(sizes) == 16 and max(sizes) < 2.5 * 18_000 / 16
    assert list(copies) == ["hot"] and 16 < copies["hot"] <= 48


def test_salt_spreads_hot_key(spark, no_broadcast):
    left = spark.createDataFrame([(i, "hot") for i in range(8000)], "id int, k string")
    right = spark.createDataFrame([("hot", 1)], "k string, w int")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        sizes = skew_join(left, right, "k", "left").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(key, "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 8000 * 0.6


def test_copies_of_one_row_are_kept(spark, no_broadcast):
    left = spark.createDataFrame([("hot", 1)] * 500 + [("cold", 2)] * 3, "k string, v int")
    assert skew_join(left, left.groupBy("k").count(), "k", "left").filter("count = 500").count() == 500


def test_adaptive_split_of_salted_join(spark, no_broadcast):
    """What is still uneven after the salt is split by adaptive execution."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4kb",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.createDataFrame([("hot", "x")] * 40000 + [(f"k{i}", "y") for i in range(500)], "k string, v string")
        left = left.repartition(16)
        right = left.select("k").distinct().withColumn("w", F.lit(1))
        joined = skew_join(left, right, "k", "left")
        assert joined.collect().__len__() == 40500
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("partitions", [1, 5])
def test_group_figures(spark, no_broadcast, partitions):
    rows = hot_rows(1000)
    df = spark.createDataFrame(rows, "id int, k string, v double").repartition(partitions)
    counts = Counter(k for _, k, _ in rows)
    assert all(r["count"] == counts[r.k] for r in windows.with_group_count(df, "k").collect())
    first = {r.k: r.id for r in windows.first_per_key(df, "k", "id").collect()}
    expected = {}
    for i, k, _ in rows:
        expected.setdefault(k, i)
    assert first == expected


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(50), "id int, k string, v double")
    plan = windows.first_per_key(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_ranked_and_running_totals(spark):
    rng = random.Random(8)
    rows = [(f"w{i}", rng.randint(1, 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "word string, n int").repartition(6)
    order = [F.col("n").desc(), F.col("word").asc()]
    ranked = {r.word: r.rank for r in ordering.ranked(df, order).collect()}
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ranked == {w: i for i, (w, _) in enumerate(expected, 1)}
    totals = {r.word: (r.upto, r.upto_all) for r in ordering.running_totals(df, order, {"upto": "n"}).collect()}
    running, whole = 0, sum(n for _, n in rows)
    for word, n in expected:
        running += n
        assert totals[word] == (running, whole)
    assert ordering.ranked(df.limit(0), order).count() == 0


@pytest.mark.parametrize(("n", "share", "test"), [(8953, 0.2, 1791), (10, 0.25, 3), (1, 0.2, 1)])
def test_holdout_size(spark, n, share, test):
    df = spark.range(n).withColumnRenamed("id", "key")
    train_rows, test_rows = split.holdout_split(df, "key", share, 22)
    a, b = {r.key for r in train_rows.collect()}, {r.key for r in test_rows.collect()}
    assert len(b) == test and len(a) == n - test and not a & b


def test_holdout_refines_large_bins(spark, monkeypatch):
    monkeypatch.setattr(split, "_SORTABLE", 1)
    monkeypatch.setattr(split, "_DIGITS", 1)
    df = spark.range(5000).withColumnRenamed("id", "key")
    for border in split.holdout_borders(df, "key", 0.3, [1, 2, 3]):
        assert df.filter(split.in_test("key", border)).count() == math.ceil(0.3 * 5000)


def test_assignments_are_exact_for_every_run(spark):
    df = spark.range(101).withColumnRenamed("id", "key")
    out = split.holdout_assignments(df, "key", 7).groupBy("run").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert sorted((r.run, r.t, r.n) for r in out.collect()) == [(run, 21, 101) for run in range(7)]


def test_split_is_a_narrow_filter(spark):
    df = spark.range(100).withColumnRenamed("id", "key")
    _, test = split.holdout_split(df, "key")
    assert "Exchange" not in test._jdf.queryExecution().executedPlan().toString()


SLOW_TO_BUILD = {"repeated_holdout", "rbf_svm_predict", "embedding_mlp", "score_reviews", "model_roundtrip", "token_attribution", "logistic_predict", "holdout_summary", "certified_mlp", "checked_word_attribution"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW_TO_BUILD))
def test_no_cross_join_in_any_plan(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["filter_equal"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan
    rates = entry.queries()["entity_rate"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in rates
