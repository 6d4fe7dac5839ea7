"""Distributions, quantiles, histograms and tests against closed values and
brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from reviewfold.functions import distributions as D
from reviewfold.operators import aggregates as A
from reviewfold.operators import inference


def test_t_distribution_known_values():
    assert float(D.t_cdf_values(1.2, 7.3)) == pytest.approx(0.8661846667, abs=1e-9)
    assert float(D.t_ppf_values(0.975, 9)) == pytest.approx(2.2621571628, abs=1e-9)
    assert float(D.t_ppf_values(0.025, 9)) == pytest.approx(-2.2621571628, abs=1e-9)
    assert float(D.t_two_sided_values(0.0, 5)) == pytest.approx(1.0)
    assert math.isnan(float(D.t_cdf_values(float("nan"), 5)))
    # One degree of freedom is the Cauchy distribution.
    assert float(D.t_cdf_values(3.0, 1)) == pytest.approx(0.5 + math.atan(3.0) / math.pi, abs=1e-12)
    assert float(D.t_ppf_values(0.975, 1e6)) == pytest.approx(1.9599664, abs=1e-5)


def test_against_library_on_the_classpath(spark):
    jvm = spark.sparkContext._jvm
    for t, df in ((0.3, 2.5), (-4.0, 30.0), (1.96, 400.0), (12.0, 3.0)):
        reference = jvm.org.apache.commons.math3.distribution.TDistribution(df).cumulativeProbability(t)
        assert float(D.t_cdf_values(t, df)) == pytest.approx(reference, abs=1e-10)


def test_t_udfs_keep_null(spark):
    df = spark.createDataFrame([(1.2, 7.3), (None, 7.3)], "t double, df double")
    rows = df.select(D.t_cdf("t", "df").alias("c"), D.t_two_sided("t", "df").alias("p")).collect()
    assert rows[0].c == pytest.approx(0.8661846667, abs=1e-9)
    assert rows[1].c is None and rows[1].p is None


def test_kolmogorov_tail(spark):
    df = spark.createDataFrame([(1.1,), (0.5,), (0.999999,), (1.000001,), (0.0,)], "x double")
    p = [r.p for r in df.select(D.kolmogorov_sf(F.col("x")).alias("p")).collect()]
    assert p[0] == pytest.approx(1 - 0.8222818074, abs=1e-9)
    assert p[1] == pytest.approx(0.9639452436, abs=1e-8)
    assert p[2] == pytest.approx(p[3], abs=1e-5)
    assert p[4] == 1.0


def test_quantiles_small_and_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "x double")
    assert [r.value for r in A.quantiles(df, "x", (0.25, 0.75)).collect()] == [1.75, 3.25]
    values = [random.Random(5).choice([1.0, 2.0, 2.0, 7.5, 9.0]) for _ in range(101)]
    got = A.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", (0.0, 0.1, 0.5, 0.9, 1.0))
    ordered = sorted(values)
    expected = [ordered[int(p * 100)] for p in (0.0, 0.1, 0.5, 0.9, 1.0)]
    assert [r.value for r in got.collect()] == expected


def test_six_number_summary(spark):
    values = [random.Random(1).random() for _ in range(57)]
    row = A.six_number_summary(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    q1, median, q3 = statistics.quantiles(values, n=4, method="inclusive")
    assert (row.min, row.max) == (min(values), max(values))
    assert (row.q1, row.median, row.q3) == pytest.approx((q1, median, q3))
    assert row.mean == pytest.approx(statistics.fmean(values))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v, "a") for v in (0.0, 0.05, 0.0500001, 1.0)], "x double, g string")
    rows = A.histogram(df, "x", 0.05, 0.0, 1.0, "g", ["a", "b"]).collect()
    filled = {r.bin: r.n for r in rows if r.n and r.g == "a"}
    assert filled == {1: 2, 2: 1, 20: 1}
    assert len(rows) == 40 and sum(r.n for r in rows if r.g == "b") == 0


def brute_welch(x, y):
    vx, vy = statistics.variance(x) / len(x), statistics.variance(y) / len(y)
    t = (statistics.fmean(x) - statistics.fmean(y)) / math.sqrt(vx + vy)
    return t, (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))


def test_welch(spark):
    rng = random.Random(3)
    x, y = [rng.gauss(0, 1) for _ in range(12)], [rng.gauss(1, 2) for _ in range(30)]
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "g string, v double")
    row = inference.welch_test(df, "v", "g", "x", "y").first()
    t, freedom = brute_welch(x, y)
    assert (row.t, row.df) == pytest.approx((t, freedom))
    assert row.p_value == pytest.approx(2 * (1 - float(D.t_cdf_values(abs(t), freedom))))
    swapped = inference.welch_test(df, "v", "g", "y", "x").first()
    assert swapped.t == pytest.approx(-row.t) and swapped.p_value == pytest.approx(row.p_value)


def test_welch_reasons(spark):
    few = spark.createDataFrame([("x", 1.0)] + [("y", float(i)) for i in range(5)], "g string, v double")
    row = inference.welch_test(few, "v", "g", "x", "y").first()
    assert row.t is None and row.p_value is None and row.reason == "not enough observations"
    flat = spark.createDataFrame([("x", 1.0)] * 3 + [("y", 2.0)] * 3, "g string, v double")
    assert inference.welch_test(flat, "v", "g", "x", "y").first().reason == "data are constant"
    pairs = inference.welch_pairwise(few, "v", "g", [("x", "y"), ("y", "z")]).collect()
    assert [r.reason for r in pairs] == ["not enough observations"] * 2 and pairs[1].n_y == 0


def test_ks_brute_force(spark):
    rng = random.Random(9)
    x, y = [rng.randint(0, 9) / 10 for _ in range(40)], [rng.randint(2, 12) / 10 for _ in range(25)]
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "g string, v double")
    at = lambda s, v: sum(1 for e in s if e <= v) / len(s)
    d = max(abs(at(x, v) - at(y, v)) for v in x + y)
    row = inference.ks_two_sample(df, "v", "g", "x", "y").first()
    assert row.d == pytest.approx(d) and (row.n_x, row.n_y) == (40, 25)
    assert inference.ks_two_sample(df, "v", "g", "y", "x").first().d == pytest.approx(d)


def test_mean_ci(spark):
    values = [0.1, 0.4, 0.4, 0.7, 0.9]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = A.mean_ci(df, "g", "v").first()
    error = statistics.stdev(values) / math.sqrt(5)
    assert row.std_err == pytest.approx(error)
    assert row.high_ci == pytest.approx(0.5 + 2.7764451052 * error, abs=1e-9)


def test_crosstab_margins(spark):
    rng = random.Random(2)
    rows = [(rng.choice("PNX"), rng.choice([0, 1, 2, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, u int")
    table = {r.s: r for r in A.crosstab_margins(df, "s", ["P", "N"], "u", {"zero": 0, "one": 1}).collect()}
    for row in table.values():
        assert row.zero + row.one == row.Total
    assert table["P"].zero + table["N"].zero == table["Total"].zero
    assert table["P"].one == sum(1 for s, u in rows if s == "P" and u == 1)


def test_entity_rate_keeps_first_row(spark):
    rows = [("a", "POSITIVE", 2, "late"), ("a", "NEGATIVE", 1, "early"), ("a", "NEUTRAL", 0, "ignored"), ("b", "POSITIVE", 5, "b")]
    df = spark.createDataFrame(rows, "e string, s string, k int, attr string")
    out = {r.e: r for r in A.entity_rate(df, "e", "s", ["attr"], "k").collect()}
    assert (out["a"].prob, out["a"].attr, out["a"].n) == (0.5, "early", 2)
    assert out["b"].prob == 0.0


@pytest.mark.parametrize("rows", [[("a", 1.0), ("a", 2.0)], [], [("a", None), ("b", 1.0)]])
def test_ks_without_values_in_a_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    row = inference.ks_two_sample(df, "v", "g", "a", "b").first()
    assert row.d is None and row.p_value is None and 0 in (row.n_x, row.n_y)


def test_histogram_does_not_drop_values(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 1.5), ("a", None)], "g string, v double")
    assert sum(r.n for r in A.histogram(df.filter("v < 1"), "v", 0.25, 0.0, 1.0, "g", ["a"]).collect()) == 1
    with pytest.raises(Exception, match="outside the histogram"):
        A.histogram(df, "v", 0.25, 0.0, 1.0, "g", ["a"]).collect()


@pytest.mark.parametrize("size", [0, 1, -0.1, 1.5])
def test_holdout_needs_a_proper_share(spark, size):
    from reviewfold.operators.split import holdout_split

    with pytest.raises(ValueError, match="test_size"):
        holdout_split(spark.range(10), "id", size)
