"""The inverted rule index against the compiled rules."""

import random

import pytest

from reviewfold.operators import rules as R
from reviewfold.operators.rule_index import categorize_by_table
from tests.test_rules import NAMES, random_place, random_rule

def as_table(spark, rules):
    rows = [(r.category, i, r.rule_idx, list(r.options), list(r.keywords)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, R.RULE_TABLE).repartition(3)


def places(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, access string, types array<string>")


@pytest.mark.parametrize("seed", range(5))
def test_same_rows_as_compiled_rules(spark, seed):
    rng = random.Random(100 + seed)
    rules = [random_rule(rng, i)[0] for i in range([1, 5, 12, 25, 40][seed])]
    rows = [random_place(rng, i)[0] for i in range(60)]
    rows += [(100, None, "Public", ["zoo"]), (101, "", "Restricted", []), (102, " rv  park ", None, None), (103, None, None, [None, "bar"])]
    df = places(spark, rows)
    expected = {r.id: (r.rule_no, r.category) for r in R.categorize(df, rules, **NAMES).collect()}
    got = categorize_by_table(df, as_table(spark, rules), "id", **NAMES)
    assert got.columns == [*df.columns, "rule_no", "category"]
    assert {r.id: (r.rule_no, r.category) for r in got.collect()} == expected


def test_ten_thousand_rules_in_a_plan_of_constant_size(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rules = []
    for i in range(10_000):
        phrase = " ".join(rng.sample(words, rng.choice([1, 1, 2, 3])))
        rules.append(R.Rule(f"c{i % 7}", i, 0, (f"Gtype_{'-' * (i % 3 == 0)}t{i % 5}",), (phrase, f"-{rng.choice(words)}")))
    rows = [(i, " ".join(rng.choices(words, k=5)), None, [f"t{rng.randrange(6)}"]) for i in range(300)]

    def first(name, types):
        padded = f" {name} "
        for i, r in enumerate(rules):
            option = r.options[0][6:]
            fits = types[0] != option[1:] if option[0] == "-" else types[0] == option
            if fits and f" {r.keywords[0]} " in padded and f" {r.keywords[1][1:]} " not in padded:
                return i
        return None

    table = as_table(spark, rules)
    few = categorize_by_table(places(spark, rows), as_table(spark, rules[:5]), "id", **NAMES)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plan")
    found = categorize_by_table(places(spark, rows), table, "id", **NAMES)
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found._jdf.queryExecution().analyzed().toString()) == pytest.approx(len(few._jdf.queryExecution().analyzed().toString()), rel=0.05)
    got = {r.id: r.rule_no for r in found.collect()}
    assert got == {i: first(name, types) for i, name, _, types in rows}
    assert sum(v is not None for v in got.values()) > 100


def test_no_rules_and_no_places(spark):
    df = places(spark, [(1, "ring", None, None)])
    assert [(r.rule_no, r.category) for r in categorize_by_table(df, as_table(spark, []), "id", **NAMES).collect()] == [(None, None)]
    only = R.Rule("none", 0, 0, (), ("-ring",))
    assert categorize_by_table(df, as_table(spark, [only]), "id", **NAMES).first().rule_no is None
    assert categorize_by_table(df.limit(0), as_table(spark, [only]), "id", **NAMES).count() == 0
