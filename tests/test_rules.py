"""Rule categorization against a plain loop over random small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from reviewfold.operators import rules as R

PHRASES = ["ring", "rod", "blue", "rv", "r v", "park"]
TYPES = ["zoo", "bar", "park"]
LEVELS = {"P": "Public", "R": "Restricted"}
NAMES = {"name": "name", "access": "access", "types": "types"}


def random_rule(rng, number):
    """A rule as sets and lists, and the same rule as options and keywords."""
    level = rng.choice([None, None, "P", "R"])
    listed = rng.sample(TYPES, rng.randint(0, 3))
    cut = rng.randint(0, len(listed))
    include, exclude = set(listed[:cut]), set(listed[cut:])
    misspelt = rng.random() < 0.1
    words = rng.sample(["ALL", *PHRASES], rng.randint(0, 4))
    signed = [(w, w != "ALL" and rng.random() < 0.4) for w in words]
    options = [f"Gtype_{t}" for t in sorted(include)] + [f"Gtype_-{t}" for t in sorted(exclude)]
    options += ["PRINT"] * rng.randint(0, 1) + ["Gtypes_zoo"] * misspelt + [f"pubRstr_{level}"] * (level is not None)
    rng.shuffle(options)
    keywords = tuple("-" * minus + w for w, minus in signed)
    rule = R.Rule(f"c{number % 4}", number % 4, number, tuple(options), keywords)
    return rule, (level, include | ({"_zoo"} if misspelt else set()), exclude, signed)


def random_place(rng, number):
    """A place with the phrases its name holds."""
    words = [w for p in rng.sample([*PHRASES, "Harvest"], rng.randint(1, 4)) for w in p.split()]
    name = "".join(w + rng.choice([" ", "/", ", "]) for w in words[:-1]) + words[-1]
    held = {" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)} | {"ALL"}
    types = None if rng.random() < 0.2 else rng.sample([*TYPES, "_zoo"], rng.randint(0, 3))
    return (number, name, rng.choice(["Public", "Restricted", None]), types), held


def outcome(parts, place, held):
    """Whether the rule assigns the place, and its raw hits."""
    level, include, exclude, signed = parts
    _, _, access, types = place
    ranks = {t: i for i, t in reversed(list(enumerate(types or []))) if t in include | exclude}
    first = min(ranks, key=ranks.get, default=None)
    if level is not None and access != LEVELS[level] or (first in exclude if ranks else bool(include)):
        return False, 0
    unwanted = [i for i, (w, minus) in enumerate(signed) if minus and w in held]
    wanted = [i for i, (w, minus) in enumerate(signed) if not minus and w in held]
    return bool(wanted) and not unwanted, sum(i < min(unwanted, default=len(signed)) for i in wanted)


@pytest.mark.parametrize("seed", range(6))
def test_equals_set_tests(spark, seed):
    rng = random.Random(seed)
    rules = [random_rule(rng, i) for i in range(6)]
    places = [random_place(rng, i) for i in range(40)]
    df = spark.createDataFrame([p for p, _ in places], "id int, name string, access string, types array<string>")
    results = {p[0]: [outcome(parts, p, held) for _, parts in rules] for p, held in places}
    expected = {i: next((n for n, (hit, _) in enumerate(found) if hit), None) for i, found in results.items()}
    listed = [rule for rule, _ in rules]
    assert {r.id: r.rule_no for r in R.categorize(df, listed, **NAMES).collect()} == expected
    reached = {i: len(rules) if n is None else n + 1 for i, n in expected.items()}
    figures = [
        (sum(n == k for n in expected.values()), sum(found[k][1] for i, found in results.items() if reached[i] > k))
        for k in range(len(rules))
    ]
    assert [(r.assigned, r.raw_hits) for r in R.rule_counts(df, listed, **NAMES).collect()] == figures


def test_last_access_option_counts(spark):
    rule = R.Rule("a", 0, 0, ("pubRstr_P", "pubRstr_R"), ("ALL",))
    df = spark.createDataFrame([("x", "Public", None), ("y", "Restricted", None)], "name string, access string, types array<string>")
    assert [r.category for r in R.categorize(df, [rule], **NAMES).collect()] == [None, "a"]


@pytest.mark.parametrize(
    ("types", "include", "exclude", "result"),
    [
        (["a", "b"], ["a"], ["b"], True),
        (["b", "a"], ["a"], ["b"], False),
        (["c"], [], ["b"], True),
        (None, ["a"], [], False),
        (None, [], ["b"], True),
        (["c"], [], [], True),
    ],
)
def test_type_predicate(spark, types, include, exclude, result):
    df = spark.createDataFrame([(types,)], "t array<string>")
    assert df.select(R.type_predicate(F.col("t"), include, exclude).alias("r")).first().r is result


def test_misspelt_prefix(spark):
    rule = R.Rule("Zoo", 0, 0, ("Gtypes_zoo",), ("ALL",))
    df = spark.createDataFrame([("x", None, ["zoo"])], "name string, access string, types array<string>")
    names = {"name": "name", "access": "access", "types": "types"}
    assert R.categorize(df, [rule], **names).first().category is None
    assert R.categorize(df, [rule], strict_prefix=False, **names).first().category == "Zoo"
    table = spark.createDataFrame([("Zoo", 0, 0, ["Gtypes_zoo"], ["ALL"])], "category string, category_idx int, rule_idx int, options array<string>, keywords array<string>")
    assert R.parse_options(table).first().include_types == ["_zoo"]
    assert R.parse_options(table, strict_prefix=False).first().include_types == ["zoo"]


def test_many_rules_stay_one_expression(spark):
    """A rule list of realistic size compiles and needs no shuffle."""
    rules = [R.Rule(f"c{i}", i, 0, (f"Gtype_t{i}", "Gtype_-x"), tuple(f"w{i}_{k}" for k in range(8)) + ("-no",)) for i in range(60)]
    df = spark.createDataFrame([("w59_7 yes", "Public", ["t59"]), ("w3_1 no", "Public", ["t3"])], "name string, access string, types array<string>")
    out = R.categorize(df, rules, name="name", access="access", types="types")
    assert [r.category for r in out.collect()] == ["c59", None]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("count", [54, 120])
def test_many_rules_are_compiled(spark, count):
    """The expressions stay within what one generated class may hold."""
    rules = [R.Rule(f"c{i}", i, 0, (f"Gtype_t{i}", "Gtype_-x", "pubRstr_P"), ("ALL", f"w{i}", "-no")) for i in range(count)]
    df = spark.range(50).selectExpr("concat('w', id) as name", "'Public' as access", "array(concat('t', id)) as types")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert R.categorize(df, rules, **NAMES).filter("rule_no is not null").count() == min(50, count)
        assert [r.assigned for r in R.rule_counts(df, rules, **NAMES).collect()][:50] == [1] * 50
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("b", 1, 0, None, ["ALL"]), ("a", 0, 1, ["Gtype_zoo"], ["ALL"]), ("a", 0, 0, [], None)],
        "category string, category_idx int, rule_idx int, options array<string>, keywords array<string>",
    )
    rules = R.rules_of(table)
    assert [(r.category, r.rule_idx, r.options, r.keywords) for r in rules] == [
        ("a", 0, (), ()),
        ("a", 1, ("Gtype_zoo",), ("ALL",)),
        ("b", 0, (), ("ALL",)),
    ]
    df = spark.createDataFrame([("x", None, ["zoo"]), ("y", None, None)], "name string, access string, types array<string>")
    assert [r.category for r in R.categorize(df, rules, **NAMES).collect()] == ["a", "b"]


def test_building_the_plan_runs_no_job(spark):
    rules = [random_rule(random.Random(3), i)[0] for i in range(9)]
    df = spark.createDataFrame([(1, "ring", "Public", ["zoo"])], "id int, name string, access string, types array<string>")
    spark.sparkContext.setJobGroup("rules", "plan")
    found = R.categorize(df, rules, **NAMES)
    counted = R.rule_counts(df, rules, **NAMES)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("rules")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 1 and counted.count() == 9
