"""Ordered rule categorization.

Rules are a parameter: a list of ``Rule`` in priority order. They become one
column expression, so categorizing is a narrow map over the entities with no
shuffle, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reviewfold.functions.text import normalize_name, padded

# Option and keyword spellings of a rule.
TYPE_OPTION = "Gtype"
TYPE_PREFIX = "Gtype_"
ACCESS_OPTION = "pubRstr"
ACCESS_PREFIX = "pubRstr_"
PRINT_OPTION = "PRINT"
ANY_NAME = "ALL"

#: Columns of a table of rules.
RULE_TABLE = "category string, category_idx int, rule_idx int, options array<string>, keywords array<string>"

_NAME = "_padded_name"


@dataclass(frozen=True)
class Rule:
    category: str
    category_idx: int
    rule_idx: int
    options: tuple[str, ...]
    keywords: tuple[str, ...]


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of a rule table in priority order. The table is a parameter list a
    person wrote, so it is read to the driver; a NULL list is an empty one."""
    rows = table.orderBy("category_idx", "rule_idx").collect()
    return [Rule(r.category, r.category_idx, r.rule_idx, tuple(r.options or ()), tuple(r.keywords or ())) for r in rows]


def parse_options(rules: DataFrame, strict_prefix: bool = True) -> DataFrame:
    """Print flag, access level and type lists of each rule.

    A type option is cut at the length of its prefix. With ``strict_prefix``
    off, the misspelt plural prefix is cut too instead of staying in the type.
    """
    options = F.col("options")
    is_type = lambda o: o.contains(TYPE_OPTION)
    if strict_prefix:
        cut = lambda o: F.substring(o, len(TYPE_PREFIX) + 1, 1 << 30)
    else:
        cut = lambda o: F.regexp_replace(o, f"^{TYPE_OPTION}s?_", "")
    types = F.transform(F.filter(options, is_type), cut)
    access = F.transform(
        F.filter(options, lambda o: ~is_type(o) & o.contains(ACCESS_OPTION)),
        lambda o: F.substring(o, len(ACCESS_PREFIX) + 1, 1 << 30),
    )
    minus = lambda t: t.startswith("-")
    return rules.select(
        *[c for c in rules.columns if c not in ("options", "keywords")],
        F.array_contains(options, PRINT_OPTION).alias("print"),
        F.coalesce(F.get(F.reverse(access), F.lit(0)), F.lit("")).alias("access_level"),
        F.filter(types, lambda t: ~minus(t)).alias("include_types"),
        F.transform(F.filter(types, minus), lambda t: F.substring(t, 2, 1 << 30)).alias("exclude_types"),
    )


def _parsed(spark: SparkSession, rules: Sequence[Rule], strict_prefix: bool) -> list[Row]:
    """What ``parse_options`` makes of the rules, in their order."""
    if not rules:
        return []
    # A local table: its projection is evaluated by the optimizer, without a job.
    listed = pa.array([list(rule.options) for rule in rules], pa.list_(pa.string()))
    table = spark.createDataFrame(pa.table({"number": pa.array(range(len(rules)), pa.int32()), "options": listed}))
    return sorted(parse_options(table, strict_prefix).collect(), key=lambda row: row.number)


def type_predicate(types: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """The entity's types decide in their own order: the first listed one wins.

    With no hit the result is true only if nothing has to be included.
    """
    listed = [*include, *exclude]
    if not listed:
        return F.lit(True)
    first = F.get(F.filter(types, lambda t: t.isin(listed)), F.lit(0))
    return F.when(first.isNull(), F.lit(not include)).otherwise(~first.isin(list(exclude)) if exclude else F.lit(True))


def access_predicate(access: Column, level: str) -> Column:
    wanted = {"P": "Public", "R": "Restricted"}.get(level)
    return F.lit(True) if wanted is None else F.coalesce(access == wanted, F.lit(False))


def _has(name: Column, word: str) -> Column:
    return name.contains(f" {word} ")


def _either(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def keyword_predicate(padded_name: Column, keywords: Sequence[str]) -> Column:
    """A wanted word occurs and no unwanted one does, in whatever order they are
    listed. ``padded_name`` has a blank on both sides."""
    wanted = [F.lit(True) if k == ANY_NAME else _has(padded_name, k) for k in keywords if not k.startswith("-")]
    unwanted = [_has(padded_name, k[1:]) for k in keywords if k.startswith("-")]
    return _either(wanted) & ~_either(unwanted)


def keyword_hits(padded_name: Column, keywords: Sequence[str]) -> Column:
    """Wanted words found before the first unwanted one that occurs."""
    hits = F.lit(0)
    blocked = F.lit(False)
    for keyword in keywords:
        if keyword.startswith("-"):
            blocked = blocked | _has(padded_name, keyword[1:])
        else:
            found = F.lit(True) if keyword == ANY_NAME else _has(padded_name, keyword)
            hits = hits + F.when(found & ~blocked, 1).otherwise(0)
    return hits


def _options_hold(parsed: Row, types: Column, access: Column) -> Column:
    wanted = type_predicate(types, parsed.include_types, parsed.exclude_types)
    return access_predicate(access, parsed.access_level) & wanted


def categorize(
    df: DataFrame,
    rules: Sequence[Rule],
    name: str = "real.name",
    access: str = "real.accessType",
    types: str = "placeSpecifics.types",
    strict_prefix: bool = True,
) -> DataFrame:
    """Add ``category`` and ``rule_no`` of the first rule that matches.

    ``rule_no`` is the position of the rule in the list; both are NULL where no
    rule matches.
    """
    with_name = df.withColumn(_NAME, padded(normalize_name(F.col(name))))
    parsed = _parsed(df.sparkSession, rules, strict_prefix)
    chain = None
    for number, rule in enumerate(rules):
        if all(k.startswith("-") for k in rule.keywords):
            continue  # no wanted word: the rule can never assign
        options = _options_hold(parsed[number], F.col(types), F.col(access))
        matches = options & keyword_predicate(F.col(_NAME), rule.keywords)
        chain = F.when(matches, F.lit(number)) if chain is None else chain.when(matches, F.lit(number))
    numbered = with_name.withColumn("rule_no", F.lit(None).cast("int") if chain is None else chain)
    names = F.array(*[F.lit(rule.category) for rule in rules]) if rules else F.array().cast("array<string>")
    return numbered.withColumn("category", F.get(names, F.col("rule_no"))).drop(_NAME)


def coverage(df: DataFrame, category: str = "category") -> DataFrame:
    return df.agg(
        F.count(category).alias("assigned"),
        F.count(F.when(F.col(category).isNull(), 1)).alias("unassigned"),
    )


def rule_counts(
    df: DataFrame,
    rules: Sequence[Rule],
    name: str = "real.name",
    access: str = "real.accessType",
    types: str = "placeSpecifics.types",
    strict_prefix: bool = True,
) -> DataFrame:
    """Entities assigned by each rule, and raw keyword hits of each rule.

    Raw hits count every wanted word found in entities no earlier rule had
    assigned, also where an unwanted word undoes the match. All rules are
    counted in one scan.
    """
    done = categorize(df, rules, name, access, types, strict_prefix).withColumn(
        _NAME, padded(normalize_name(F.col(name)))
    )
    parsed = _parsed(df.sparkSession, rules, strict_prefix)
    open_to = lambda i: F.col("rule_no").isNull() | (F.col("rule_no") >= i)
    sums = []
    for i, rule in enumerate(rules):
        eligible = open_to(i) & _options_hold(parsed[i], F.col(types), F.col(access))
        hits = F.when(eligible, keyword_hits(F.col(_NAME), rule.keywords)).otherwise(0)
        sums.append(F.count(F.when(F.col("rule_no") == i, 1)).alias(f"_assigned_{i}"))
        sums.append(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias(f"_hits_{i}"))
    lines = [
        F.struct(
            F.lit(rule.category).alias("category"),
            F.lit(rule.rule_idx).alias("rule_idx"),
            F.col(f"_assigned_{i}").alias("assigned"),
            F.col(f"_hits_{i}").alias("raw_hits"),
        )
        for i, rule in enumerate(rules)
    ]
    return done.agg(*sums).select(F.inline(F.array(*lines)))


def category_table(df: DataFrame, entity: str = "real.id", category: str = "category") -> DataFrame:
    return df.select(F.col(entity).cast("int").alias("location_id"), F.col(category).alias("category"))


def with_fallback(df: DataFrame, fallback_col: str, category: str = "category") -> DataFrame:
    """Use a second category where no rule assigned one."""
    return df.withColumn(category, F.coalesce(F.col(category), F.col(fallback_col)))
