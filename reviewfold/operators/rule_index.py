"""Categorization with a rule table of any size, as joins.

``rules.categorize`` compiles the rules to one expression, which is right for a list
a person reads. Here the rules stay a table. Names are cut into word n-grams up to
the longest keyword and joined with an inverted index of the keywords; what is
joined are names that hold a keyword of a rule, never all names with all rules. The
first rule is a minimum over the candidates.

A rule that any name satisfies (``ALL``) has no keyword to be found by. With types to
include it is found by them. Without any it holds for everything except where an
excluded type or an unwanted word blocks it: the blocked ones are joined, and the first
that is not among them is the first gap in their sorted ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.functions.text import normalize_name, padded
from reviewfold.operators.rules import ANY_NAME, parse_options
from reviewfold.operators.skew import skew_join

_ATTRIBUTES = ("access_level", "include_types", "exclude_types", "unwanted")
_LEVELS = {"P": "Public", "R": "Restricted"}


def _numbered(rules: DataFrame, strict_prefix: bool) -> DataFrame:
    """Parsed rules that can assign, with ``rule_no`` by priority. The list of rules, not
    the names, is ordered in one place."""
    order = Window.orderBy("category_idx", "rule_idx")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    given = rules.withColumns(
        {
            "rule_no": F.row_number().over(order) - 1,
            "options": F.coalesce("options", F.array().cast("array<string>")),
            "wanted": F.array_distinct(F.filter(words, lambda w: ~w.startswith("-"))),
            "unwanted": F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w.startswith("-")), lambda w: F.substring(w, 2, 1 << 30)))),
        }
    )
    parsed = parse_options(given, strict_prefix)
    level = F.when(F.col("access_level").isin(*_LEVELS), F.col("access_level")).otherwise("")
    parsed = parsed.withColumns({"access_level": level, "any": F.array_contains("wanted", ANY_NAME)})
    return parsed.filter(F.size("wanted") > 0)


def _grams(names: DataFrame, longest: Column) -> DataFrame:
    """``(key, text)``: the distinct word n-grams of every name up to ``longest`` words."""
    words = F.split("_name", " ")
    starts = lambda n: F.sequence(F.lit(1), F.size(words) - n + 1)
    sizes = F.sequence(F.lit(1), F.least(F.col("_longest"), F.size(words)))
    grams = F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(words, i, n), " ")))
    rows = names.filter("_name is not null").withColumn("_longest", F.coalesce(longest, F.lit(1)))
    return rows.select("key", F.explode(F.array_distinct(F.flatten(grams))).alias("text"))


def _n_words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def _types_hold(types: Column, include: Column, exclude: Column) -> Column:
    """The first of the entity's types that the rule lists decides."""
    first = F.get(F.filter(types, lambda t: F.array_contains(include, t) | F.array_contains(exclude, t)), F.lit(0))
    return F.when(first.isNull(), F.size(include) == 0).otherwise(~F.array_contains(exclude, first))


def categorize_by_table(
    df: DataFrame,
    rules: DataFrame,
    key: str,
    name: str = "real.name",
    access: str = "real.accessType",
    types: str = "placeSpecifics.types",
    strict_prefix: bool = True,
) -> DataFrame:
    """Add ``category`` and ``rule_no`` of the first rule that matches, as
    ``rules.categorize`` does; ``key`` identifies a row and is not NULL.

    Building the plan runs no job, and the plan does not grow with the rules. A word
    with many rules of equal options counts once, by the first of them.
    """
    parsed = _numbered(rules, strict_prefix)
    names = df.select(
        F.col(key).alias("key"),
        normalize_name(F.col(name)).alias("_name"),
        F.col(access).alias("_access"),
        F.col(types).alias("_types"),
    )
    same = parsed.groupBy("any", *_ATTRIBUTES)
    default = F.col("any") & (F.size("include_types") == 0)
    by_word = parsed.filter(~F.col("any")).select("rule_no", *_ATTRIBUTES, F.explode("wanted").alias("text"))
    by_word = by_word.groupBy("text", *_ATTRIBUTES).agg(F.min("rule_no").alias("rule_no"))
    by_type = same.agg(F.min("rule_no").alias("rule_no")).filter(F.col("any") & ~default)
    by_type = by_type.select("rule_no", *_ATTRIBUTES, F.explode(F.array_distinct("include_types")).alias("text"))
    # Rules that hold unless blocked, ranked among those of the same lane: their access,
    # and for entities without a name only those that no word can undo.
    open_rules = same.agg(F.min("rule_no").alias("rule_no")).filter(default)
    nameless = F.when(F.size("unwanted") == 0, F.concat("access_level", F.lit("?")))
    open_rules = open_rules.withColumn("lane", F.explode(F.array_compact(F.array("access_level", nameless))))
    within = Window.partitionBy("lane").orderBy("rule_no")
    open_rules = open_rules.withColumn("rank", (F.row_number().over(within) - 1).cast("int"))
    stops = open_rules.select("lane", "rank", F.explode("unwanted").alias("text"))

    keywords = by_word.select("text").unionByName(stops.select("text"))
    grams = _grams(names, keywords.agg(F.max(_n_words(F.col("text")))).scalar())
    listed = names.select("key", F.explode(F.array_distinct("_types")).alias("text"))

    # Candidates by a word or a type, checked against the rest of the rule.
    found = skew_join(grams, by_word, "text").drop("text").unionByName(skew_join(listed, by_type, "text").drop("text"))
    facts = found.join(names, "key")
    level = F.col("access_level")
    admitted = (level == "") | F.coalesce(F.col("_access") == F.when(level == "P", _LEVELS["P"]).otherwise(_LEVELS["R"]), F.lit(False))
    clean = ~F.exists("unwanted", lambda w: padded(F.col("_name")).contains(F.concat(F.lit(" "), w, F.lit(" "))))
    right = admitted & _types_hold(F.col("_types"), F.col("include_types"), F.col("exclude_types"))
    checked = facts.filter(right & clean).groupBy("key").agg(F.min("rule_no").alias("_found"))

    # The first open rule of each of its lanes that no type and no word blocks.
    barred = open_rules.select("lane", "rank", F.explode("exclude_types").alias("text"))
    blocked = skew_join(listed, barred, "text").unionByName(skew_join(grams, stops, "text"))
    gaps = blocked.groupBy("key", "lane").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    gap = F.aggregate("ranks", F.lit(0), lambda at, r: F.when(r == at, at + 1).otherwise(at))
    gaps = gaps.select("key", "lane", gap.alias("rank"))
    own = F.when(F.col("_access") == _LEVELS["P"], "P").when(F.col("_access") == _LEVELS["R"], "R")
    lanes = F.transform(F.array_compact(F.array(F.lit(""), own)), lambda x: F.when(F.col("_name").isNull(), F.concat(x, F.lit("?"))).otherwise(x))
    entered = names.select("key", F.explode(lanes).alias("lane"))
    entered = entered.join(gaps, ["key", "lane"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    opened = skew_join(entered, open_rules.select("lane", "rank", "rule_no"), ["lane", "rank"])
    opened = opened.groupBy("key").agg(F.min("rule_no").alias("_open"))

    first = checked.join(opened, "key", "full").select(F.col("key").alias("__key"), F.least("_found", "_open").alias("rule_no"))
    numbered = df.join(first, F.col(key) == F.col("__key"), "left").drop("__key")
    return skew_join(numbered, parsed.select("rule_no", "category"), "rule_no", "left").select(*df.columns, "rule_no", "category")
