"""Queries for ordered rule categorization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.text import contains_word as has_word
from reviewfold.functions.text import normalize_name as normalized
from reviewfold.functions.text import padded
from reviewfold.operators import rules as R
from reviewfold.operators.rule_index import categorize_by_table
from reviewfold.plans.inputs import RULES, Inputs
from reviewfold.plans.registry import query, text_of
from reviewfold.plans.storage_catalog import loaded_rules

_MATCHED = """
p_named as (
  select *, ' ' || translate(lower(name), '/,', ' ') || ' ' as n from p_records
),
p_rule as (
  select *,
    coalesce(list_contains(types, 'economy'), false) as o0,
    coalesce(access_type = 'Public', false) and coalesce(list_contains(types, 'promo'), false) as o2,
    coalesce(not list_contains(types, 'promo'), true) as o4,
    coalesce(access_type = 'Restricted', false) as o5,
    coalesce(list_contains(types, '_small'), false) as o6,
    coalesce(list_filter(types, lambda x: x in ('brand#1', 'large'))[1] = 'brand#1', false) as o7,
    contains(n, ' blue ') as blue, contains(n, ' ring ') as ring, contains(n, ' hot rod ') as hot_rod,
    contains(n, ' cold ') as cold, contains(n, ' widget ') as widget, contains(n, ' rod ') as rod,
    contains(n, ' gear ') as gear
  from p_named
),
p_first as (
  select *, case
    when o0 and ring and not blue then 0
    when hot_rod then 1
    when o2 then 2
    when o4 and (cold or widget) and not rod then 4
    when o5 and not cold then 5
    when o6 then 6
    when o7 then 7 end as rule_no
  from p_rule
),
p_categorized as (
  select *, case rule_no when 0 then 'Ring Shop' when 1 then 'Ring Shop' when 2 then 'Public Promo'
    when 4 then 'Cold Goods' when 5 then 'Restricted' when 6 then 'Strict Prefix' when 7 then 'By Type' end as category
  from p_first
)
"""


@query(
    "normalize_name",
    "select location_id, translate(lower(name || ', ' || segment || '/' || cost), '/,', ' ') as name from p_locations",
)
def normalize_name(t: Inputs) -> DataFrame:
    raw = F.concat("name", F.lit(", "), "segment", F.lit("/"), "cost")
    return t.locations.select("location_id", normalized(raw).alias("name"))


@query(
    "contains_word",
    "select location_id, contains(' ' || name || ' ', ' ring ') as has_ring, "
    "contains(' ' || name || ' ', ' in ') as has_in, contains(' ' || name || ' ', ' hot rod ') as has_phrase "
    "from p_locations",
)
def contains_word(t: Inputs) -> DataFrame:
    name = F.col("name")
    return t.locations.select(
        "location_id",
        has_word(name, "ring").alias("has_ring"),
        has_word(name, "in").alias("has_in"),
        has_word(name, "hot rod").alias("has_phrase"),
    )


@query(
    "rule_options",
    "select p_brand as category, cast(substr(p_brand, 7) as int) as category_idx, "
    "cast(row_number() over (partition by p_brand order by p_type) - 1 as int) as rule_idx, false as print, "
    "'P' as access_level, lower(p_type) as include_types, 'promo' as exclude_types from part group by p_brand, p_type",
)
def rule_options(t: Inputs) -> DataFrame:
    parsed = R.parse_options(loaded_rules(t))
    return parsed.withColumns({c: text_of(c) for c in ("include_types", "exclude_types")})


@query(
    "type_predicate",
    "select id, coalesce(list_filter(types, lambda x: x in ('brand#1', 'brand#2', 'large'))[1] <> 'large', false) "
    "as included, coalesce(list_filter(types, lambda x: x = 'large')[1] <> 'large', true) as not_excluded "
    "from p_records",
)
def type_predicate(t: Inputs) -> DataFrame:
    types = F.col("placeSpecifics.types")
    return t.records.select(
        "real.id",
        R.type_predicate(types, ["brand#1", "brand#2"], ["large"]).alias("included"),
        R.type_predicate(types, [], ["large"]).alias("not_excluded"),
    )


@query(
    "keyword_predicate",
    "select id, contains(' ' || name || ' ', ' ring ') and not contains(' ' || name || ' ', ' blue ') as matches, "
    "not contains(' ' || name || ' ', ' cold ') as all_but_cold from p_records",
)
def keyword_predicate(t: Inputs) -> DataFrame:
    name = padded(F.col("real.name"))
    return t.records.select(
        "real.id",
        R.keyword_predicate(name, ["ring", "-blue"]).alias("matches"),
        R.keyword_predicate(name, ["-cold", "ALL"]).alias("all_but_cold"),
    )


_FIRST_MATCH = f"with {_MATCHED} select id, name, category, rule_no from p_categorized"


@query("categorize_first_match", _FIRST_MATCH)
def categorize_first_match(t: Inputs) -> DataFrame:
    return R.categorize(t.records, RULES).select("real.id", "real.name", "category", "rule_no")


@query("categorize_indexed", _FIRST_MATCH)
def categorize_indexed(t: Inputs) -> DataFrame:
    """The same rules as a table, found by an inverted index of their keywords."""
    rows = [(r.category, r.category_idx, r.rule_idx, list(r.options), list(r.keywords)) for r in RULES]
    table = t.spark.createDataFrame(rows, R.RULE_TABLE)
    return categorize_by_table(t.records, table, "real.id").select("real.id", "real.name", "category", "rule_no")


@query(
    "categorize_coverage",
    f"with {_MATCHED} select count(category) as assigned, count(*) - count(category) as unassigned from p_categorized",
)
def categorize_coverage(t: Inputs) -> DataFrame:
    return R.coverage(R.categorize(t.records, RULES))


_HITS = {
    0: ("'Ring Shop'", 0, "o0", "case when blue then 0 else ring::int end"),
    1: ("'Ring Shop'", 1, "true", "hot_rod::int"),
    2: ("'Public Promo'", 0, "o2", "1"),
    3: ("'Placeholder'", 0, "true", "0"),
    4: ("'Cold Goods'", 0, "o4", "cold::int + widget::int"),
    5: ("'Restricted'", 0, "o5", "case when cold then 0 else 1 end"),
    6: ("'Strict Prefix'", 0, "o6", "1"),
    7: ("'By Type'", 0, "o7", "1 + gear::int"),
}


@query(
    "rule_match_counts",
    f"with {_MATCHED} "
    + " union all ".join(
        f"select {category} as category, {idx} as rule_idx, count(*) filter (where rule_no = {i}) as assigned, "
        f"cast(sum(case when {options} and coalesce(rule_no >= {i}, true) then {hits} else 0 end) as bigint) as raw_hits "
        "from p_first"
        for i, (category, idx, options, hits) in _HITS.items()
    ),
)
def rule_match_counts(t: Inputs) -> DataFrame:
    return R.rule_counts(t.records, RULES)


@query("category_table", f"with {_MATCHED} select cast(id as int) as location_id, category from p_categorized")
def category_table(t: Inputs) -> DataFrame:
    return R.category_table(R.categorize(t.records, RULES))


@query("category_fallback", f"with {_MATCHED} select id, coalesce(category, poi) as category from p_categorized")
def category_fallback(t: Inputs) -> DataFrame:
    return R.with_fallback(R.categorize(t.records, RULES), "poi").select("real.id", "category")


_FROM_TABLE = """
    with rules as (
      select p_brand, lower(p_type) as wanted, list(distinct split_part(p_name, ' ', 1)) as keywords,
        row_number() over (order by cast(substr(p_brand, 7) as int), p_type) - 1 as rule_no
      from part group by p_brand, p_type
    ), held as (
      select id, rule_no, p_brand from p_records join rules on types[1] = wanted
      where access_type = 'Public' and not coalesce(list_contains(types, 'promo'), false)
        and len(list_filter(keywords, lambda k: contains(' ' || translate(lower(name), '/,', ' ') || ' ', ' ' || k || ' '))) > 0
    ), first_rule as (select id, min(rule_no) as rule_no from held group by id)
    select r.id, cast(f.rule_no as int) as rule_no, h.p_brand as category
    from p_records r left join first_rule f using (id) left join held h on h.id = f.id and h.rule_no = f.rule_no
    """


@query("categorize_from_table", _FROM_TABLE)
def categorize_from_table(t: Inputs) -> DataFrame:
    """From the rule file to the categories: load, parse, categorize."""
    rules = R.rules_of(loaded_rules(t))
    return R.categorize(t.records, rules).select("real.id", "rule_no", "category")


@query("categorize_rule_table", _FROM_TABLE)
def categorize_rule_table(t: Inputs) -> DataFrame:
    """The rules never leave their table: joined by keyword and by type."""
    return categorize_by_table(t.records, loaded_rules(t), "real.id").select("real.id", "rule_no", "category")
