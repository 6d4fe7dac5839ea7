"""Queries for projections, filters, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions import labels as L
from reviewfold.functions import text as T
from reviewfold.operators import filters, joins, projections
from reviewfold.plans.inputs import HOME_STATES, PUBLIC_GROUPS, Inputs
from reviewfold.plans.registry import query

_HOME = ", ".join(f"'{s}'" for s in HOME_STATES)
_PUBLIC = ", ".join(f"'{g}'" for g in PUBLIC_GROUPS)


@query("project_subset", "select location_id, segment, cost from p_locations")
def project_subset(t: Inputs) -> DataFrame:
    return t.locations.select("location_id", "segment", "cost")


@query("project_rename", "select review_id, predicted as predicted_sentiment from p_predictions")
def project_rename(t: Inputs) -> DataFrame:
    return t.predictions.select("review_id", "predicted").withColumnRenamed("predicted", "predicted_sentiment")


@query("project_drop", "select location_id, name, segment, urban_rural, cost, poi_group, access_type from p_locations")
def project_drop(t: Inputs) -> DataFrame:
    return t.locations.drop("state", "owner_raw", "no_such_column")


@query(
    "classify_country",
    f"select location_id, state, case when state in ({_HOME}) then 'USA' else 'CAN' end as country from p_locations",
)
def classify_country(t: Inputs) -> DataFrame:
    out = projections.classify_membership(t.locations, "state", HOME_STATES, "USA", "CAN", "country")
    return out.select("location_id", "state", "country")


@query("fill_ownership", "select location_id, owner_raw, poi_group, owner from p_owned")
def fill_ownership(t: Inputs) -> DataFrame:
    return t.owned.select("location_id", "owner_raw", "poi_group", "owner")


@query(
    "label_area_type",
    "select location_id, urban_rural, case urban_rural when 0 then 'Rural' when 1 then 'Urban Cluster' "
    "when 2 then 'Urban Center' end as title from p_locations",
)
def label_area_type(t: Inputs) -> DataFrame:
    out = projections.case_label(t.locations, "urban_rural", L.AREA_TITLE, None, "title")
    return out.select("location_id", "urban_rural", "title")


@query(
    "recode_groups",
    "select location_id, case poi_group when 'Brand#1' then 'Services' when 'Brand#2' then 'Park' "
    "when 'Other' then 'Shopping Center' else poi_group end as poi_group from p_locations",
)
def recode_groups(t: Inputs) -> DataFrame:
    mapping = {"Brand#1": "Services", "Brand#2": "Park", "Other": "Shopping Center"}
    return projections.recode(t.locations, "poi_group", mapping).select("location_id", "poi_group")


@query(
    "encode_label",
    "select review_key, case predicted when 'NEGATIVE' then 0.0::double when 'POSITIVE' then 1.0::double end as label "
    "from p_reviews",
)
def encode_label(t: Inputs) -> DataFrame:
    lower = t.reviews.withColumn("predicted", F.lower("predicted"))
    return projections.encode_label(lower, "predicted", "label").select("review_key", "label")


@query("decode_label", "select review_id, predicted as decoded from p_predictions")
def decode_label(t: Inputs) -> DataFrame:
    numbers = projections.encode_label(t.predictions, "predicted", "number")
    return projections.decode_label(numbers, "number", "decoded").select("review_id", "decoded")


_RESOLVED = (
    "case when sentiment is not null and predicted <> upper(sentiment) then "
    "case predicted when 'POSITIVE' then 'NEGATIVE' when 'NEGATIVE' then 'POSITIVE' else predicted end "
    "else predicted end"
)


@query(
    "label_override",
    f"select review_id, predicted, sentiment, {_RESOLVED} as best from p_predictions left join p_training "
    "using (review_id)",
)
def label_override(t: Inputs) -> DataFrame:
    joined = joins.join_labels(t.predictions.select("review_id", "predicted"), t.training, "review_id")
    return projections.resolve_label(joined, "predicted", "sentiment", "best")


@query(
    "sentiment_indicator",
    "select review_key, case when predicted = 'POSITIVE' then 1 else 0 end as sentiment_value from p_reviews",
)
def sentiment_indicator(t: Inputs) -> DataFrame:
    out = projections.indicator(t.reviews, "predicted", L.POSITIVE, "sentiment_value")
    return out.select("review_key", "sentiment_value")


@query("filter_not_null", "select location_id, urban_rural from p_locations where urban_rural is not null")
def filter_not_null(t: Inputs) -> DataFrame:
    return filters.not_null(t.locations, "urban_rural").select("location_id", "urban_rural")


@query("filter_equal", "select location_id, cost from p_locations where cost = 'Free'")
def filter_equal(t: Inputs) -> DataFrame:
    return filters.equal(t.locations, "cost", "Free").select("location_id", "cost")


@query("filter_not_equal", "select location_id, poi_group from p_locations where poi_group not in ('Other', 'Unknown')")
def filter_not_equal(t: Inputs) -> DataFrame:
    return filters.exclude(t.locations, "poi_group", "Other", "Unknown").select("location_id", "poi_group")


@query("filter_valid_label", "select review_key, predicted from p_reviews where predicted in ('POSITIVE', 'NEGATIVE')")
def filter_valid_label(t: Inputs) -> DataFrame:
    return filters.valid_labels(t.reviews, "predicted").select("review_key", "predicted")


@query(
    "filter_access_level",
    "select 'P' as level, location_id from p_locations where access_type = 'Public' union all "
    "select 'R', location_id from p_locations where access_type = 'Restricted' union all "
    "select 'any', location_id from p_locations",
)
def filter_access_level(t: Inputs) -> DataFrame:
    parts = [
        filters.access_filter(t.locations, level).select(F.lit(name).alias("level"), "location_id")
        for level, name in (("P", "P"), ("R", "R"), ("", "any"))
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("left_join_labels", "select review_id, predicted, sentiment from p_predictions left join p_training using (review_id)")
def left_join_labels(t: Inputs) -> DataFrame:
    return joins.join_labels(t.predictions.select("review_id", "predicted"), t.training, "review_id")


@query(
    "inner_join_locations",
    "select review_key, location_id, predicted, r.name as name, l.name as name_dim, segment, owner, cost from "
    "(select *, 'review ' || predicted as name from p_reviews) r join p_owned l using (location_id)",
)
def inner_join_locations(t: Inputs) -> DataFrame:
    facts = t.reviews.withColumn("name", F.concat(F.lit("review "), "predicted"))
    dims = t.owned.select(F.col("location_id").alias("id"), "name", "segment", "owner", "cost")
    return joins.join_dimension(facts, dims, "location_id", "id")


@query(
    "null_safe_join",
    "select l.location_id, l.state, g.n_locations from p_locations l join (select state, count(*) as n_locations "
    "from p_locations group by state) g on l.state is not distinct from g.state",
)
def null_safe_join(t: Inputs) -> DataFrame:
    places = t.locations.select("location_id", "state")
    sizes = t.locations.groupBy(F.col("state").alias("code")).agg(F.count(F.lit(1)).alias("n_locations"))
    return joins.join_dimension(places, sizes, "state", "code", null_safe=True)


@query(
    "semi_join_groups",
    "select location_id, poi_group from p_locations where poi_group in (select poi_group from p_locations "
    "where segment = 'ECONOMY' and cost = 'Free')",
)
def semi_join_groups(t: Inputs) -> DataFrame:
    groups = t.locations.filter("segment = 'ECONOMY' and cost = 'Free'")
    return joins.semi_join(t.locations.select("location_id", "poi_group"), groups, "poi_group")


@query(
    "code_name_lookup",
    "select c_custkey, c_nationkey, n_name as nation, n_nationkey as code_again from customer "
    "left join nation on c_nationkey = n_nationkey",
)
def code_name_lookup(t: Inputs) -> DataFrame:
    codes = t.table("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    named = joins.lookup(t.table("customer").select("c_custkey", "c_nationkey"), "c_nationkey", codes, "nation")
    return joins.lookup(named, "nation", codes, "code_again", invert=True)


@query("clean_text", "select review_id, translate(review, '.,?!', '') as review from p_predictions")
def clean_text(t: Inputs) -> DataFrame:
    return t.predictions.select("review_id", T.clean_text(F.col("review")).alias("review"))


@query("text_lower", "select review_id, lower(review) as review from p_predictions")
def text_lower(t: Inputs) -> DataFrame:
    return t.predictions.select("review_id", F.lower("review").alias("review"))


@query("text_upper", "select review_id, upper(sentiment) as sentiment from p_training")
def text_upper(t: Inputs) -> DataFrame:
    return t.training.select("review_id", F.upper("sentiment").alias("sentiment"))


_PASTED = "coalesce(owner, 'NA') || '/' || coalesce(cost, 'NA')"


@query("paste_attrs", f"select location_id, {_PASTED} as owner_cost from p_owned")
def paste_attrs(t: Inputs) -> DataFrame:
    return projections.paste_columns(t.owned, ["owner", "cost"], "owner_cost").select("location_id", "owner_cost")


@query(
    "split_key",
    f"select location_id, split_part({_PASTED}, '/', 1) as owner_part, split_part({_PASTED}, '/', 2) as cost_part "
    "from p_owned",
)
def split_key(t: Inputs) -> DataFrame:
    pasted = projections.paste_columns(t.owned, ["owner", "cost"], "owner_cost")
    split = projections.split_key(pasted, "owner_cost", ["owner_part", "cost_part"])
    return split.select("location_id", "owner_part", "cost_part")


@query(
    "prob_to_class",
    "select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 20.0, 0) as class from lineitem",
)
def prob_to_class(t: Inputs) -> DataFrame:
    """Multiples of 1/20, so halves occur."""
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", T.to_class(F.col("l_quantity") / 20.0).alias("class")
    )


@query(
    "strip_prefix",
    "select location_id, case when starts_with(state, 'Brand#1') then substr(state, 8) else state end as code "
    "from p_locations",
)
def strip_prefix(t: Inputs) -> DataFrame:
    return t.locations.select("location_id", T.strip_prefix(F.col("state"), "Brand#1").alias("code"))


@query(
    "split_pick",
    "select review_id, list_filter(string_split_regex(review, '\\s+'), lambda w: w <> '')[1] as first_token, "
    "list_filter(string_split_regex(review, '\\s+'), lambda w: w <> '')[-1] as last_token from p_predictions",
)
def split_pick(t: Inputs) -> DataFrame:
    review = F.col("review")
    return t.predictions.select(
        "review_id", T.pick(review, 1).alias("first_token"), T.pick(review, -1).alias("last_token")
    )


@query(
    "numeric_cast",
    "select location_id, try_cast(substr(state, 7) as int) as state_number, try_cast(state as int) as not_a_number, "
    "cast(cast(location_id as varchar) as double) as id_value from p_locations",
)
def numeric_cast(t: Inputs) -> DataFrame:
    return t.locations.select(
        "location_id",
        F.substring("state", 7, 9).try_cast("int").alias("state_number"),
        F.col("state").try_cast("int").alias("not_a_number"),
        F.col("location_id").cast("string").cast("double").alias("id_value"),
    )
