"""Queries for sources and sinks. They write to a fresh shared path and read it
back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.operators import inference
from reviewfold.operators.models import binary_metrics
from reviewfold.plans.groups_catalog import P_SEGMENT_TESTS, segment_p_values
from reviewfold.plans.inputs import SEGMENTS, Inputs
from reviewfold.plans.registry import query, text_of
from reviewfold.sources import tables
from reviewfold.storage import new_path

_REVIEW_SCHEMA = "review_id bigint, review string, lang string, predicted string"


@query("csv_roundtrip", "select review_id, review, lang, predicted from p_predictions")
def csv_roundtrip(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "csv")
    tables.write_table(t.predictions, path)
    return tables.read_table(t.spark, path, _REVIEW_SCHEMA, multi_line=True)


@query(
    "csv_latin1",
    "select review_id, regexp_replace(review, '[^\\x00-\\xff]', '?', 'g') as review, lang, predicted "
    "from p_predictions",
)
def csv_latin1(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "latin1")
    tables.write_table(t.predictions, path, encoding="ISO-8859-1")
    return tables.read_table(t.spark, path, _REVIEW_SCHEMA, encoding="ISO-8859-1", multi_line=True)


@query(
    "csv_row_index",
    "select row_number() over (order by review_id) - 1 as row_index, review_id, predicted from p_predictions "
    "qualify lang <> 'de'",
)
def csv_row_index(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "index")
    numbered = t.predictions.select("review_id", "predicted", "lang")
    tables.write_table(
        numbered, path, row_index=True, order_by=[F.col("review_id")], base=0, keep=F.col("lang") != "de"
    )
    read = tables.read_table(t.spark, path, "row_index bigint, review_id bigint, predicted string, lang string")
    return read.drop("lang")


@query(
    "nested_locations",
    "select id, name, access_type, array_to_string(types, ' ') as types, poi from p_records",
)
def nested_locations(t: Inputs) -> DataFrame:
    """Raw records with the sentinel -1, written as JSON lines and read back."""
    path = new_path(t.spark, "records")
    real = F.to_json(F.struct("real"))
    place = F.coalesce(F.to_json("placeSpecifics"), F.lit("-1"))
    poi = F.coalesce(F.concat(F.lit('"'), "poi", F.lit('"')), F.lit("-1"))
    line = F.concat(
        F.regexp_replace(real, r"\}$", ""), F.lit(',"placeSpecifics":'), place, F.lit(',"poi":'), poi, F.lit("}")
    )
    t.records.select(line.alias("value")).write.text(path)
    records = tables.read_locations(t.spark, path)
    return records.select(
        "real.id",
        "real.name",
        F.col("real.accessType").alias("access_type"),
        text_of("placeSpecifics.types").alias("types"),
        "poi",
    )


def derived_rules(t: Inputs) -> DataFrame:
    """A rule list made from the parts: one category per brand, one rule per
    type, with the first words of the names as keywords."""
    words = (
        t.table("part")
        .select("p_brand", "p_type", F.split("p_name", " ")[0].alias("word"))
        .groupBy("p_brand", "p_type")
        .agg(F.sort_array(F.collect_set("word")).alias("keywords"))
    )
    options = F.array(F.concat(F.lit("Gtype_"), F.lower("p_type")), F.lit("Gtype_-promo"), F.lit("pubRstr_P"))
    rules = words.groupBy("p_brand").agg(
        F.sort_array(F.collect_list(F.struct("p_type", options.alias("options"), "keywords"))).alias("_rules")
    )
    return rules.select(
        F.col("p_brand").alias("category"),
        F.substring("p_brand", 7, 9).cast("int").alias("category_idx"),
        F.transform("_rules", lambda r: F.struct(r["options"].alias("options"), r["keywords"].alias("keywords"))).alias(
            "rules"
        ),
    )


def loaded_rules(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "rules")
    derived_rules(t).write.json(path)
    return tables.load_rules(t.spark, path)


@query(
    "rule_table",
    "select p_brand as category, cast(substr(p_brand, 7) as int) as category_idx, "
    "cast(row_number() over (partition by p_brand order by p_type) - 1 as int) as rule_idx, "
    "'Gtype_' || lower(p_type) || ' Gtype_-promo pubRstr_P' as options, "
    "string_agg(distinct split_part(p_name, ' ', 1), ' ' order by split_part(p_name, ' ', 1)) as keywords "
    "from part group by p_brand, p_type",
)
def rule_table(t: Inputs) -> DataFrame:
    return loaded_rules(t).withColumns({"options": text_of("options"), "keywords": text_of("keywords")})


@query(
    "vector_table",
    "select word, unnest(vector) as value, cast(generate_subscripts(vector, 1) - 1 as int) as dim from p_vectors",
)
def vector_table(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "vectors")
    t.vectors(t.vocab()).write.parquet(path)
    return tables.read_vectors(t.spark, path).select("word", F.posexplode("vector").alias("dim", "value"))


@query(
    "append_log",
    "select lang, count(*) as n, sum(case when label = pred then 1.0 else 0.0 end) / count(*) as accuracy "
    "from p_evaluated group by lang, review_id % 2",
)
def append_log(t: Inputs) -> DataFrame:
    """Metrics of two halves of the labelled reviews, appended one by one."""
    path = new_path(t.spark, "log")
    for half in (0, 1):
        part = evaluated(t).filter(F.col("review_id") % 2 == half)
        tables.append_table(binary_metrics(part, "label", "pred", ["lang"]).select("lang", "n", "accuracy"), path)
    return tables.read_table(t.spark, path, "lang string, n bigint, accuracy double", header=False)


def evaluated(t: Inputs) -> DataFrame:
    pred = F.when(F.col("predicted") == "POSITIVE", 1.0).otherwise(0.0)
    return t.labelled.withColumn("pred", pred).select("review_id", "lang", "label", "pred")


@query(
    "report_lines",
    f"with {P_SEGMENT_TESTS} select printf('%s & %.2f & %.2f & %.2f & %.2f & %.2f & %.2f & %d \\\\', segment, "
    "max(mean_x) filter (where owner_group = 'Public'), max(mean_y) filter (where owner_group = 'Public'), "
    "max(p_value) filter (where owner_group = 'Public'), max(mean_x) filter (where owner_group = 'Private'), "
    "max(mean_y) filter (where owner_group = 'Private'), max(p_value) filter (where owner_group = 'Private'), "
    "max(n_rows)) as line from p_tested group by segment",
)
def report_lines(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "report")
    tests = segment_p_values(t, SEGMENTS)
    tables.write_report(inference.format_report(tests, "segment"), path, ["segment"])
    return t.spark.read.text(path).withColumnRenamed("value", "line")
