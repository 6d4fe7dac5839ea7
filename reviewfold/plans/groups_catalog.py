"""Queries for aggregates, per-row group figures, orders and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions.distributions import t_cdf
from reviewfold.functions.text import sequence_tokens
from reviewfold.operators import aggregates as A
from reviewfold.operators import filters, inference, joins
from reviewfold.operators import windows as W
from reviewfold.operators.models import binary_metrics, summarize_runs
from reviewfold.operators.projections import paste_columns
from reviewfold.plans.inputs import SEGMENTS, Inputs
from reviewfold.plans.registry import query, rounded

_STEPS = 4000
_WELCH_FIELDS = ("t", "df", "mean_x", "mean_y")


def welch_sql(source: str, extra: str = "") -> str:
    """Welch formulas over moments (n, mean, var) of the groups x and y."""
    inner = (
        f"select {extra} n_x, n_y, mean_x, mean_y, case when n_x < 2 or n_y < 2 then 'not enough observations' end "
        "as reason, (mean_x - mean_y) / sqrt(var_x / n_x + var_y / n_y) as t, "
        "pow(var_x / n_x + var_y / n_y, 2) / (pow(var_x / n_x, 2) / (n_x - 1) + pow(var_y / n_y, 2) / (n_y - 1)) as df "
        f"from {source}"
    )
    return inner


def p_value_sql(source: str, keys: str) -> str:
    """Two-sided t p-value by Simpson's rule over the density."""
    return (
        f"select {keys}, 1 - 2 * max(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df)) "
        f"* max(abs(t)) / {_STEPS} / 3 * sum((case when k in (0, {_STEPS}) then 1 when k % 2 = 1 then 4 else 2 end) "
        f"* pow(1 + pow(abs(t) * k / {_STEPS}, 2) / df, -(df + 1) / 2)) as p_value "
        f"from {source}, range({_STEPS} + 1) steps(k) group by {keys}"
    )


def moments_sql(condition: str, side: str, value: str = "prob") -> str:
    return (
        f"count({value}) filter (where {condition}) as n_{side}, avg({value}) filter (where {condition}) as mean_{side}, "
        f"var_samp({value}) filter (where {condition}) as var_{side}"
    )


# --- counts and tables -------------------------------------------------------


@query(
    "count_by_group",
    "select urban_rural, count(*) as n from p_joined where urban_rural is not null group by urban_rural",
)
def count_by_group(t: Inputs) -> DataFrame:
    counts = filters.not_null(t.located_counts, "urban_rural")
    return counts.groupBy("urban_rural").agg(F.sum("n_all").alias("n"))


def _usable(df: DataFrame) -> DataFrame:
    return filters.exclude(df, "poi_group", "Other", "Unknown")


_FILTERED = {
    f"{owner.lower()}{'_' + cost.lower() if cost else ''}_{label[:3].lower()}": (owner, cost, label)
    for owner in ("Public", "Private")
    for label in ("POSITIVE", "NEGATIVE")
    for cost in (None, "Free", "Paid")
}


@query(
    "filtered_counts",
    "select "
    + ", ".join(
        f"count(*) filter (where owner = '{o}' and predicted = '{p}'" + (f" and cost = '{c}'" if c else "") + f") as {n}"
        for n, (o, c, p) in _FILTERED.items()
    )
    + " from p_joined where poi_group not in ('Other', 'Unknown')",
)
def filtered_counts(t: Inputs) -> DataFrame:
    """Twelve filtered counts in one pass over the reviews."""
    conditions = {}
    for name, (owner, cost, label) in _FILTERED.items():
        condition = (F.col("owner") == owner) & (F.col("predicted") == label)
        conditions[name] = condition if cost is None else condition & (F.col("cost") == cost)
    return A.count_where(_usable(t.label_totals), conditions, weight="n_reviews")


def _crosstab_sql(columns: dict[str, str], where: str) -> str:
    cells = ", ".join(f'count(*) filter (where {c}) as "{title}"' for title, c in columns.items())
    kept = " or ".join(columns.values())
    return (
        f"select case when grouping(predicted) = 1 then 'Total' else predicted end as predicted, {cells}, "
        f'count(*) as "Total" from p_joined where predicted in (\'POSITIVE\', \'NEGATIVE\') and ({kept}) {where} '
        "group by rollup(predicted)"
    )


_LABELS = ["POSITIVE", "NEGATIVE"]
_USABLE_SQL = "and poi_group not in ('Other', 'Unknown')"


@query(
    "crosstab_area",
    _crosstab_sql({"Rural": "urban_rural = 0", "Urban Cluster": "urban_rural = 1", "Urban Center": "urban_rural = 2"}, ""),
)
def crosstab_area(t: Inputs) -> DataFrame:
    levels = {"Rural": 0, "Urban Cluster": 1, "Urban Center": 2}
    return A.crosstab_margins(t.label_totals, "predicted", _LABELS, "urban_rural", levels, "n_reviews")


@query("crosstab_owner", _crosstab_sql({"Public": "owner = 'Public'", "Private": "owner = 'Private'"}, _USABLE_SQL))
def crosstab_owner(t: Inputs) -> DataFrame:
    levels = {"Public": "Public", "Private": "Private"}
    return A.crosstab_margins(_usable(t.label_totals), "predicted", _LABELS, "owner", levels, "n_reviews")


_OWNER_COST = {f"{o}-{c}": (o, c) for o in ("Public", "Private") for c in ("Free", "Paid")}


@query(
    "crosstab_owner_cost",
    _crosstab_sql({k: f"(owner = '{o}' and cost = '{c}')" for k, (o, c) in _OWNER_COST.items()}, _USABLE_SQL),
)
def crosstab_owner_cost(t: Inputs) -> DataFrame:
    return A.crosstab_margins(
        _usable(t.label_totals), "predicted", _LABELS, ["owner", "cost"], _OWNER_COST, "n_reviews"
    )


@query("entity_rate", "select location_id, segment, owner, cost, n, round(prob, 6) as prob from p_rates")
def entity_rate(t: Inputs) -> DataFrame:
    rates = A.entity_rate(t.reviews, "location_id", "predicted")
    located = joins.join_dimension(
        rates, t.owned.select("location_id", "segment", "owner", "cost"), "location_id", "location_id", salts=1
    )
    return rounded(located, "prob")


@query(
    "group_summary",
    "select poi_group, count(*) as n, round(avg(prob), 6) as mean, round(stddev_samp(prob), 6) as std_dev "
    "from p_rates where poi_group not in ('Other', 'Unknown') group by poi_group",
)
def group_summary(t: Inputs) -> DataFrame:
    return rounded(A.group_summary(_usable(t.rates), "poi_group", "prob"), "mean", "std_dev")


@query(
    "mean_se",
    "select owner, cost, count(*) as n, round(avg(prob), 6) as mean, "
    "round(stddev_samp(prob) / sqrt(count(*)), 6) as std_err from p_owner_rates group by owner, cost",
)
def mean_se(t: Inputs) -> DataFrame:
    stats = A.mean_ci(t.owner_rates, ["owner", "cost"], "prob")
    return rounded(stats.select("owner", "cost", "n", "mean", "std_err"), "mean", "std_err")


# The 0.975 quantile of t by bisection over Simpson's rule; for one degree of
# freedom or more it lies below 16.
_HALF_TAIL = (
    "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * ((lo + hi) / 2) / 2000 / 3 * list_sum(list_transform("
    "range(0, 2001), lambda k: (case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end) "
    "* pow(1 + pow((lo + hi) / 2 * k / 2000, 2) / df, -(df + 1) / 2)))"
)


@query(
    "mean_ci",
    "with recursive p_stats as (select urban_rural, count(prob) as n, avg(prob) as mean, "
    "stddev_samp(prob) / sqrt(count(prob)) as std_err from p_rates where urban_rural is not null group by urban_rural), "
    "p_search as (select urban_rural, (n - 1)::double as df, 0::double as lo, 16::double as hi, 0 as step from p_stats "
    f"where n > 1 union all select urban_rural, df, case when {_HALF_TAIL} < 0.475 then (lo + hi) / 2 else lo end, "
    f"case when {_HALF_TAIL} < 0.475 then hi else (lo + hi) / 2 end, step + 1 from p_search where step < 48) "
    "select urban_rural, n, round(mean, 6) as mean, round(mean - lo * std_err, 6) as low_ci, "
    "round(mean + lo * std_err, 6) as high_ci, round(std_err, 6) as std_err "
    "from p_stats left join (select * from p_search where step = 48) using (urban_rural)",
)
def mean_ci(t: Inputs) -> DataFrame:
    return rounded(A.mean_ci(filters.not_null(t.rates, "urban_rural"), "urban_rural", "prob"), "mean", "low_ci", "high_ci", "std_err")


@query(
    "six_number_summary",
    "select min(prob) as min, round(quantile_cont(prob, 0.25), 6) as q1, round(quantile_cont(prob, 0.5), 6) as median, "
    "round(avg(prob), 6) as mean, round(quantile_cont(prob, 0.75), 6) as q3, max(prob) as max from p_rates "
    "where urban_rural is not null",
)
def six_number_summary(t: Inputs) -> DataFrame:
    summary = A.six_number_summary(filters.not_null(t.rates, "urban_rural"), "prob")
    return rounded(summary, "q1", "median", "mean", "q3")


@query(
    "quantiles",
    " union all ".join(
        f"select {p}::double as prob, round(quantile_cont(l_extendedprice, {p}), 6) as value from lineitem"
        for p in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
)
def quantiles(t: Inputs) -> DataFrame:
    return rounded(A.quantiles(t.table("lineitem"), "l_extendedprice", (0.05, 0.25, 0.5, 0.75, 0.95)), "value")


@query(
    "histogram",
    "with bins as (select owner, cast(greatest(1, ceil(round(prob / 0.05, 9))) as int) as bin from p_owner_rates), "
    "grid as (select owner, cast(bin as int) as bin from (values ('Public'), ('Private')) o(owner), "
    "range(1, 21) b(bin)) "
    "select grid.owner, grid.bin, round(0.05 * grid.bin, 9)::double as upper_edge, count(bins.bin) as n from grid left join bins "
    "using (owner, bin) group by all",
)
def histogram(t: Inputs) -> DataFrame:
    return A.histogram(t.owner_rates, "prob", 0.05, 0.0, 1.0, "owner", ["Public", "Private"])


@query(
    "run_summary",
    "with runs as (select review_id % 10 as run, avg(case when label = pred then 1.0 else 0.0 end) as accuracy, "
    "sum(label * pred) / greatest(sum(pred), 1) as p, sum(label * pred) / greatest(sum(label), 1) as r "
    "from p_evaluated group by run), scores as (select *, 2 * p * r / nullif(p + r, 0) as f1 from runs) "
    "select 'accuracy' as metric, round(avg(accuracy), 6) as mean, round(min(accuracy), 6) as min, "
    "round(max(accuracy), 6) as max, round(stddev_pop(accuracy), 6) as std_pop from scores union all "
    "select 'f1', round(avg(f1), 6), round(min(f1), 6), round(max(f1), 6), round(stddev_pop(f1), 6) from scores",
)
def run_summary(t: Inputs) -> DataFrame:
    pred = F.when(F.col("predicted") == "POSITIVE", 1.0).otherwise(0.0)
    tagged = t.labelled.withColumn("pred", pred).withColumn("run", F.col("review_id") % 10)
    runs = binary_metrics(tagged, "label", "pred", ["run"])
    return rounded(summarize_runs(runs), "mean", "min", "max", "std_pop")


@query(
    "corpus_stats",
    "select count(*) as n_texts, max(len(tokens)) as max_tokens, cast(sum(len(tokens)) as bigint) as n_tokens "
    "from p_tokens",
)
def corpus_stats(t: Inputs) -> DataFrame:
    return A.corpus_stats(t.predictions, sequence_tokens(F.lower(F.translate("review", ".,?!", ""))))


# --- figures per row, orders, top-k ------------------------------------------


@query(
    "window_count",
    "select review_key, location_id, count(*) over (partition by location_id) as count from p_reviews",
)
def window_count(t: Inputs) -> DataFrame:
    return W.with_group_count(t.reviews.select("review_key", "location_id"), "location_id")


@query(
    "window_rate",
    "select review_key, location_id, round(1.0 - sum(case when predicted = 'POSITIVE' then 1 else 0 end) "
    "over (partition by location_id)::double / count(*) over (partition by location_id), 6) as prob "
    "from p_reviews where predicted in ('POSITIVE', 'NEGATIVE')",
)
def window_rate(t: Inputs) -> DataFrame:
    valid = filters.valid_labels(t.reviews, "predicted")
    return rounded(W.with_group_rate(valid, "location_id", "predicted").drop("predicted"), "prob")


@query(
    "segment_count",
    "select review_key, segment, count(*) over (partition by segment) as count from p_joined",
)
def segment_count(t: Inputs) -> DataFrame:
    located = joins.join_dimension(t.reviews, t.locations.select("location_id", "segment"), "location_id", "location_id")
    return W.with_segment_count(located.select("review_key", "segment"), "segment")


@query(
    "first_per_key",
    "select review_key, location_id, predicted from p_reviews "
    "qualify row_number() over (partition by location_id order by review_key) = 1",
)
def first_per_key(t: Inputs) -> DataFrame:
    return W.first_per_key(t.reviews, "location_id", "review_key")


@query(
    "distinct_rates",
    "select distinct owner, cost, location_id, round(prob, 6) as prob from p_rates where owner in ('Public', 'Private')",
)
def distinct_rates(t: Inputs) -> DataFrame:
    """Distinct pairs of location and rate in all four cells."""
    cells = t.rates.filter(F.col("owner").isin("Public", "Private")).select("owner", "cost", "location_id", "prob")
    return rounded(cells.distinct(), "prob")


@query("segment_constant", "select segment, count(*) as count from p_joined group by segment")
def segment_constant(t: Inputs) -> DataFrame:
    totals = t.located_counts.groupBy("segment").agg(F.sum("n_all").alias("count"))
    return W.segment_constant(totals, "segment", "count", "count")


@query(
    "rank_categories",
    "select poi_group, round(mean, 6) as mean, row_number() over (order by round(mean, 9) desc, poi_group) as rank from "
    "(select poi_group, avg(prob) as mean from p_rates where poi_group is not null group by poi_group)",
)
def rank_categories(t: Inputs) -> DataFrame:
    means = A.group_summary(filters.not_null(t.rates, "poi_group"), "poi_group", "prob")
    ranked = W.rank_categories(rounded(means, "mean", digits=9).select("poi_group", "mean"), "mean", "poi_group")
    return rounded(ranked, "mean")


@query(
    "order_by_list",
    "select segment, count(*) as n, 7 - list_position(['STANDARD', 'PROMO', 'LARGE', 'SMALL', 'ECONOMY', 'MEDIUM'], "
    "segment) as ordinal from p_locations group by segment",
)
def order_by_list(t: Inputs) -> DataFrame:
    return W.order_by_list(A.count_by(t.locations, "segment"), "segment", SEGMENTS, reverse=True)


@query(
    "top_segments",
    "with sizes as (select segment as region, state, count(*) as n from p_joined where state is not null group by all) "
    "select region, state, n, cast(row_number() over (partition by region order by n desc, state) as int) as rank "
    "from sizes qualify rank <= 2 union all "
    "select 'all', state, cast(sum(n) as bigint) as n, "
    "cast(row_number() over (order by sum(n) desc, state) as int) as rank from sizes group by state qualify rank <= 5",
)
def top_segments(t: Inputs) -> DataFrame:
    sized = t.located_counts.withColumnRenamed("segment", "region")
    n = F.col("n_all")
    regional = W.top_segments(sized, "state", 2, within="region", n=n)
    overall = W.top_segments(sized, "state", 5, n=n).withColumn("region", F.lit("all"))
    return regional.unionByName(overall)


# --- inference ---------------------------------------------------------------

_OWNER_MOMENTS = (
    f"p_owner_moments as (select {moments_sql('owner = ' + repr('Public'), 'x')}, "
    f"{moments_sql('owner = ' + repr('Private'), 'y')} from p_owner_rates)"
)


@query(
    "welch_stat",
    f"with {_OWNER_MOMENTS} select round(t, 6) as t, round(df, 6) as df, round(mean_x, 6) as mean_x, "
    f"round(mean_y, 6) as mean_y, n_x, n_y, reason from ({welch_sql('p_owner_moments')})",
)
def welch_stat(t: Inputs) -> DataFrame:
    return rounded(
        inference.welch_test(t.owner_rates, "prob", "owner", "Public", "Private", p_value=False), *_WELCH_FIELDS
    )


@query(
    "welch_p",
    f"with {_OWNER_MOMENTS}, p_welch as ({welch_sql('p_owner_moments')}) "
    f"select round(p_value, 6) as p_value, n_x, n_y from ({p_value_sql('p_welch', 'n_x, n_y')})",
)
def welch_p(t: Inputs) -> DataFrame:
    tested = inference.welch_test(t.owner_rates, "prob", "owner", "Public", "Private")
    return rounded(tested.select("p_value", "n_x", "n_y"), "p_value")


_PAIRS = [
    ("Public/Free", "Public/Paid"),
    ("Private/Free", "Private/Paid"),
    ("Public/Free", "Private/Free"),
    ("Public/Paid", "Private/Paid"),
]
_PAIR_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)


@query(
    "welch_pairwise",
    "with p_cells as (select owner || '/' || cost as g, count(*) as n, avg(prob) as mean, var_samp(prob) as var "
    "from p_owner_rates group by g), p_pairs as (select group_x, group_y, x.n as n_x, x.mean as mean_x, x.var as var_x, "
    f"y.n as n_y, y.mean as mean_y, y.var as var_y from (values {_PAIR_VALUES}) p(group_x, group_y) "
    f"join p_cells x on x.g = group_x join p_cells y on y.g = group_y), p_welch as ({welch_sql('p_pairs', 'group_x, group_y,')}), "
    f"p_tail as ({p_value_sql('p_welch', 'group_x, group_y')}) "
    "select group_x, group_y, round(t, 6) as t, round(df, 6) as df, round(mean_x, 6) as mean_x, "
    "round(mean_y, 6) as mean_y, n_x, n_y, reason, round(p_value, 6) as p_value from p_welch join p_tail "
    "using (group_x, group_y)",
)
def welch_pairwise(t: Inputs) -> DataFrame:
    cells = paste_columns(t.owner_rates, ["owner", "cost"], "cell")
    return rounded(inference.welch_pairwise(cells, "prob", "cell", _PAIRS), *_WELCH_FIELDS, "p_value")


_AREAS = [(0, 1), (0, 2), (1, 2)]
_AREA_VALUES = ", ".join(f"({a}, {b})" for a, b in _AREAS)


@query(
    "welch_areas",
    "with p_cells as (select urban_rural as g, count(*) as n, avg(prob) as mean, var_samp(prob) as var "
    "from p_rates where urban_rural is not null group by g), p_pairs as (select group_x, group_y, x.n as n_x, "
    "x.mean as mean_x, x.var as var_x, y.n as n_y, y.mean as mean_y, y.var as var_y "
    f"from (values {_AREA_VALUES}) p(group_x, group_y) join p_cells x on x.g = group_x join p_cells y on y.g = group_y), "
    f"p_welch as ({welch_sql('p_pairs', 'group_x, group_y,')}), "
    f"p_tail as ({p_value_sql('p_welch', 'group_x, group_y')}) "
    "select cast(group_x as varchar) as group_x, cast(group_y as varchar) as group_y, round(t, 6) as t, round(df, 6) as df, "
    "round(mean_x, 6) as mean_x, round(mean_y, 6) as mean_y, n_x, n_y, reason, round(p_value, 6) as p_value "
    "from p_welch join p_tail using (group_x, group_y)",
)
def welch_areas(t: Inputs) -> DataFrame:
    """The three kinds of area against one another."""
    named = t.rates.filter(F.col("urban_rural").isNotNull()).withColumn("area", F.col("urban_rural").cast("string"))
    pairs = [(str(a), str(b)) for a, b in _AREAS]
    return rounded(inference.welch_pairwise(named, "prob", "area", pairs), *_WELCH_FIELDS, "p_value")


P_SEGMENT_TESTS = (
    "p_sizes as (select segment, count(*) as n_rows from p_joined where owner is not null "
    "and poi_group not in ('Other', 'Unknown') group by segment), "
    "p_segment_moments as (select segment, owner as owner_group, "
    f"{moments_sql('cost = ' + repr('Free'), 'x')}, {moments_sql('cost = ' + repr('Paid'), 'y')} "
    "from p_owner_rates group by segment, owner), "
    f"p_welch as ({welch_sql('p_segment_moments', 'segment, owner_group,')}), "
    f"p_tail as ({p_value_sql('p_welch', 'segment, owner_group')}), "
    "p_tested as (select * from p_welch join p_tail using (segment, owner_group) join p_sizes using (segment))"
)


def segment_p_values(t: Inputs, segments: list[str] | None) -> DataFrame:
    usable = _usable(filters.not_null(t.located_counts, "owner"))
    return inference.segment_tests(
        usable, "segment", "owner", "cost", "location_id", "predicted", segments, counted=True
    )


@query(
    "segment_tests",
    f"with {P_SEGMENT_TESTS} select segment, owner_group, n_rows, round(t, 6) as t, round(df, 6) as df, "
    "round(mean_x, 6) as mean_x, round(mean_y, 6) as mean_y, n_x, n_y, reason, round(p_value, 6) as p_value "
    "from p_tested",
)
def segment_tests(t: Inputs) -> DataFrame:
    return rounded(segment_p_values(t, None), *_WELCH_FIELDS, "p_value")


@query(
    "segment_report",
    f"with {P_SEGMENT_TESTS} select segment, printf('%s & %.2f & %.2f & %.2f & %.2f & %.2f & %.2f & %d \\\\', "
    "'Segment ' || segment, "
    "max(mean_x) filter (where owner_group = 'Public'), max(mean_y) filter (where owner_group = 'Public'), "
    "max(p_value) filter (where owner_group = 'Public'), max(mean_x) filter (where owner_group = 'Private'), "
    "max(mean_y) filter (where owner_group = 'Private'), max(p_value) filter (where owner_group = 'Private'), "
    "max(n_rows)) as line from p_tested group by segment",
)
def segment_report(t: Inputs) -> DataFrame:
    names = {s: f"Segment {s}" for s in SEGMENTS}
    return inference.format_report(segment_p_values(t, None), "segment", names)


_KS = (
    "with p_ranks as (select prob, count(*) filter (where owner = 'Private') as a, "
    "count(*) filter (where owner = 'Public') as b from p_owner_rates group by prob), "
    "p_steps as (select sum(a) over (order by prob)::double / sum(a) over () as fa, "
    "sum(b) over (order by prob)::double / sum(b) over () as fb, sum(a) over () as n_x, sum(b) over () as n_y from p_ranks), "
    "p_gap as (select max(abs(fa - fb)) as d, cast(max(n_x) as bigint) as n_x, cast(max(n_y) as bigint) as n_y from p_steps)"
)


@query("ks_stat", f"{_KS} select round(d, 6) as d, n_x, n_y from p_gap")
def ks_stat(t: Inputs) -> DataFrame:
    return rounded(inference.ks_two_sample(t.owner_rates, "prob", "owner", "Private", "Public").drop("p_value"), "d")


@query(
    "ks_p",
    f"{_KS}, p_x as (select d * sqrt(n_x * n_y / (n_x + n_y)::double) as x from p_gap) "
    "select round(case when max(x) >= 1 then 2 * sum((case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * x * x)) "
    "else 1 - sqrt(2 * pi()) / max(x) * sum(exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * x * x))) end, 6) as p_value "
    "from p_x, range(1, 101) terms(k)",
)
def ks_p(t: Inputs) -> DataFrame:
    tested = inference.ks_two_sample(t.owner_rates, "prob", "owner", "Private", "Public")
    return rounded(tested.select("p_value"), "p_value")


_TIERS = (
    "p_means as (select poi_group, count(*) as count_locations, avg(prob) as mean, stddev_samp(prob) as std_dev "
    "from p_rates where poi_group not in ('Other', 'Unknown') group by poi_group), "
    "p_tiers as (select *, case when mean < (select quantile_cont(mean, 0.25) from p_means) then 'Low' "
    "when mean > (select quantile_cont(mean, 0.75) from p_means) then 'High' else 'Mid' end as tier from p_means)"
)


def _tiers(t: Inputs) -> DataFrame:
    return inference.tier_groups(_usable(t.rates), "poi_group", "prob")


@query(
    "tier_groups",
    f"with {_TIERS} select poi_group, count_locations, round(mean, 6) as mean, round(std_dev, 6) as std_dev, tier "
    "from p_tiers",
)
def tier_groups(t: Inputs) -> DataFrame:
    return rounded(_tiers(t), "mean", "std_dev")


@query(
    "tier_display",
    f"with {_TIERS} select poi_group, tier, case tier when 'Low' then 'High (< 25th percentile)' "
    "when 'Mid' then 'Mid (25-75th percentile)' else 'Low (> 75th percentile)' end as tier_display, "
    "case tier when 'Low' then 1 when 'Mid' then 2 else 3 end as tier_display_ordinal from p_tiers",
)
def tier_display(t: Inputs) -> DataFrame:
    return inference.display_tiers(_tiers(t)).select("poi_group", "tier", "tier_display", "tier_display_ordinal")


@query(
    "attach_tier",
    f"with {_TIERS} select location_id, poi_group, round(prob, 6) as prob, coalesce(tier, 'Mid') as tier "
    "from p_rates left join p_tiers using (poi_group)",
)
def attach_tier(t: Inputs) -> DataFrame:
    rates = t.rates.select("location_id", "poi_group", "prob")
    return rounded(joins.attach_tier(rates, _tiers(t), "poi_group"), "prob")


_TIER_PAIRS = [("Low", "Mid"), ("Low", "High"), ("Mid", "High")]
_TIER_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _TIER_PAIRS)


@query(
    "welch_tiers",
    f"with {_TIERS}, p_tiered as (select prob, coalesce(tier, 'Mid') as g from p_rates left join p_tiers using (poi_group)), "
    "p_cells as (select g, count(*) as n, avg(prob) as mean, var_samp(prob) as var from p_tiered group by g), "
    "p_pairs as (select group_x, group_y, x.n as n_x, x.mean as mean_x, x.var as var_x, y.n as n_y, y.mean as mean_y, "
    f"y.var as var_y from (values {_TIER_VALUES}) p(group_x, group_y) "
    f"join p_cells x on x.g = group_x join p_cells y on y.g = group_y), p_welch as ({welch_sql('p_pairs', 'group_x, group_y,')}), "
    f"p_tail as ({p_value_sql('p_welch', 'group_x, group_y')}) "
    "select group_x, group_y, round(t, 6) as t, round(df, 6) as df, round(mean_x, 6) as mean_x, "
    "round(mean_y, 6) as mean_y, n_x, n_y, reason, round(p_value, 6) as p_value from p_welch join p_tail "
    "using (group_x, group_y)",
)
def welch_tiers(t: Inputs) -> DataFrame:
    """The three tiers against one another."""
    tiered = joins.attach_tier(t.rates.select("location_id", "poi_group", "prob"), _tiers(t), "poi_group")
    return rounded(inference.welch_pairwise(tiered, "prob", "tier", _TIER_PAIRS), *_WELCH_FIELDS, "p_value")


@query(
    "student_t",
    f"with {P_SEGMENT_TESTS} select segment, owner_group, round(case when t > 0 then 1 - p_value / 2 "
    "else p_value / 2 end, 6) as cdf from p_tested",
)
def student_t(t: Inputs) -> DataFrame:
    tests = segment_p_values(t, None).select("segment", "owner_group", t_cdf("t", "df").alias("cdf"))
    return rounded(tests, "cdf")
