"""Study inputs derived from the star-schema test tables.

Each proxy is a list of SQL expressions that mean the same in Spark and DuckDB;
the oracle texts use the same expressions as common table expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewfold.functions.text import SEQUENCE_FILTERS, clean_text, sequence_tokens
from reviewfold.operators.aggregates import count_by, label_counts, rate_column
from reviewfold.operators.joins import join_dimension
from reviewfold.operators.layout import spread
from reviewfold.operators.projections import fill_from_group
from reviewfold.operators.rules import Rule
from reviewfold.operators.split import holdout_split
from reviewfold.operators.vocabulary import build_vocab

DIMS = 64
TEST_SIZE = 0.2
SEED = 22

LOCATION = {
    "location_id": "p_partkey",
    "name": "p_name",
    "segment": "p_type",
    "urban_rural": "case when p_size % 4 = 3 then null else p_size % 4 end",
    "cost": "case when p_partkey % 2 = 0 then 'Free' else 'Paid' end",
    "owner_raw": "case p_partkey % 5 when 0 then 'Public' when 1 then 'Private' end",
    "poi_group": "case p_brand when 'Brand#23' then null when 'Brand#24' then 'Other' "
    "when 'Brand#25' then 'Unknown' else p_brand end",
    "state": "nullif(p_brand, 'Brand#22')",
    "access_type": "case p_partkey % 3 when 0 then 'Public' when 1 then 'Restricted' end",
}
REVIEW = {
    "review_key": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_shipdate as date) as string))",
    "location_id": "l_partkey",
    "predicted": "case l_returnflag when 'N' then 'POSITIVE' when 'R' then 'NEGATIVE' else 'NEUTRAL' end",
}
PREDICTION = {
    "review_id": "doc_id",
    "review": "text",
    "lang": "lang",
    "predicted": "case when n_chars % 2 = 0 then 'POSITIVE' else 'NEGATIVE' end",
}
TRAINING = {"review_id": "doc_id", "sentiment": "case quality when 1 then 'positive' else 'negative' end"}

PUBLIC_GROUPS = [f"Brand#{i}" for i in range(1, 8)]
HOME_STATES = [f"Brand#{i}" for i in range(1, 16)]
SEGMENTS = ["STANDARD", "PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM"]
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "le", "la", "de", "der", "und", "el")
RULES = [
    Rule("Ring Shop", 0, 0, ("Gtype_economy",), ("-blue", "ring")),
    Rule("Ring Shop", 0, 1, (), ("hot rod",)),
    Rule("Public Promo", 1, 0, ("pubRstr_P", "Gtype_promo"), ("ALL",)),
    Rule("Placeholder", 2, 0, (), ()),
    Rule("Cold Goods", 3, 0, ("Gtype_-promo",), ("cold", "widget", "-rod")),
    Rule("Restricted", 4, 0, ("PRINT", "pubRstr_R"), ("-cold", "ALL")),
    Rule("Strict Prefix", 5, 0, ("Gtypes_small",), ("ALL",)),
    Rule("By Type", 6, 0, ("Gtype_brand#1", "Gtype_-large"), ("ALL", "gear")),
]


@dataclass(frozen=True)
class Inputs:
    """The proxies as DataFrames."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derive(self, table: str, columns: dict[str, str]) -> DataFrame:
        return self.table(table).selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])

    @property
    def locations(self) -> DataFrame:
        return self._derive("part", LOCATION)

    @property
    def owned(self) -> DataFrame:
        """Locations with the ownership filled from the group."""
        return fill_from_group(
            self.locations, "owner_raw", "poi_group", PUBLIC_GROUPS, "Public", "Private", out="owner"
        )

    @property
    def reviews(self) -> DataFrame:
        return self._derive("lineitem", REVIEW)

    @property
    def joined(self) -> DataFrame:
        """One row per review with its location's attributes."""
        return join_dimension(self.reviews, self.owned, "location_id", "location_id")

    @property
    def located_counts(self) -> DataFrame:
        """One row per location: review counts first, then the attributes."""
        counts = label_counts(self.reviews, "location_id", label="predicted")
        return join_dimension(counts, self.owned, "location_id", "location_id", salts=1)

    @property
    def label_totals(self) -> DataFrame:
        """One row per location and label with the number of reviews."""
        counts = count_by(self.reviews, "location_id", "predicted", out="n_reviews")
        return join_dimension(counts, self.owned, "location_id", "location_id", salts=1)

    @property
    def rates(self) -> DataFrame:
        """Negative rate per location with its attributes."""
        return self.located_counts.withColumn("prob", rate_column()).filter(F.col("prob").isNotNull())

    @property
    def owner_rates(self) -> DataFrame:
        """Rates of locations with a known owner and a usable group."""
        usable = F.col("owner").isNotNull() & ~F.col("poi_group").isin("Other", "Unknown")
        return self.rates.filter(usable)

    @property
    def predictions(self) -> DataFrame:
        return self._derive("documents", PREDICTION)

    @property
    def training(self) -> DataFrame:
        return self._derive("labels", TRAINING)

    @property
    def labelled(self) -> DataFrame:
        """Training reviews with text, sentiment and numeric label."""
        texts = self.predictions.withColumn("clean", F.lower(clean_text(F.col("review"))))
        label = F.when(F.col("sentiment") == "positive", 1.0).otherwise(0.0)
        return texts.join(self.training, "review_id").withColumn("label", label)

    @property
    def records(self) -> DataFrame:
        """Nested location records; every seventh location has no place."""
        return self.table("part").select(
            F.struct(
                F.col("p_partkey").alias("id"),
                F.col("p_name").alias("name"),
                F.expr(LOCATION["access_type"]).alias("accessType"),
            ).alias("real"),
            F.when(
                F.col("p_partkey") % 7 != 0,
                F.struct(F.array(F.lower("p_type"), F.lower("p_brand")).alias("types")),
            ).alias("placeSpecifics"),
            F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).alias("poi"),
        )

    @property
    def tokens(self) -> DataFrame:
        """Reviews as token sequences."""
        return spread(self.predictions.select("review_id", "review")).select(
            "review_id", sequence_tokens(F.lower(clean_text(F.col("review")))).alias("tokens")
        )

    def split_tokens(self) -> tuple[DataFrame, DataFrame]:
        return holdout_split(self.tokens, "review_id", TEST_SIZE, SEED)

    def vocab(self) -> DataFrame:
        return build_vocab(self.tokens, F.col("tokens"))

    def vectors(self, vocab: DataFrame) -> DataFrame:
        """Word vectors: a vector goes to the word whose rank follows its id."""
        named = self.table("embeddings").select((F.col("vec_id") + 1).alias("token_id"), F.col("embedding").alias("vector"))
        return named.join(vocab.select("token_id", "word"), "token_id").select("word", "vector")


def _select(columns: dict[str, str], table: str) -> str:
    return f"select {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from {table}"


_FILTERS = "'!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10)"
_QUOTED = ", ".join(f"'{g}'" for g in PUBLIC_GROUPS)

# Common table expressions by name, in an order that respects their references.
CTES = {
    "p_locations": _select(LOCATION, "part"),
    "p_reviews": _select(REVIEW, "lineitem"),
    "p_predictions": _select(PREDICTION, "documents"),
    "p_training": _select(TRAINING, "labels"),
    "p_owned": "select *, case when owner_raw is not null then owner_raw "
    f"when poi_group in ({_QUOTED}) then 'Public' when poi_group is not null then 'Private' end as owner "
    "from p_locations",
    "p_joined": "select * from p_reviews join p_owned using (location_id)",
    "p_rates": "select location_id, name, segment, urban_rural, cost, owner, poi_group, state, access_type, "
    "count(*) as n, 1.0 - cast(sum(case when predicted = 'POSITIVE' then 1 else 0 end) as double) / count(*) as prob "
    "from p_joined where predicted in ('POSITIVE', 'NEGATIVE') group by all",
    "p_owner_rates": "select * from p_rates where owner is not null and poi_group not in ('Other', 'Unknown')",
    "p_records": "select p_partkey as id, p_name as name, "
    f"{LOCATION['access_type']} as access_type, "
    "case when p_partkey % 7 <> 0 then [lower(p_type), lower(p_brand)] end as types, "
    "case when p_partkey % 11 = 0 then p_brand end as poi from part",
    "p_tokens": "select doc_id as review_id, list_filter(string_split(translate(lower(translate(text, '.,?!', '')), "
    f"{_FILTERS}, repeat(' ', {len(SEQUENCE_FILTERS)})), ' '), lambda t: t <> '') as tokens from documents",
    "p_split": "select review_id, row_number() over (order by md5(concat(cast(review_id as varchar), ':22')), review_id)"
    " <= ceil(cast(0.2 as double) * count(*) over ()) as is_test from p_predictions",
    "p_vocab": "select word, count(*) as n, row_number() over (order by count(*) desc, word) as token_id "
    "from (select unnest(tokens) as word from p_tokens) group by word",
    "p_train_vocab": "select word, count(*) as n, row_number() over (order by count(*) desc, word) as token_id "
    "from (select unnest(tokens) as word from p_tokens join p_split using (review_id) where not is_test) group by word",
    "p_encoded": "select review_id, list(coalesce(token_id, (select count(*) + 1 from p_train_vocab)) order by pos) "
    "filter (where word is not null) as ids from (select review_id, unnest(case when len(tokens) = 0 then [null] "
    "else tokens end) as word, generate_subscripts(case when len(tokens) = 0 then [null] else tokens end, 1) as pos "
    "from p_tokens) left join p_train_vocab using (word) group by review_id",
    "p_vectors": "select word, embedding as vector from embeddings join p_vocab on token_id = vec_id + 1",
    "p_pool_counts": "select review_id, word, count(*) as n from (select review_id, unnest(tokens) as word from p_tokens) "
    "group by review_id, word",
    "p_pool_vectors": "select word, 4 * b + d as dim, cast(('0x' || substr(h, 1 + 8 * d, 8)) as ubigint) / 4294967296.0 "
    "* 0.5 - 0.25 as v from (select word, b, md5(word || ':1:' || cast(b as varchar)) as h from p_vocab anti join "
    f"p_vectors using (word), range({DIMS // 4}) blocks(b)), range(4) digits(d) union all select word, "
    "cast(generate_subscripts(vector, 1) - 1 as bigint), unnest(vector)::double from p_vectors",
    "p_words": "select doc_id as review_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0) as words "
    "from documents",
    "p_kept_words": "select review_id, list_filter(words, lambda w: w not in "
    f"({', '.join(repr(w) for w in STOP_WORDS)})) as words from p_words",
    "p_terms": "select review_id, list_concat(words, list_concat("
    "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), "
    "list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) "
    "as terms from p_kept_words",
    "p_labelled": "select review_id, case sentiment when 'positive' then 1.0 else 0.0 end::double as label, "
    "row_number() over (order by md5(concat(cast(review_id as varchar), ':22')), review_id) "
    "<= ceil(cast(0.2 as double) * count(*) over ()) as is_test from p_predictions join p_training using (review_id)",
    "p_clean_words": "select review_id, is_test, list_filter(regexp_extract_all(lower(translate(text, '.,?!', '')), "
    "'[\\p{L}\\p{N}_]{2,}', 0), lambda w: w not in "
    f"({', '.join(repr(w) for w in STOP_WORDS)})) as words from p_labelled join documents on doc_id = review_id",
    "p_clean_terms": "select distinct review_id, is_test, unnest(list_concat(words, list_concat("
    "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), "
    "list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))) "
    "as term from p_clean_words",
    "p_evaluated": "select review_id, lang, case sentiment when 'positive' then 1.0 else 0.0 end as label, "
    "case predicted when 'POSITIVE' then 1.0 else 0.0 end as pred from p_predictions join p_training using (review_id)",
}


_SHARED = {"p_labelled", "p_clean_terms", "p_tokens", "p_vocab", "p_vectors", "p_train_vocab", "p_split", "p_pool_vectors"}


def with_inputs(sql: str) -> str:
    """Oracle text with the common table expressions it needs in front."""
    used: set[str] = set()
    open_texts = [sql]
    while open_texts:
        text = open_texts.pop()
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                open_texts.append(CTES[name])
    # What is read more than once is computed once.
    parts = [f"{name} as {'materialized ' * (name in _SHARED)}({CTES[name]})" for name in CTES if name in used]
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"
