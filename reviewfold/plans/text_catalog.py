"""Queries for splits, token sequences, vocabularies and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.functions import text as T
from reviewfold.operators import joins, split, terms, vocabulary
from reviewfold.operators.layout import spread
from reviewfold.operators.models import embedding_pool as pool
from reviewfold.plans.inputs import DIMS, SEED, STOP_WORDS, TEST_SIZE, Inputs
from reviewfold.plans.registry import query, rounded, text_of


@query("holdout_split", "select review_id, is_test from p_split")
def holdout_split(t: Inputs) -> DataFrame:
    train, test = split.holdout_split(t.predictions.select("review_id"), "review_id", TEST_SIZE, SEED)
    return train.withColumn("is_test", F.lit(False)).unionAll(test.withColumn("is_test", F.lit(True)))


@query(
    "holdout_assignments",
    "select cast(run as int) as run, review_id, row_number() over (partition by run order by "
    "md5(concat(cast(review_id as varchar), ':', cast(22 + run as varchar))), review_id) "
    "<= ceil(cast(0.2 as double) * count(*) over (partition by run)) as is_test from p_predictions, range(5) r(run)",
)
def holdout_assignments(t: Inputs) -> DataFrame:
    return split.holdout_assignments(t.predictions.select("review_id"), "review_id", 5, TEST_SIZE, SEED)


@query("tokenize", "select review_id, array_to_string(tokens, ' ') as tokens, len(tokens) as n_tokens from p_tokens")
def tokenize(t: Inputs) -> DataFrame:
    return t.tokens.select("review_id", text_of("tokens").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens"))


@query("vocabulary", "select word, n, token_id from p_vocab union all select 'Out_Of_Vocab_Token', 0, count(*) + 1 from p_vocab")
def build_vocabulary(t: Inputs) -> DataFrame:
    return vocabulary.with_oov(t.vocab())


def _encoded(t: Inputs) -> tuple[DataFrame, int]:
    """All reviews in ids of the training vocabulary, and the longest training
    sequence."""
    train, _ = t.split_tokens()
    vocab = vocabulary.build_vocab(train, F.col("tokens"))
    encoded = vocabulary.encode_tokens(t.tokens, "review_id", F.col("tokens"), vocab)
    return encoded, vocabulary.longest(train, "tokens")


@query("encode_tokens", "select review_id, coalesce(array_to_string(ids, ' '), '') as token_ids, coalesce(len(ids), 0) as n_ids from p_encoded")
def encode_tokens(t: Inputs) -> DataFrame:
    encoded, _ = _encoded(t)
    return encoded.select(
        "review_id", text_of("token_ids").alias("token_ids"), F.size("token_ids").cast("bigint").alias("n_ids")
    )


_PADDED = (
    "with p_longest as (select max(len(tokens)) as l from p_tokens join p_split using (review_id) where not is_test), "
    "p_ids as (select review_id, coalesce(ids, []) as ids, l from p_encoded, p_longest) select review_id, "
    "md5(array_to_string({padded}, ' ')) as digest, len({padded}) as n_ids from p_ids"
)


def _digest(t: Inputs, side: str) -> DataFrame:
    encoded, longest = _encoded(t)
    padded = vocabulary.pad_sequences(encoded, "token_ids", longest, side)
    return padded.select(
        "review_id", F.md5(text_of("token_ids")).alias("digest"), F.size("token_ids").cast("bigint").alias("n_ids")
    )


@query(
    "pad_pre",
    _PADDED.format(
        padded="list_concat(list_transform(range(greatest(l - len(ids), 0)), lambda i: 0), "
        "ids[greatest(len(ids) - l, 0) + 1 : len(ids)])"
    ),
)
def pad_pre(t: Inputs) -> DataFrame:
    return _digest(t, "pre")


@query(
    "pad_post",
    _PADDED.format(
        padded="list_concat(ids[1 : l], list_transform(range(greatest(l - len(ids), 0)), lambda i: 0))"
    ),
)
def pad_post(t: Inputs) -> DataFrame:
    return _digest(t, "post")


@query(
    "vector_lookup",
    "select word, token_id, vector is not null as has_vector, vector[1]::double as first_value, "
    "vector[64]::double as last_value from p_vocab left join p_vectors using (word)",
)
def vector_lookup(t: Inputs) -> DataFrame:
    vocab = t.vocab()
    found = joins.lookup_vectors(vocab, t.vectors(vocab))
    return found.select(
        "word",
        "token_id",
        F.col("vector").isNotNull().alias("has_vector"),
        F.get("vector", F.lit(0)).cast("double").alias("first_value"),
        F.get("vector", F.lit(DIMS - 1)).cast("double").alias("last_value"),
    )


@query("vector_missing", "select word, token_id from p_vocab left join p_vectors using (word) where vector is null")
def vector_missing(t: Inputs) -> DataFrame:
    vocab = t.vocab()
    return joins.missing_words(vocab, t.vectors(vocab)).select("word", "token_id")


@query(
    "vector_missing_digest",
    "select length(word) as length, count(*) as n, cast(sum(token_id) as bigint) as ids, min(word) as first, max(word) as last "
    "from p_vocab left join p_vectors using (word) where vector is null group by length(word)",
)
def vector_missing_digest(t: Inputs) -> DataFrame:
    """The list of words without a vector, summed up by their length."""
    return vector_missing(t).groupBy(F.length("word").cast("bigint").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"), F.min("word").alias("first"), F.max("word").alias("last")
    )


@query(
    "vector_missing_count",
    "select count(*) as n_missing from p_vocab anti join p_vectors using (word)",
)
def vector_missing_count(t: Inputs) -> DataFrame:
    vocab = t.vocab()
    return joins.missing_words(vocab, t.vectors(vocab)).agg(F.count(F.lit(1)).alias("n_missing"))


@query(
    "embedding_table",
    "with p_all as (select word, token_id from p_vocab union all select 'Out_Of_Vocab_Token', count(*) + 1 from p_vocab), "
    "p_digests as (select word, b, md5(word || ':1:' || cast(b as varchar)) as h from p_all "
    "anti join p_vectors using (word), range(16) blocks(b)), "
    "p_random as (select word, 4 * b + d as dim, cast(('0x' || substr(h, 1 + 8 * d, 8)) as ubigint) / 4294967296.0 "
    "* 0.5 - 0.25 as value from p_digests, range(4) digits(d)), "
    "p_known as (select word, cast(generate_subscripts(vector, 1) - 1 as bigint) as dim, unnest(vector)::double as value "
    "from p_vectors), p_values as (select *, false as in_vectors from p_random union all select *, true from p_known) "
    "select token_id, word, any_value(in_vectors) as in_vectors, round(sum(value), 6) as total, "
    "round(max(value) filter (where dim = 0), 6) as first_value, round(max(value) filter (where dim = 63), 6) as last_value "
    "from p_values join p_all using (word) group by token_id, word "
    "union all select 0, null, false, 0.0, 0.0, 0.0",
)
def embedding_table(t: Inputs) -> DataFrame:
    vocab = t.vocab()
    table = vocabulary.embedding_table(vocabulary.with_oov(vocab), t.vectors(vocab), DIMS)
    figures = T.bound(
        F.col("vector"),
        lambda v: F.struct(
            F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"),
            F.get(v, F.lit(0)).alias("first_value"),
            F.get(v, F.lit(DIMS - 1)).alias("last_value"),
        ),
    )
    summed = table.select("token_id", "word", "in_vectors", figures.alias("_f")).select(
        "token_id", "word", "in_vectors", "_f.total", "_f.first_value", "_f.last_value"
    )
    return rounded(summed, "total", "first_value", "last_value")


@query("word_tokens", "select review_id, array_to_string(words, ' ') as words, len(words) as n_words from p_words")
def word_tokens(t: Inputs) -> DataFrame:
    words = T.word_tokens(F.col("review"))
    return t.predictions.select("review_id", words.alias("words")).select(
        "review_id", text_of("words").alias("words"), F.size("words").cast("bigint").alias("n_words")
    )


@query("stop_words", "select review_id, array_to_string(words, ' ') as words, len(words) as n_words from p_kept_words")
def stop_words(t: Inputs) -> DataFrame:
    kept = T.drop_words(T.word_tokens(F.col("review")), STOP_WORDS)
    return t.predictions.select("review_id", kept.alias("words")).select(
        "review_id", text_of("words").alias("words"), F.size("words").cast("bigint").alias("n_words")
    )


@query("ngrams", "select review_id, md5(array_to_string(terms, '|')) as digest, len(terms) as n_terms from p_terms")
def ngrams(t: Inputs) -> DataFrame:
    bags = spread(t.predictions).select("review_id", terms.terms_of(F.col("review"), STOP_WORDS).alias("terms"))
    return bags.select(
        "review_id", F.md5(text_of("terms", "|")).alias("digest"), F.size("terms").cast("bigint").alias("n_terms")
    )


@query(
    "prune_terms",
    "select term, count(distinct review_id) as df from (select review_id, unnest(terms) as term from p_terms) "
    "group by term having count(distinct review_id) >= 2 and count(distinct review_id) "
    "<= 0.95 * (select count(*) from p_terms)",
)
def prune_terms(t: Inputs) -> DataFrame:
    return terms.prune_terms(t.predictions, "review", STOP_WORDS)


@query(
    "tfidf_weights",
    "with p_train as (select p_terms.* from p_terms join p_split using (review_id) where not is_test), "
    "p_total as (select count(*) as n_texts from p_train), "
    "p_df as (select term, count(distinct review_id) as df from (select review_id, unnest(terms) as term from p_train) "
    "group by term having count(distinct review_id) >= 2 and count(distinct review_id) <= 0.95 * "
    "(select n_texts from p_total)), "
    "p_tf as (select review_id, term, count(*) as tf from (select review_id, unnest(terms) as term from p_terms "
    "join p_split using (review_id) where is_test) group by all), "
    "p_raw as (select review_id, term, tf, tf * (ln((1.0 + n_texts) / (1 + df)) + 1) as raw from p_tf join p_df "
    "using (term), p_total) "
    "select review_id, term, tf, round(raw / sqrt(sum(raw * raw) over (partition by review_id)), 6) as weight from p_raw",
)
def tfidf_weights(t: Inputs) -> DataFrame:
    train, test = split.holdout_split(t.predictions.select("review_id", "review"), "review_id", TEST_SIZE, SEED)
    weights = terms.fit_term_weights(train, "review", STOP_WORDS)
    return rounded(weights.transform(test, "review_id", "review"), "weight")


@query(
    "embedding_pool",
    "with p_sums as (select review_id, dim, sum(n * v) / sum(n) as mean_value, max(v) as max_value "
    "from p_pool_counts join p_pool_vectors using (word) group by review_id, dim) "
    "select review_id, cast(dims.dim as int) as dim, round(coalesce(mean_value, 0), 6) as mean_value, "
    f"round(coalesce(max_value, 0), 6) as max_value from p_predictions cross join range({DIMS}) dims(dim) "
    "left join p_sums using (review_id, dim)",
)
def embedding_pool(t: Inputs) -> DataFrame:
    pooled = pool(t.tokens, "review_id", F.col("tokens"), t.vectors(t.vocab()), DIMS)
    pairs = F.arrays_zip(F.col("mean_vector").alias("mean_value"), F.col("max_vector").alias("max_value"))
    long = pooled.select("review_id", F.posexplode(pairs).alias("dim", "pair"))
    return rounded(long.select("review_id", "dim", "pair.mean_value", "pair.max_value"), "mean_value", "max_value")
