"""Text classifiers on Spark ML, scoring and evaluation.

Fitted models hold one number per kept term; the vocabulary is always exact. Its
size follows the labelled texts a fit sees, so memory is bounded by the number
of those: ``max_rows`` of the fits takes at most about so many, by a hash of the
text. The support vector machine and ``linear`` keep terms in tables instead; no term
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewfold.functions.labels import CLASS_NAME, case_map
from reviewfold.functions.text import WORD_PATTERN, clean_text, drop_words, sequence_tokens, to_class, word_tokens
from reviewfold.operators.aggregates import run_summary
from reviewfold.operators.bundles import TermBundle, deal_out, meet, sequences
from reviewfold.operators.layout import one_per_element, spread
from reviewfold.operators.ordering import with_row_index
from reviewfold.operators.split import holdout_borders, in_test
from reviewfold.operators.terms import document_frequency, kept_terms, ngram_frequency
from reviewfold.operators.vocabulary import draw_vectors
from reviewfold.sources.tables import append_table
from reviewfold.storage import materialize, new_path

# A fit with fewer rows than this per partition merges partitions.
ROWS_PER_TASK = 10_000
# Numbers of a block of random features that a batch holds at once.
BLOCK_NUMBERS = 4_000_000
# Words of a bundle of texts that are pooled, and of one whose pools without each word are returned.
POOL_WORDS, WITHOUT_WORDS = 1_000_000, 50_000
# Words whose vectors are added up at once.
POOL_BLOCK = 1 << 15
# Words of a bundle of texts whose terms are weighed in one place.
TERM_WORDS = 500_000

_POOL_SCHEMA = "dims int, seed int"
_RBF_SCHEMA = "n_texts bigint, text string, stop_words array<string>, gamma double, n_features int, seed int"
_TERM_SCHEMA = "term string, df bigint, index bigint"
RUN_SCHEMA = "run int, n bigint, accuracy double, precision double, recall double, f1 double"


def _term_stages(text: str, stop_words: Iterable[str]) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD_PATTERN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop_words), caseSensitive=True),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        NGram(n=3, inputCol="_kept", outputCol="_triples"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs, _triples) AS _terms FROM __THIS__"),
    ]


def _counter(terms: DataFrame) -> CountVectorizerModel:
    """Count vectors over the given terms, which go from the executors to the JVM
    driver without a detour through Python."""
    encoder = terms.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    words = getattr(terms._jdf, "as")(encoder).collect()
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    return model.setInputCol("_terms").setOutputCol("_tf")


def training_sample(df: DataFrame, id_col: str, max_rows: int | None = None) -> DataFrame:
    """At most about ``max_rows`` labelled rows to fit on, chosen by a hash of a column,
    the same ones in every run; all rows without a limit."""
    if max_rows is None:
        return df
    share = max_rows / max(1, df.count())
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_tfidf(
    train: DataFrame,
    text: str,
    stop_words: Iterable[str] = (),
    min_df: int = 2,
    max_df: float = 0.95,
) -> PipelineModel:
    """TF-IDF of 1- to 3-grams as sparse vectors in ``features``.

    Weight ``tf * (ln((1 + n) / (1 + df)) + 1)``, normalized to length 1.
    """
    split = PipelineModel(_term_stages(text, stop_words))
    bags = split.transform(spread(train.select(text))).select("_terms")
    n_texts = train.count()
    kept = materialize(kept_terms(document_frequency(bags, F.col("_terms")), n_texts, min_df, max_df))
    if not kept.limit(1).count():
        raise ValueError("no term is left after pruning; nothing to fit on")
    ordered = kept.orderBy("term")
    counter = _counter(ordered.select("term"))
    frequencies = ordered.select("df").toPandas()["df"].to_numpy(float)
    weights = np.log((1.0 + n_texts) / (1.0 + frequencies)) + 1.0
    return PipelineModel(
        [
            *split.stages,
            counter,
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
        ]
    )


def _training_table(df: DataFrame, features: str, label: str) -> DataFrame:
    """Vectors and labels with their lineage cut.

    A fit runs one job per iteration. Without the cut every task of every job
    carries the plan, with a name for each slot of the vectors, and a lost
    executor means splitting the texts again. Few rows go into few partitions,
    since an iteration over a small one is mostly scheduling.
    """
    table = materialize(df.select(F.col(features).alias(features, metadata={}), label))
    return table.coalesce(max(1, table.count() // ROWS_PER_TASK))


def fit_logistic(
    train: DataFrame,
    text: str,
    label: str = "label",
    C: float = 2.5,
    stop_words: Iterable[str] = (),
    penalize_intercept: bool = True,
    max_iter: int = 100,
    max_rows: int | None = None,
    **tfidf,
) -> PipelineModel:
    """L2 logistic regression on TF-IDF.

    ``C`` weighs the summed loss against half the squared norm, so the penalty
    on the mean loss is ``1 / (C n)``. With ``penalize_intercept`` the intercept
    is a constant feature; Spark's solver leaves the weight of a feature without
    variance at 0, so such a model has no intercept. ``linear.fit_term_logistic``
    fits a penalized intercept, and keeps terms and weights in tables.
    """
    train = training_sample(train, text, max_rows)
    features = fit_tfidf(train, text, stop_words, **tfidf)
    stages = list(features.stages)
    inputs = ["features"]
    if penalize_intercept:
        stages.append(SQLTransformer(statement="SELECT *, 1.0D AS _one FROM __THIS__"))
        inputs.append("_one")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_x"))
    stacked = PipelineModel(stages).transform(spread(train))
    ready = _training_table(stacked, "_x", label)
    estimator = LogisticRegression(
        featuresCol="_x",
        labelCol=label,
        regParam=1.0 / (C * train.count()),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=not penalize_intercept,
        maxIter=max_iter,
    )
    return PipelineModel([*stages, estimator.fit(ready)])


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """Probability of the positive class, class number and class name per row."""
    prob = vector_to_array("probability")[1]
    scored = model.transform(spread(df)).select(*keep, prob.alias("prob")).withColumn("class", to_class(F.col("prob")))
    return scored.withColumn("predicted", case_map(F.col("class"), CLASS_NAME))


def _hash_uniform(index: np.ndarray, column: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend only on (index, column, seed)."""
    with np.errstate(over="ignore"):
        z = index.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        z = z + column.astype(np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def rbf_features(df: DataFrame, features: str, out: str, gamma: float, n_features: int, seed: int) -> DataFrame:
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007). ``features``
    holds sparse vectors, or structs of their ``indices`` and ``values``.

    The projection matrix is never stored: its entries are hashed from the term
    index, so the step is a map with no broadcast, however many terms there are.
    """
    columns = np.arange(n_features, dtype=np.int64)
    shift = 2.0 * math.pi * _hash_uniform(np.zeros(1, dtype=np.int64), columns, seed + 2)[0]

    def project(at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Angles of several texts; each term's entries are drawn once, in blocks of columns."""
        terms, place = np.unique(at, return_inverse=True)
        angles = np.zeros((len(sizes), n_features))
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        step = max(1, BLOCK_NUMBERS // max(1, len(at)))
        for first in range(0, n_features if len(at) else 0, step):
            block = columns[first : first + step]
            length = np.sqrt(-2.0 * np.log(_hash_uniform(terms, block, seed)))
            normal = length * np.cos(2.0 * math.pi * _hash_uniform(terms, block, seed + 1))
            angles[full, first : first + step] = np.add.reduceat(normal[place] * values[:, None], starts, axis=0)
        return math.sqrt(2.0 / n_features) * np.cos(math.sqrt(2.0 * gamma) * angles + shift)

    @F.pandas_udf("array<double>")
    def fourier(indices: pd.Series, values: pd.Series) -> pd.Series:
        sizes = np.array([len(i) for i in indices], dtype=np.int64)
        rows, ends = [], np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            # So many texts that their terms fill a few blocks at most.
            base = ends[first] - sizes[first]
            stop = max(first + 1, int(np.searchsorted(ends, base + BLOCK_NUMBERS // 8, "right")))
            part = slice(first, stop)
            at = np.concatenate([np.asarray(i, dtype=np.int64) for i in indices.iloc[part]])
            x = np.concatenate([np.asarray(v, dtype=float) for v in values.iloc[part]])
            rows.extend(project(at, x, sizes[part]))
            first = stop
        return pd.Series(rows, index=indices.index)

    plain = isinstance(df.schema[features].dataType, StructType)
    parts = F.col(features) if plain else F.unwrap_udt(F.col(features))
    return df.withColumn(out, array_to_vector(fourier(parts["indices"], parts["values"])))


@dataclass(frozen=True)
class TermFeatures:
    """TF-IDF of 1- to 3-grams with the terms in a table: ``terms`` holds
    ``(term, df, index)``, a row per kept term. Weighted as by ``fit_tfidf``."""

    terms: DataFrame
    n_texts: int
    text: str
    stop_words: tuple[str, ...] = ()

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Indices and weights of each row's kept terms, in the order of the terms. Texts
        meet the terms in bundles, so a term is sent once to each bundle that holds it."""
        kept, n_texts = df.columns, self.n_texts

        def weigh(texts: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows.column("index")))
            bundle = TermBundle(texts, rows, "_row", 1, 3)
            given = bundle.tf * (np.log((1.0 + n_texts) / (1.0 + bundle.numbers("df"))) + 1.0)
            length = np.sqrt(bundle.by_text(given * given))
            ends = np.append(0, np.cumsum(np.bincount(bundle.post_text, minlength=len(bundle.ids)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bundle.numbers("index"), given / length[bundle.post_text])]
            found = pa.StructArray.from_arrays(lists, names=["indices", "values"])
            return texts.select(kept).append_column(out, found.take(pa.array(bundle.text)))

        numbered = df.withColumn("_row", F.monotonically_increasing_id())
        dealt = deal_out(numbered, "_row", drop_words(word_tokens(F.col(self.text)), self.stop_words), TERM_WORDS, kept)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` struct<indices:array<bigint>,values:array<double>>"
        return meet(dealt, "_row", lambda lists: [terms for _, terms in sequences(lists, 1, 3)], self.terms, "term", weigh, schema)


def fit_term_features(
    train: DataFrame, text: str, stop_words: Iterable[str] = (), min_df: int = 2, max_df: float = 0.95
) -> TermFeatures:
    """The kept terms numbered from 0 in their order; they stay with the executors."""
    stop = tuple(stop_words)
    n_texts = train.count()
    kept = kept_terms(ngram_frequency(train, text, stop), n_texts, min_df, max_df)
    path = new_path(train.sparkSession, "terms")
    with_row_index(kept, [F.col("term")], out="index").select("term", "df", "index").write.parquet(path)
    terms = train.sparkSession.read.schema(_TERM_SCHEMA).parquet(path)
    if not terms.limit(1).count():
        raise ValueError("no term is left after pruning; nothing to fit on")
    return TermFeatures(terms, n_texts, text, stop)


@dataclass(frozen=True)
class RbfSvm:
    """Approximate RBF-kernel support vector machine."""

    features: TermFeatures
    svm: LinearSVCModel
    gamma: float
    n_features: int
    seed: int

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.features.transform(df)
        return self.svm.transform(rbf_features(ready, "features", "_rbf", self.gamma, self.n_features, self.seed))

    def save(self, path: str) -> None:
        """The machine, the table of terms, and in one row what the features are made from."""
        PipelineModel([self.svm]).write().overwrite().save(f"{path}/stages")
        self.features.terms.write.mode("overwrite").parquet(f"{path}/terms")
        found = self.features
        row = [(found.n_texts, found.text, list(found.stop_words), self.gamma, self.n_features, self.seed)]
        SparkSession.active().createDataFrame(row, _RBF_SCHEMA).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, path: str) -> RbfSvm:
        spark = SparkSession.active()
        row = spark.read.schema(_RBF_SCHEMA).parquet(f"{path}/features").first()
        terms = spark.read.schema(_TERM_SCHEMA).parquet(f"{path}/terms")
        features = TermFeatures(terms, row.n_texts, row.text, tuple(row.stop_words))
        return cls(features, PipelineModel.load(f"{path}/stages").stages[0], row.gamma, row.n_features, row.seed)


def fit_rbf_svm(
    train: DataFrame,
    text: str,
    label: str = "label",
    C: float = 10.0,
    gamma: float = 0.1,
    n_features: int = 256,
    seed: int = 1,
    stop_words: Iterable[str] = (),
    max_iter: int = 100,
    max_rows: int | None = None,
    **tfidf,
) -> RbfSvm:
    """Hinge loss on random Fourier features of TF-IDF; approximate by design. All texts
    are used unless the caller sets ``max_rows``, which no query does. The driver holds one
    number per random feature, and no term."""
    train = training_sample(train, text, max_rows)
    features = fit_term_features(train, text, stop_words, **tfidf)
    mapped = rbf_features(features.transform(train), "features", "_rbf", gamma, n_features, seed)
    ready = _training_table(mapped, "_rbf", label)
    estimator = LinearSVC(
        featuresCol="_rbf",
        labelCol=label,
        regParam=1.0 / (C * train.count()),
        standardization=False,
        maxIter=max_iter,
    )
    return RbfSvm(features, estimator.fit(ready), gamma, n_features, seed)


def embedding_pool(
    df: DataFrame, id_col: str, tokens: Column, vectors: DataFrame, dims: int, seed: int = 1
) -> DataFrame:
    """Mean and maximum of the word vectors of each text.

    A word counts as often as it occurs. A word without a vector gets the one
    drawn from the word itself, as in ``embedding_table``, so every text has a
    result; a text without words, or without an id, has zeros. Texts meet the
    vectors in bundles, so a vector is sent once to each bundle that holds its word.
    """

    def pool(texts: pa.Table, rows: pa.Table) -> pa.Table:
        bundle = _WordBundle(texts, rows, id_col, dims, seed)
        mean, largest = bundle.pools()
        ids = texts.column(id_col).combine_chunks()
        return pa.table([ids, *(_lists(x[bundle.text]) for x in (mean, largest))], names=[id_col, "mean_vector", "max_vector"])

    kind = df.schema[id_col].dataType.simpleString()
    dealt = deal_out(df, id_col, tokens, POOL_WORDS)
    return meet(dealt, id_col, lambda lists: [lists.flatten()], _vector_rows(vectors), "word", pool, f"`{id_col}` {kind}, mean_vector array<double>, max_vector array<double>")


def _vector_rows(vectors: DataFrame) -> DataFrame:
    """``(word, vector)`` in the width it came in."""
    single = vectors.schema["vector"].dataType.simpleString() == "array<float>"
    return vectors.select("word", "vector" if single else F.col("vector").cast("array<double>").alias("vector"))


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


class _WordBundle:
    """The distinct words of each text of a bundle, in the order of the texts, with their vectors.

    A word with several vectors counts once for each of them. Rows with equal ids are one text."""

    def __init__(self, texts: pa.Table, rows: pa.Table, id_col: str, dims: int, seed: int):
        ids = texts.column(id_col).combine_chunks()
        coded = ids.dictionary_encode(null_encoding="encode")
        self.ids, self.text = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        lists = texts.column("_words").combine_chunks()
        lists = pc.if_else(ids.is_valid(), lists, pa.scalar(None, lists.type))
        size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        held = flat.is_valid().to_numpy(zero_copy_only=False)
        text = np.repeat(self.text, size)[held].astype(np.int64)
        words = flat.drop_null().dictionary_encode()
        self.words = words.dictionary
        key, times = np.unique(text * max(1, len(self.words)) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, word = np.divmod(key, max(1, len(self.words)))
        # Vectors in the order of the words; a word without one draws its own.
        given = rows.column("vector").combine_chunks()
        place = pc.index_in(rows.column("word").combine_chunks(), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        known = given.is_valid().to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(given), dims))
        matrix[known] = pc.fill_null(given.drop_null().flatten(), 0).to_numpy(zero_copy_only=False).reshape(-1, dims)
        bare = np.setdiff1d(np.arange(len(self.words)), place)
        drawn = np.concatenate([place[~known], bare])
        place = np.concatenate([place[known], drawn])
        vectors = np.concatenate([matrix[known], draw_vectors(self.words.take(pa.array(drawn)).to_pylist(), dims, seed)])
        order = np.argsort(place, kind="stable")
        self.vectors = vectors[order]
        count = np.bincount(place, minlength=len(self.words))
        start = np.cumsum(count) - count
        # A posting for each text, word and vector.
        many = count[word]
        self.post_text, self.post_word = np.repeat(text, many), np.repeat(word, many)
        within = np.arange(len(self.post_text)) - np.repeat(np.cumsum(many) - many, many)
        self.post_times, self.post_vector = np.repeat(times, many).astype(float), start[self.post_word] + within

    def pools(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum of each text; postings are read in blocks, however long a text is."""
        shape = (len(self.ids), self.vectors.shape[1])
        total, largest, n = np.zeros(shape), np.full(shape, -np.inf), np.zeros(len(self.ids))
        for first in range(0, len(self.post_text), POOL_BLOCK):
            part = slice(first, first + POOL_BLOCK)
            values, times = self.vectors[self.post_vector[part]], self.post_times[part]
            starts = np.flatnonzero(np.diff(self.post_text[part], prepend=-1))
            at = self.post_text[part][starts]
            largest[at] = np.maximum(largest[at], np.maximum.reduceat(values, starts, axis=0))
            total[at] += np.add.reduceat(values * times[:, None], starts, axis=0)
            n[at] += np.add.reduceat(times, starts)
        full = n > 0
        return np.divide(total, n[:, None], out=np.zeros(shape), where=full[:, None]), np.where(full[:, None], largest, 0.0)


def pools_without(df: DataFrame, id_col: str, tokens: Column, vectors: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    """Mean and maximum of the word vectors of each text without one of its words, a row
    for every distinct word; all its occurrences are left out.

    A text's sum, its number of words and the two largest values of each dimension
    give every pool at once. A text of one word leaves zeros; one without an id has no
    row. Texts meet the vectors in bundles, small ones since the pools of a bundle are
    returned at once.
    """

    def without(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times = times[:, None]
        rest = times.sum() - times
        mean = np.divide((times * values).sum(axis=0) - times * values, rest, out=np.zeros_like(values), where=rest > 0)
        if len(values) == 1:
            return mean, np.zeros_like(values)
        first = values.argmax(axis=0)
        others = values.copy()
        others[first, np.arange(dims)] = -np.inf
        return mean, np.where(np.arange(len(values))[:, None] == first, others.max(axis=0), values.max(axis=0))

    def leave_out(texts: pa.Table, rows: pa.Table) -> pa.Table:
        bundle = _WordBundle(texts, rows, id_col, dims, seed)
        shape = (len(bundle.post_text), dims)
        means, largest = np.zeros(shape), np.zeros(shape)
        starts = np.flatnonzero(np.diff(bundle.post_text, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], shape[0]), strict=True):
            means[a:b], largest[a:b] = without(bundle.post_times[a:b], bundle.vectors[bundle.post_vector[a:b]])
        names = [bundle.ids.take(pa.array(bundle.post_text)), bundle.words.take(pa.array(bundle.post_word))]
        return pa.table([*names, _lists(means), _lists(largest)], names=[id_col, "word", "mean_vector", "max_vector"])

    kind = df.schema[id_col].dataType.simpleString()
    dealt = deal_out(df, id_col, tokens, WITHOUT_WORDS)
    return meet(dealt, id_col, lambda lists: [lists.flatten()], _vector_rows(vectors), "word", leave_out, f"`{id_col}` {kind}, word string, mean_vector array<double>, max_vector array<double>")


def fit_embedding_mlp(
    pooled: DataFrame, dims: int, label: str = "label", hidden: int = 16, seed: int = 1, max_iter: int = 60
) -> PipelineModel:
    """Feed-forward classifier over pooled word vectors."""
    ready = _training_table(pooled_features(pooled), "features", label)
    mlp = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[2 * dims, hidden, 2], blockSize=128, seed=seed, maxIter=max_iter
    )
    return PipelineModel([mlp.fit(ready)])


@dataclass(frozen=True)
class EmbeddingClassifier:
    """A classifier over pooled word vectors together with the vectors it reads words by."""

    vectors: DataFrame
    dims: int
    seed: int
    mlp: PipelineModel

    def transform(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """Raw texts to predictions: clean, tokenize, look up, pool, classify. ``id_col``
        identifies a row; a text without words is pooled to zeros."""
        pooled = embedding_pool(df.select(id_col, text), id_col, self._tokens(text), self.vectors, self.dims, self.seed)
        return self.mlp.transform(pooled_features(pooled))

    def attribution(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """``(id, word, attribution)``: by how much the probability of the positive class
        falls when a word is left out of its text."""
        probability = vector_to_array("probability")[1]
        whole = self.transform(df, id_col, text).select(id_col, probability.alias("_whole"))
        parts = pools_without(df.select(id_col, text), id_col, self._tokens(text), self.vectors, self.dims, self.seed)
        rest = self.mlp.transform(pooled_features(parts)).select(id_col, "word", probability.alias("_rest"))
        return rest.join(whole, id_col).select(id_col, "word", (F.col("_whole") - F.col("_rest")).alias("attribution"))

    @staticmethod
    def _tokens(text: str) -> Column:
        return sequence_tokens(F.lower(clean_text(F.coalesce(F.col(text), F.lit("")))))

    def save(self, path: str) -> None:
        """The words with their vectors beside the stages, so that a new session scores raw texts."""
        self.vectors.select("word", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
        row = [(self.dims, self.seed)]
        SparkSession.active().createDataFrame(row, _POOL_SCHEMA).write.mode("overwrite").parquet(f"{path}/pool")
        self.mlp.write().overwrite().save(f"{path}/stages")

    @classmethod
    def load(cls, path: str) -> EmbeddingClassifier:
        spark = SparkSession.active()
        row = spark.read.schema(_POOL_SCHEMA).parquet(f"{path}/pool").first()
        return cls(spark.read.parquet(f"{path}/vectors"), row.dims, row.seed, PipelineModel.load(f"{path}/stages"))


def forward_pass(pooled: DataFrame, model: PipelineModel, out: str = "forward") -> DataFrame:
    """Probability of the positive class recomputed from the exported weights of a
    feed-forward classifier, as plain column arithmetic."""
    mlp = model.stages[-1]
    weights, inputs = mlp.weights.toArray(), F.concat("mean_vector", "max_vector")
    sizes, at = list(mlp.getLayers()), 0
    for layer, (n_in, n_out) in enumerate(zip(sizes, sizes[1:], strict=False)):
        matrix = weights[at : at + n_in * n_out].reshape(n_in, n_out).T
        bias = weights[at + n_in * n_out : at + n_in * n_out + n_out]
        at += n_in * n_out + n_out
        column = f"_layer{layer}"
        sums = [
            F.aggregate(F.zip_with(F.lit(row.tolist()), inputs, lambda w, x: w * x), F.lit(float(b)), lambda a, x: a + x)
            for row, b in zip(matrix, bias, strict=True)
        ]
        last = layer == len(sizes) - 2
        pooled = pooled.withColumn(column, F.array(*sums if last else [1.0 / (1.0 + F.exp(-z)) for z in sums]))
        inputs = F.col(column)
    odds = F.exp(F.get(inputs, F.lit(0)) - F.get(inputs, F.lit(1)))
    return pooled.withColumn(out, 1.0 / (1.0 + odds)).drop(*[f"_layer{i}" for i in range(len(sizes) - 1)])


def pooled_features(pooled: DataFrame) -> DataFrame:
    return pooled.withColumn("features", array_to_vector(F.concat("mean_vector", "max_vector")))


def binary_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; the positive class is 1.

    An empty denominator gives precision or recall 0; F1 is then NULL when both
    are 0.
    """
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(label) == F.col(pred), 1)).alias("_right"),
        F.count(F.when(truth & guess, 1)).alias("_tp"),
        F.count(F.when(guess, 1)).alias("_guessed"),
        F.count(F.when(truth, 1)).alias("_true"),
    )

    def ratio(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))

    rated = counts.select(
        *by,
        "n",
        F.when(F.col("n") > 0, F.col("_right") / F.col("n")).alias("accuracy"),
        ratio("_tp", "_guessed").alias("precision"),
        ratio("_tp", "_true").alias("recall"),
    )
    return rated.withColumn("f1", f1_score("precision", "recall"))


def f1_score(precision: str, recall: str) -> Column:
    total = F.col(precision) + F.col(recall)
    return F.when(total > 0, 2 * F.col(precision) * F.col(recall) / total)


def repeated_holdout(
    df: DataFrame,
    id_col: str,
    fit: Callable[[DataFrame], object],
    runs: int,
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 22,
    log_path: str | None = None,
) -> DataFrame:
    """Metrics of ``runs`` random holdouts, one row per run.

    ``fit`` maps a training frame to anything with ``transform`` that yields
    ``prediction``. The borders of all splits are found together. The result has
    a plan of constant size; without rows it is empty. With ``log_path`` each
    finished run is appended to a log.
    """
    rows = []
    for run, border in enumerate(holdout_borders(df, id_col, test_size, [seed + r for r in range(runs)])):
        is_test = in_test(id_col, border)
        model = fit(df.filter(~is_test))
        # One row a run; the test set is scored once.
        metrics = binary_metrics(model.transform(df.filter(is_test)), label, "prediction").first()
        rows.append((run, *metrics))
        if log_path:
            append_table(df.sparkSession.createDataFrame(rows[-1:], RUN_SCHEMA), log_path)
    return df.sparkSession.createDataFrame(rows, RUN_SCHEMA)


def summarize_runs(runs: DataFrame, metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    return run_summary(runs, metrics)


def token_attribution(df: DataFrame, model: PipelineModel, id_col: str) -> DataFrame:
    """Weight of each term in the prediction of its text: the absolute gradient
    of the predicted probability with respect to the term's count.

    ``model`` is a fitted ``fit_logistic``; its weights, one row per term, are
    what the model holds in memory anyway.
    """
    stages = {type(stage).__name__: stage for stage in model.stages}
    idf = stages["ElementwiseProduct"].getScalingVec().toArray()
    weights = stages["LogisticRegressionModel"].coefficients.toArray()[: len(idf)]
    table = pd.DataFrame({"_at": np.arange(len(idf)), "_slope": np.abs(weights * idf)})
    slopes = df.sparkSession.createDataFrame(table).withColumn("_at", F.col("_at").cast("int"))
    p = vector_to_array("probability")[1]
    scored = model.transform(spread(df)).select(id_col, (p * (1 - p)).alias("_steep"), "_terms")
    single = one_per_element(scored, [id_col, "_steep"], F.array_distinct("_terms"), "term")
    # A bag of one term tells the slot of that term, or none if it was pruned.
    placed = stages["CountVectorizerModel"].transform(single.withColumn("_terms", F.array("term")))
    slot = F.get(F.unwrap_udt(F.col("_tf"))["indices"], F.lit(0))
    found = placed.select(id_col, "term", "_steep", slot.alias("_at"))
    return found.join(slopes, "_at").select(
        id_col, "term", (F.col("_steep") * F.col("_slope")).alias("attribution")
    )
