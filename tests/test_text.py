"""Vocabulary, sequences and term weights against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewfold.operators import joins, models, terms, vocabulary

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, rng.choices(WORDS, weights, k=rng.randint(0, 12))) for i in range(60)]


def frame(spark, texts):
    return spark.createDataFrame(texts, "id bigint, toks array<string>")


def plain_vocab(texts):
    counts = Counter(w for _, words in texts for w in words)
    return {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda p: (-p[1], p[0])), 1)}


def test_vocabulary_with_oov(spark, texts):
    vocab = vocabulary.build_vocab(frame(spark, texts), F.col("toks"))
    assert {r.word: r.token_id for r in vocab.collect()} == plain_vocab(texts)
    extra = vocabulary.with_oov(vocab).filter(F.col("word") == vocabulary.OOV_WORD).first()
    assert extra.token_id == len(plain_vocab(texts)) + 1


@pytest.mark.parametrize("word_bytes", [128, 3 << 20])
def test_encoding(spark, texts, word_bytes, monkeypatch):
    """With all words, or three of them, broadcast."""
    monkeypatch.setattr(vocabulary, "HEAD_WORD_BYTES", word_bytes)
    train, rest = texts[:40], texts
    vocab = vocabulary.build_vocab(frame(spark, train), F.col("toks"))
    ids = plain_vocab(train)
    got = {r.id: r.token_ids for r in vocabulary.encode_tokens(frame(spark, rest), "id", F.col("toks"), vocab).collect()}
    assert got == {i: [ids.get(w, len(ids) + 1) for w in words] for i, words in rest}


def test_encoding_without_broadcast(spark, texts, no_broadcast):
    vocab = vocabulary.build_vocab(frame(spark, texts), F.col("toks"))
    ids = plain_vocab(texts)
    got = {r.id: r.token_ids for r in vocabulary.encode_tokens(frame(spark, texts), "id", F.col("toks"), vocab).collect()}
    assert got == {i: [ids[w] for w in words] for i, words in texts}


@pytest.mark.parametrize("word_bytes", [128, 3 << 20, 1 << 40])
def test_encoding_splits_texts_once(spark, word_bytes, monkeypatch):
    """NULL, unknown, long and very frequent words, texts without words, a long text; with
    all words, three of them, or none broadcast the texts are split by one node."""
    monkeypatch.setattr(vocabulary, "HEAD_WORD_BYTES", word_bytes)
    rng = random.Random(3)
    long_word = "x" * 200
    train = [(i, ["hot"] * 5 + rng.choices([*WORDS, long_word], k=8)) for i in range(40)]
    rows = [*train, (100, []), (101, None), (102, ["hot", None, "none", "hot"]), (103, ["none"] * 3000 + ["hot", long_word]), (None, ["w1"])]
    vocab = vocabulary.build_vocab(frame(spark, train), F.col("toks"))
    ids = plain_vocab(train)
    encoded = vocabulary.encode_tokens(frame(spark, rows), "id", F.col("toks"), vocab)
    assert {r.id: r.token_ids for r in encoded.collect()} == {i: [ids.get(w, len(ids) + 1) for w in words or []] for i, words in rows}
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Generate posexplode") == 1


def test_encoding_against_an_empty_vocabulary(spark, texts):
    empty = vocabulary.build_vocab(frame(spark, []), F.col("toks"))
    got = vocabulary.encode_tokens(frame(spark, texts), "id", F.col("toks"), empty).collect()
    assert {r.id: r.token_ids for r in got} == {i: [1] * len(words) for i, words in texts}


def test_embedding_table(spark, texts):
    vocab = vocabulary.build_vocab(frame(spark, texts), F.col("toks"))
    vectors = spark.createDataFrame([("w0", [1.0, 2.0, 3.0]), ("other", [9.0, 9.0, 9.0])], "word string, vector array<float>")
    rows = {r.token_id: r for r in vocabulary.embedding_table(vocab, vectors, 3).collect()}
    assert rows[0].vector == [0.0, 0.0, 0.0]
    by_word = {r.word: r for r in rows.values()}
    assert by_word["w0"].vector == [1.0, 2.0, 3.0] and by_word["w0"].in_vectors
    random_rows = [r.vector for r in rows.values() if r.token_id and not r.in_vectors]
    assert all(len(v) == 3 and all(-0.25 <= x < 0.25 for x in v) for v in random_rows)
    assert len({tuple(v) for v in random_rows}) == len(random_rows)
    again = {r.token_id: r.vector for r in vocabulary.embedding_table(vocab.repartition(3), vectors, 3).collect()}
    assert again == {k: r.vector for k, r in rows.items()}
    missing = {r.word for r in joins.missing_words(vocab, vectors).collect()}
    assert missing == set(plain_vocab(texts)) - {"w0"}


def plain_weights(train, test, min_df=2, max_df=0.95):
    def bag(words):
        return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    df = Counter(t for _, words in train for t in set(bag(words)))
    n = len(train)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if min_df <= c <= max_df * n}
    out = {}
    for i, words in test:
        raw = {t: c * idf[t] for t, c in Counter(bag(words)).items() if t in idf}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / length for t, v in raw.items()})
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_term_weights(spark, texts, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    train, test = texts[:45], texts[45:]
    as_text = lambda rows: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id bigint, text string")
    weights = terms.fit_term_weights(as_text(train), "text").transform(as_text(test), "id", "text")
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    expected = plain_weights(train, test)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in expected)


def test_ml_vectors_equal_relational_weights(spark, texts):
    train = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "id bigint, text string")
    model = models.fit_tfidf(train, "text")
    counter = next(s for s in model.stages if type(s).__name__ == "CountVectorizerModel")
    expected = plain_weights(texts, texts)
    for row in model.transform(train).select("id", "features").collect():
        got = {(row.id, counter.vocabulary[int(i)]): v for i, v in zip(row.features.indices, row.features.values) if v}
        want = {k: v for k, v in expected.items() if k[0] == row.id}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_embedding_pool(spark, texts, limit):
    """Every text has a result, and the limit on broadcasts is obeyed."""
    rng = random.Random(2)
    table = {w: [rng.uniform(-1, 1) for _ in range(3)] for w in WORDS[:20]}
    vectors = spark.createDataFrame(list(table.items()), "word string, vector array<double>")
    drawn = spark.createDataFrame([(w,) for w in {w for _, ws in texts for w in ws}], "w string")
    drawn = {r.w: r.v for r in drawn.select("w", vocabulary.random_vector(F.col("w"), 3, 1).alias("v")).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        pooled = models.embedding_pool(frame(spark, [*texts, (10_000, [])]), "id", F.col("toks"), vectors, 3)
        got = {r.id: r for r in pooled.collect()}
        if limit == "-1":
            assert "Broadcast" not in pooled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.keys() == {i for i, _ in texts} | {10_000}
    assert got[10_000].mean_vector == got[10_000].max_vector == [0.0] * 3
    for i, words in texts:
        mine = [table.get(w, drawn[w]) for w in words] or [[0.0] * 3]
        assert got[i].mean_vector == pytest.approx([sum(c) / len(mine) for c in zip(*mine)])
        assert got[i].max_vector == pytest.approx([max(c) for c in zip(*mine)])
