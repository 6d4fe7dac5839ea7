"""Scores of the Bloom filter model do not depend on how many segments it has, and texts are scored in one pass."""

from reviewfold.llm import ngram_model
from reviewfold.llm.common import crc_mod


def rows_of(spark, monkeypatch, docs, tokens):
    monkeypatch.setattr(ngram_model, "SEGMENT_TOKENS", tokens)
    monkeypatch.setattr(ngram_model, "BUNDLE_BYTES", 600)
    return ngram_model.score_texts(docs, crc_mod("doc", 5) != 1, round_bytes=1)


def test_segments_are_read_once(spark, monkeypatch):
    """Before, each round of segments scored all texts again and stored them."""
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(i % 30))) for i in range(120)]
    docs = spark.createDataFrame([*texts, (None, "w1 w2"), (7, None), (7, ""), (3, texts[3][1])], "doc_id int, text string")
    kept = []
    plain = ngram_model.stored
    monkeypatch.setattr(ngram_model, "stored", lambda df, name: kept.append(name) or plain(df, name))
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    one, many = (sorted(rows_of(spark, monkeypatch, docs, n).collect(), key=key) for n in (1 << 23, 100))
    assert len(one) == len(many) == 124 and kept == ["word-counts"] * 2
    for a, b in zip(one, many, strict=True):
        assert a[:6] == b[:6]
        assert abs(a.score - b.score) <= 0.3 * a.n_tokens
    # Only a filter's wrong answers depend on its segments.
    assert sum(abs(a.score - b.score) < 1e-9 for a, b in zip(one, many, strict=True)) > 60
    assert rows_of(spark, monkeypatch, docs.limit(0), 100).count() == 0
    assert all(r.score == r.base_score for r in ngram_model.score_texts(docs, crc_mod("doc", 5) < 0).collect())
