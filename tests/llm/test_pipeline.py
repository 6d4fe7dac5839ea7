"""The pipeline's stages on a table with planted cases."""

import corpus_pipeline
from reviewfold.llm.common import stored
from tests.llm.samples import awkward_rows, documents, words


def test_stages(spark, tmp_path):
    insults = [(100 + i, f"{words(i, 40)} wretchling {words(i + 500, 20)}") for i in range(40)]
    clean = [(200 + i, words(i + 1000, 80)) for i in range(120)]
    rows = [r for r in awkward_rows() if r[0] is not None] + insults + clean
    docs = documents(spark, rows)
    labels = [(i, 1) for i, _ in insults] + [(i, 0) for i, _ in clean]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, str(tmp_path)), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs, kept[name] = after, {r.doc_id for r in after.collect()}
    ids = {i for i, _ in clean}
    assert not kept["toxicity"] & {i for i, _ in insults}
    assert all(ids <= found for found in kept.values())
    assert {6, 8, 9, 10} <= kept["toxicity"] and 7 in kept["toxicity"]
    # Of 2, 3, 4 the longest blank text stays; case tells 1 from 5.
    assert {1, 5, 4, 6} <= kept["exact_dedup"] and not {2, 3, 7} & kept["exact_dedup"]
    assert {1, 8} <= kept["near_dedup"] and not {5, 9, 10} & kept["near_dedup"]
    assert kept["near_dedup"] == kept["substring_dedup"] == kept["best_fit_packing"]


def test_rows_travel_in_small_batches(spark, tmp_path):
    """Neither an executor nor its worker holds ten thousand texts at once."""
    before = spark.conf.get(corpus_pipeline._ARROW_ROWS)
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1)
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    try:
        for _, stage in corpus_pipeline.STAGES[:4]:
            spark.conf.set(corpus_pipeline._ARROW_ROWS, before)
            stage(spark, docs.limit(50), str(tmp_path))
            found = [r.rows for r in docs.mapInArrow(sizes, "rows long").collect()]
            assert sum(found) == 9000 and max(found) <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline._ARROW_ROWS, "500")
        corpus_pipeline.without_copies(spark, docs, str(tmp_path))
        assert spark.conf.get(corpus_pipeline._ARROW_ROWS) == "500"
    finally:
        spark.conf.set(corpus_pipeline._ARROW_ROWS, before)
