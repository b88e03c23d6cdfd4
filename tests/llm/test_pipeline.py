"""The stages in turn on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
    assert 0 < docs.count() < 3 * count
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot"} <= set(out.columns)


def test_stages_take_no_rows_and_odd_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, lang_pred string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
