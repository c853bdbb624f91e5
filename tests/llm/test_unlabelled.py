"""The classifier stage where there is nothing to learn from."""

import corpus_pipeline


def test_the_classifier_stage_keeps_all_without_usable_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"A clean text, number {i}.", "s") for i in range(20)] + [(None, None, None)], "doc_id long, text string, source string")
    only_others = [(1000 + i, i % 2, 0) for i in range(20)]
    for name, rows in (("empty", []), ("others", only_others)):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = corpus_pipeline.quality_classifier(spark, docs, f"{tmp_path}/{name}")
        assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)
