"""The pipeline's first stage on a table without labels."""

import corpus_pipeline


def test_no_labels(spark):
    texts = ["clean words", "é", None, "", "12 !"]
    df = spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()) == [0, 1]
