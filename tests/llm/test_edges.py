"""Empty tables, clashing columns and ids, repeated rows and long texts through whole stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from quadrille.llm import embedding_dedup, exact_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, fp int, rank int, digest int, place int, removed int, removed_ int, label int, root int, key int, size int"


def row(k, text, lang="en"):
    return (k, text, lang, "s", len(text or ""), *range(11))


def test_pipeline_on_clashing_columns_and_ids(spark, tmp_path):
    words = "one two three four five six seven eight nine ten"
    texts = ["A first text of more than five words stands here. It has two sentences of its own.", "Another one, which shares nothing with the rest of them at all. Nothing.", words * 3]
    rows = [row(1, texts[0]), row(1, texts[1]), row(None, texts[2]), row(None, texts[2]), row(2, texts[0].upper()), row(3, None), row(4, ""), row(5, "12"), row(1, texts[0])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        left.append(sorted((str(r.doc_id), r.text) for r in docs.collect()))
    assert len(left[0]) == 6
    assert left[1] == left[2] == left[3] == sorted([("2", texts[0].upper()), ("1", texts[1]), ("None", texts[2])])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "None"] and len({r.sequence_id for r in out}) == 1
    offsets = sorted((r.offset, r.length) for r in out)
    assert offsets[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:], strict=False))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_copies_of_a_long_text(spark):
    long = "Long Text " * 400_000
    df = spark.createDataFrame([row(1, long), row(2, long.lower()), row(3, long + "x")], SCHEMA)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [2, 3]
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.label_copies(df).orderBy("doc_id").collect()] == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_repeats_within_empty_long_and_repeated_rows(spark):
    unit = "This unit has more than five words. "
    df = spark.createDataFrame([row(1, "Alone it stands with some more words here. " + unit * 20_000), row(2, unit), row(2, unit), row(3, "")], SCHEMA)
    got = sorted((r.doc_id, r.text.strip()) for r in substring_dedup.remove_repeats(df, unit="sentence").collect())
    assert got == [(1, "Alone it stands with some more words here. " + unit.strip()), (2, ""), (2, ""), (3, "")]
    assert substring_dedup.remove_repeats(df.limit(0), unit="sentence").count() == 0


def test_vectors_without_ids_and_with_other_columns(spark):
    rows = [(1, [1.0, 0.0], 0, 5), (2, [1.0, 0.0], 0, 6), (2, [1.0, 0.0], 0, 7), (None, [1.0, 0.0], 0, 8), (3, [0.0, 1.0], 0, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(df.where(F.lit(False))).count() == 0
