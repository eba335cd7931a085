"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns the packed pieces. ``run`` writes each stage's result to the cluster's shared folder and reads it
again as the next one's input, so a lost executor costs tasks and no stage.

Defined results: null texts and texts without a letter go in the first stage, and empty ones with them; rows with a null
doc_id are documents like any other and rank below all others among copies and near copies; rows with one doc_id and
different texts are different documents; of repeated rows one stays; a text of any length is read whole; an empty table gives an empty result; extra columns stay up to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from quadrille.llm.common import free_name, staged
from quadrille.llm.queries import tokenizer_path
from quadrille.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and those without a letter; a letter is enough where the table has no labels to tell a language by."""
    ship(spark)
    lang, score = free_name(docs, "lang"), free_name(docs, "score")
    model = language_id.fit(docs)
    told = language_id.predict(docs, model, lang_out=lang, score_out=score)
    return told.where((F.col(lang) != language_id.UNKNOWN) | F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest doc_id stays."""
    ship(spark)
    return simhash.keep_first(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages seen earlier are cut out; n_chars follows."""
    ship(spark)
    # The stage's own column is called removed: one of that name waits under another.
    held = {c: free_name(docs, "held") for c in docs.columns if c.lower() == "removed"}
    out = substring_dedup.remove_repeats(docs.withColumnsRenamed(held), whole=True).drop("removed")
    out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed({new: c for c, new in held.items()}).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

#: The language model, the fingerprints, the tokenizer and the packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
