"""Corpus pipeline: quality, near-duplicates, repeated passages, source mix, token ids.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns the rows the next
stage gets. ``run`` writes each stage's rows as Parquet to the shared checkpoint folder and reads them
back. All stages but the last return the columns of ``docs``. Rows are told apart by key and text, so
null keys, repeated keys and repeated rows are handled; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatio.llm import chunk_dedup, mixing, quality_classifier, sentencepiece_codec, simhash
from curatio.llm.common import stored, table

NO_KEY = -(1 << 63)


def _row_key() -> dict[str, Column]:
    """Columns that name a document by key and text, none of them null."""
    return {"_none": F.col("doc_id").isNull(), "_key": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_KEY)),
            "_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go; it learns from all labelled documents here."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    names = list(_row_key())
    good = quality_classifier.classify(docs, labels, carry=_row_key()).filter("predicted = 1").select(*names).distinct()
    return docs.withColumns(_row_key()).join(stored(good, "good"), names, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest key (nulls last), one of its rows."""
    names = list(_row_key())
    found = simhash.near_duplicates(docs, carry=_row_key())
    first = found.groupBy("root").agg(F.min(F.struct(*names)).alias("f")).select("f.*")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy(*names).orderBy(*(others or ["doc_id"]))           # before the join: repeated rows go in the scan's tasks
    rows = docs.withColumns(_row_key()).withColumn("_row", F.row_number().over(one)).filter("_row = 1")
    return rows.join(stored(first, "first"), names, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of later texts; ``n_chars`` follows the text."""
    cut = chunk_dedup.deduplicate(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's row as often as the mix takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether decoding them gives the text back."""
    back = sentencepiece_codec.encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), decoded_col="decoded")
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages),
          ("mixing sources to target weights", source_mix), ("SentencePiece encoding and decoding", token_ids)]

# Fingerprints, rolling hashes, learned weights and subword ids are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n + 1}")
    return docs
