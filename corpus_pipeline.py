"""A training-data pipeline: each stage takes (spark, docs, sf_dir) and its result is written before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, langid, mixing, near_dedup, substring_dedup
from tallyframe.llm.common import WORD, documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # SQL can express neither the classifier nor the encoding; tests hold run() against a plain version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (also null texts and texts without a letter); a null lang is filled with the prediction.

    Trained on docs. Nulls in other columns stay, repeated rows are judged alike, an empty table stays empty.
    """
    x = langid.identify(docs.select(*COLUMNS), langid.train(docs)).where("not rejected")
    return x.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id (null last); documents without words all stay.

    Of rows equal in all columns one stays. An empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 or more words that also stand in a document with a smaller doc_id (null: largest); documents left without a word go.

    Cut texts are their kept words joined by a space; other texts stay as they are. An empty table stays empty.
    """
    return substring_dedup.dedup_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the one at the budget's end is cut at the word.

    Documents without words have nothing to take and go; a null source is a source. Rows equal in doc_id, source and text are
    taken as often as they all are. An empty table stays empty.
    """
    row = F.xxhash64("text")
    taken = mixing.mix_sources(docs.select(*COLUMNS), row=row).where("taken > 0").groupBy("doc_id", "source", "row").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    taken = stored(taken).withColumnsRenamed({"doc_id": "_id", "source": "_source", "row": "_row"})
    x = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"), row.alias("row"))
    if not taken.where("rows > 1").isEmpty():
        x = x.dropDuplicates(["doc_id", "source", "row"])
    x = x.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("row") == F.col("_row")))
    x = x.withColumn("turn", F.explode(F.expr("sequence(0, cast((taken - 1) div size as int))")))
    left = F.least(F.col("taken") - F.col("turn") * F.col("size"), F.col("size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    text = F.when(left == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return x.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row's text; see bpe.encode."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; the results between stages are Parquet in the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k + 1 < len(STAGES) else docs
    return docs
