"""From raw documents to packed training sequences: quality, toxicity, near duplicates, personal data, packing.

Each stage takes what its predecessor kept. All but the last return the columns of `documents`, and any others that the
rows have, whatever their names. A null text counts as empty where a text is scored, compared or cut, and stays null. A
stage of an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import near_copies, packing, pii, quality, toxicity
from quarrymill.sources import importable, read_table
from quarrymill.sources.tables import ensure_checkpoint_dir, remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Equal texts are judged alike; without labels of both classes all stay."""
    importable(spark)
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Equal texts are judged alike; without labels of both classes all stay."""
    importable(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that 5-word Jaccard similarities of 0.8 or more join.

    The one of the least id stays, of rows that repeat it the one of the least hash of its text, and one of equal rows. Empty
    texts are one group. Rows of a null id can't be named as copies and stay.
    """
    importable(spark)
    return near_copies.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; n_chars follows. A null text stays null; its n_chars is null."""
    importable(spark)
    model = pii.fit(docs)
    clean = docs.withColumn("text", pii.redacted(F.col("text"), model))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of at most 2048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("toxicity", keep_clean), ("simhash", keep_one_of_each), ("pii", redact), ("packing", pack)]

#: The stages learn from labels and hash words, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table of documents.

    Between stages, rows are written as Parquet to the shared folder and read again; what a stage has read goes when it is
    done. What the last one reads stays as long as its result may be computed again.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
