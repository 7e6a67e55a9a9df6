"""From raw documents to packed token sequences.

Each stage works on all that its predecessor kept. Stages but the last return the columns of documents; what a stage
removes or rewrites is gone for the next. n_chars always tells the length of text.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import langid, packing, pii, simhash, suffix
from shelfline.llm.common import shared_folder, table

OTHERS = ("lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known; null texts and those without a letter are rejected."""
    return langid.identified(docs, langid.fit(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints lie within the operator's distance."""
    return simhash.representatives(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document may be empty afterwards."""
    kept = suffix.without_repeats(docs, carried=OTHERS)
    return as_documents(docs, kept.withColumn("text", suffix.as_text()))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind."""
    rows = docs.select(F.struct("doc_id", *OTHERS).alias("row"), "text")
    found = pii.find(rows, pii.fit(docs), key="row")
    return as_documents(docs, found.select("row.*", pii.redacted().alias("text")))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def as_documents(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns and types of docs, with the length of the changed text."""
    counted = changed.withColumn("n_chars", F.char_length("text"))
    return counted.select(*(F.col(name).cast(kind).alias(name) for name, kind in docs.dtypes))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *OTHERS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
