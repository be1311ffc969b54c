"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that calls one operator and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last keep the
columns of ``documents``. Stages decide row by row or group by group over everything they get; null
ids, null texts, repeated rows and extra columns pass through like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import language_id, packing, quality_gam, simhash
from pairforge.llm.common import crc_fold, documents, stage, table

#: A document goes if less than this share of the possible rank agreement is left for its best language.
LEAST_LANGUAGE = 0.2
#: A document goes if its probability of being good is below this; under one half, so that doubtful ones stay.
LEAST_QUALITY = 0.35
#: Documents are near-duplicates from this Jaccard similarity of their sets of runs of so many words.
DUPLICATE_WORDS, DUPLICATE_LEAST = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or unlike any learned language."""
    profiles = language_id.fit_profiles(docs.where(crc_fold("doc_id", 5) != 0), order_col="doc_id")
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = language_id.identify(rows, profiles, id_col="row")
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier finds unlikely to be labelled good."""
    labels = quality_gam.training_labels(table(spark, sf_dir, "labels"))
    model = quality_gam.train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality_gam.classify(rows, model, id_col="row").where(F.col("score") >= LEAST_QUALITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates; among rows of one id, one."""
    row = "row"
    while row in docs.columns:
        row += "_"
    held = stage(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)
    groups = simhash.similar_groups(held, row, words=DUPLICATE_WORDS, similarity=DUPLICATE_LEAST)
    first = held.select(row, key.alias("key_")).join(groups, row).groupBy("root").agg(F.min("key_").alias("key_")).select(F.col("key_")[row].alias(row))
    return held.join(first, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Language profiles, boosted trees, tokenizer ids and graph components are beyond SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, work in STAGES:
        docs = stage(spark, work(spark, docs, sf_dir), name)
    return docs
