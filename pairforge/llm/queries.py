"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bestfit_packing, hamming_topk, iso_media, katz_lm, language_id, license_scan, packing, quality_gam, sentencepiece_codec, simhash, source_audit, token_counts, whitening
from .common import crc_fold, documents, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again."""
    docs = documents(spark, sf_dir)
    ids = sentencepiece_codec.encode(docs, keep=(F.col("text"),)).withColumnRenamed("keep_0", "text")
    back = sentencepiece_codec.decode(ids, keep=(F.xxhash64(F.coalesce("text", F.lit(""))), F.length(F.coalesce("text", F.lit(""))), F.size("ids"), F.xxhash64("ids")))
    same = (F.xxhash64("decoded") == F.col("keep_0")) & (F.length("decoded") == F.col("keep_1"))
    return back.select("doc_id", F.col("keep_2").cast("long").alias("n_pieces"), F.col("keep_3").alias("ids_hash"), same.alias("round_trip"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select("vec_id", hamming_topk.sign_code(F.col("embedding")).alias("code"))
    return hamming_topk.top_k(codes, F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS BIGINT) AS distance
  FROM v q CROSS JOIN v r WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score(documents(spark, sf_dir), crc_fold("doc_id", 10) == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), crc_fold("doc_id", 5)
    profiles = language_id.fit_profiles(docs.where(fold != 0), order_col="doc_id")
    found = language_id.identify(docs, profiles, keep=(fold == 0,))
    return found.withColumnRenamed("keep_0", "held_out")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = iso_media.store_media(documents(spark, sf_dir).select("doc_id", "text"))
    # The id travels with the unpadded length, so that no join is needed to bring them together.
    stored = stored.select(F.struct("doc_id", "n_bytes").alias("key"), "media")
    read = iso_media.read_media(stored, "key", "media", with_payload=True)
    track, keys = F.col("tracks")[0], F.col("tracks")[0]["keyframes"]
    feature = F.concat_ws(
        ";",
        F.col("brand"),
        track["codec"],
        F.concat_ws("/", track["duration"], track["timescale"]),
        F.concat(F.size(keys), F.lit(" keyframes")),
        F.concat_ws("+", keys[0]["offset"], keys[0]["length"]),
        F.concat_ws("+", F.element_at(keys, -1)["offset"], F.element_at(keys, -1)["length"]),
    )
    return read.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("key.n_bytes").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        track["codec"].alias("codec"),
        (track["duration"] / track["timescale"]).alias("duration_s"),
        F.size(keys).cast("long").alias("n_keyframes"),
        F.transform(keys, lambda k: F.struct(k["offset"].alias("offset"), k["length"].alias("length"))).alias("keyframes"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), crc_fold("doc_id", 3)
    model = quality_gam.train(docs, quality_gam.training_labels(table(spark, sf_dir, "labels")))
    return quality_gam.classify(docs, model, keep=(fold == 1,)).withColumnRenamed("keep_0", "held_out")


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_best_fit(documents(spark, sf_dir), with_ids=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_katz_lm": op5_katz_lm,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_media_columns": op9_media_columns,
    "op10_quality": op10_quality,
    "op11_bestfit": op11_bestfit,
    "op12_whitening": op12_whitening,
    "op13_source_audit": op13_source_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_hamming_topk": OP2_SQL, "op4_license_scan": license_scan.oracle(), "op13_source_audit": source_audit.oracle()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
