"""Queries of the training-data operators: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, editcount, gif, langid, licences, ordinal, packing, repair, rules, shards, simhash, suffix, veccodes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.repeated_spans(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = editcount.count_tokens(_read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", F.sha2("edited", 256).alias("edited_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair_conversations(repair.damage(_read(spark, sf_dir, "conversations")), present="present"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = gif.features(gif.store(_read(spark, sf_dir, "documents")), ["doc_id", "n_bytes", "media"])
    bins = F.array_join(F.filter(F.transform("histogram", lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull()), " ")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat("n_frames", F.lit(" frames")), F.concat("duration_ms", F.lit(" ms")), bins, "problem").alias("feature"),
    )


def queries() -> dict:
    own = [op1_training_order, op2_suffix_dedup, op3_decontaminate, op4_language, op5_ordinal_quality, op6_licences, op7_simhash, op8_token_counts, op9_quality_rules, op10_packing, op11_structure_repair, op12_vector_codes, op13_gif]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None of the thirteen can be stated in SQL at a bearable cost; tests/llm holds them against brute force."""
    return {}
