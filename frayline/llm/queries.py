"""The queries opN_<name> over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_prefix, decision_list, decontaminate, filter_audit, hilbert_shards, jaccard_join, language_id, license_scan, pseudo_likelihood, quality_rda, syncmers, token_alignment, warc_chunks,
)
from .durable import workers_find_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % n


def op1_quality_rda(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(5) == 0
    scored = quality_rda.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert_shards.shard_documents(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision_list.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_prefix.bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_chunks.archive_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), notices=True).drop("blocks")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(4) == 2
    model = language_id.fit_language_model(docs, ~held_out)
    return language_id.identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rda": op1_quality_rda,
        "op2_decontamination": op2_decontamination,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_pseudo_likelihood": op4_pseudo_likelihood,
        "op5_decision_list": op5_decision_list,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_bpe_prefix": op7_bpe_prefix,
        "op8_warc_chunks": op8_warc_chunks,
        "op9_license_scan": op9_license_scan,
        "op10_language_id": op10_language_id,
        "op11_token_alignment": op11_token_alignment,
        "op12_syncmers": op12_syncmers,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": filter_audit.AUDIT_SQL}
