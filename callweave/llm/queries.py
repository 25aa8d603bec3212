"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, decontam, html, infill, jpeg, langid, pii, recurrent, secrets, simhash, suffixes, warc
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.report(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_repeated_passages": op2_repeated_passages,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_progressive_jpeg": op5_progressive_jpeg,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_pii": op7_pii,
        "op8_warc": op8_warc,
        "op9_simhash": op9_simhash,
        "op10_main_text": op10_main_text,
        "op11_language_model": op11_language_model,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.oracle_sql(),
        "op2_repeated_passages": suffixes.oracle_sql(),
        "op4_decontamination": decontam.oracle_sql(),
        "op8_warc": warc.oracle_sql(),
        "op12_fill_in_middle": infill.oracle_sql(),
        "op13_vector_codes": codebooks.oracle_sql(),
    }
