"""Corpus pipeline: from raw documents to token counts, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; a stage's result is written as Parquet and read again as the
next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callweave.llm import bpe, decontam, langid, nearcopies, pii
from callweave.llm.common import materialise, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without letters go.

    Ties between languages reject nothing, repeated rows stay, an empty table stays empty.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and near copies, the document of the smallest id.

    Null ids come last, rows that repeat id and text stay together, texts without words are
    one group, an empty table stays empty.
    """
    return nearcopies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null texts and texts without words leak none.

    Repeated rows stay or go together; where either table is empty all documents stay.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars kept true.

    Null texts stay null, texts without findings and repeated rows stay as they are.
    """
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number and the digest of their token ids, and of what these decode to.

    Null and empty texts have no tokens; repeated rows give repeated results.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("encode", encode),
]

#: Fingerprints, the random field and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
