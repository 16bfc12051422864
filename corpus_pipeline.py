"""Corpus pipeline: raw documents to encoded training documents.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.  ``run``
writes each stage's rows as Parquet below the shared checkpoint folder and reads them back for the
next, so a lost executor costs one stage's tasks and no more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, exact_dedup, langid, mixing, near_dedup
from vellum.llm.common import saved
from vellum.llm.queries import rank_file
from vellum.sources.tables import table


# Executors still hold memory of the stages before when the last one encodes.
REMEMBERED_PIECES = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without an identifiable language."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies (five-word
    shingles, similarity of 0.8 or more)."""
    return near_dedup.drop_near(docs, words=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs, F.array("source"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's whole text, and digests of the ids and of
    the text they decode to."""
    return bpe.encode(docs, rank_file(), public_tokenizers.PATTERN, ids="ids", n_tokens="n_tokens", ids_sha256="ids_sha256",
                      decoded_sha256="decoded_sha256", remembered=REMEMBERED_PIECES)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode_bytes),
]

# Language models, links of near copies and byte-pair merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
