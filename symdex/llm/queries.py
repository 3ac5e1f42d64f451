"""The registered queries of the corpus operators.

Each reads whole tables and returns its operator's whole result.  Nulls, empty texts, repeated rows and empty tables have the results that the operators'
docstrings state: a null text counts as empty, repeated rows are reported each by itself, an empty table gives an empty result, and further
columns of a table don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, importance, jaccard, lattice, neighbours, oracles, periodic, pii, secret_scan, substrings, token_files, toxicity, warc
from .support import shared_dir, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and the decision."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document with its nearest labelled examples."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a document with a smaller id repeats in runs of 13."""
    return substrings.report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, from a ledger that starts empty."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with scores."""
    return pii.report(table(spark, sf_dir, "documents"))


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return lattice.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in token files that are written and read back; rows without doc_id are left out."""
    to = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return token_files.report(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and number of links of every document."""
    return jaccard.report(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every page in archives that are written and read back."""
    return warc.report(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place of every document in a draw that favours what is like the benchmark."""
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    return periodic.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result it can express; the others are tested against brute force."""
    return {
        "op1_decontamination": oracles.decontamination_sql(),
        "op3_substring_dedup": oracles.substrings_sql(),
        "op4_secret_scan": oracles.secrets_sql(),
        "op5_pii": oracles.personal_data_sql(),
        "op8_ngram_jaccard": oracles.near_duplicates_sql(),
        "op11_warc": oracles.archives_sql(),
    }
