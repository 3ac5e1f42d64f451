"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again as the next one's docs.  All but the last return the columns of docs, whatever these are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm import bpe, decontamination, jaccard, pii, toxicity
from symdex.llm.support import shared_dir, table


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with names of further columns that can't clash with an operator's, and all names in the original order."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__kept_{i}" for i, c in enumerate(docs.columns))), docs.columns


def _back(docs: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*like.columns).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; repeated rows are judged each by itself, and null or empty texts like examples without a term."""
    own, names = _apart(docs)
    model = toxicity.fit(own, table(spark, sf_dir, "labels"))
    return _back(toxicity.scored(own, model, own.columns).where("score < 0.5"), own, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; of rows with one doc_id, one."""
    own, names = _apart(docs)
    found = jaccard.near_duplicates(own)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = own.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("__gone"), "left_anti")
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(own.where("doc_id is null"))
    return _back(kept, own, names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold passages of the benchmark to a twentieth of their words or more."""
    own, names = _apart(docs)
    marked = decontamination.contaminated(decontamination.mark(own, table(spark, sf_dir, "benchmark"), own.columns))
    return _back(marked.where("not contaminated"), own, names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts; a null text stays null."""
    return pii.cleaned(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of what they decode to; a null text has none."""
    return bpe.checked(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: The near-duplicate components, the nearest examples and the merges have no SQL that ends in time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
