"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm import packing, quality_rules, secret_scan, shingle_join, source_mixing
from fileledger.sources.scratch import new_path, written

#: Share of the tokens that mixing keeps.
MIX = source_mixing.Mix(fraction=0.9)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Each row is judged by its own text, also where ids are null or repeat."""
    text_hash = "_text_hash" + "_" * max(map(len, docs.columns))  # longer than any column, so it clashes with none
    rows = docs.withColumn(text_hash, F.xxhash64("text"))
    judged = quality_rules.judge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), also=[text_hash])
    gone = judged.where("not kept").select(F.col("doc_id").alias(f"{text_hash}_id"), F.col(text_hash).alias(f"{text_hash}_of")).distinct()
    return rows.join(gone, F.col("doc_id").eqNullSafe(gone[f"{text_hash}_id"]) & (rows[text_hash] == gone[f"{text_hash}_of"]), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id.  Of rows that repeat an id and its text one stays; rows without an id all stay."""
    found = shingle_join.link_components(docs).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("gone"), (F.count(F.lit(1)) > 1).alias("several")).where("gone or several")
    ids = written(ids, "pipeline-ids")
    once = docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(docs.join(ids.where("not gone"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by marks; n_chars follows the text."""
    return secret_scan.redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, by probabilities raked to the target shares."""
    return source_mixing.take(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secrets),
    ("source_mixing", mixing),
    ("packing", pack),
]

#: The forest and the raking are iterative; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")
