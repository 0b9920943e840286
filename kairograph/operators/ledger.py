"""Idempotent ingestion: keys, hashes and an append-only ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions import text as T


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds ``episode_key`` and ``content_hash`` to ``source_type, id_source, body`` (and ``modified_at`` if there)."""
    modified = F.col("modified_at") if "modified_at" in docs.columns else None
    key = T.episode_key(F.col("source_type"), F.col("id_source").cast("string"), F.col("body"), modified)
    return docs.withColumns({"episode_key": key, "content_hash": T.content_hash(F.col("body"))})


def latest(ledger: DataFrame) -> DataFrame:
    """The newest row of each key: a grouped maximum, so that hot keys are combined before the shuffle."""
    others = [c for c in ledger.columns if c not in ("episode_key", "ingested_at")]
    best = ledger.groupBy("episode_key").agg(F.max(F.struct("ingested_at", *others)).alias("r"))
    return best.select("episode_key", *[F.col(f"r.{c}").alias(c) for c in ("ingested_at", *others)])


def not_ingested(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents whose key isn't in the ledger with the same content."""
    return docs.join(latest(ledger).select("episode_key", "content_hash"), ["episode_key", "content_hash"], "left_anti")


def first_of_each(docs: DataFrame, by: str, order: str) -> DataFrame:
    """For each value of ``by``, the least ``order`` and how many rows share it."""
    return docs.groupBy(by).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def migrate_keys(ledger: DataFrame) -> DataFrame:
    """Keys with forward slashes; where a key exists in both forms, the row that had it already stays."""
    rows = ledger.withColumn("old", F.col("episode_key").contains("\\")).withColumn("episode_key", F.translate("episode_key", "\\", "/"))
    others = [c for c in ledger.columns if c != "episode_key"]
    best = rows.groupBy("episode_key").agg(F.min(F.struct("old", *others)).alias("r"))
    return best.select("episode_key", *[F.col(f"r.{c}").alias(c) for c in others])


def totals(results: DataFrame) -> DataFrame:
    """Batch totals of rows ``skipped, nodes, edges``."""
    return results.agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("skipped")).alias("skipped"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
