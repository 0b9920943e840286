"""Incremental ingestion and windows over event streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.operators import writer


def tumbling(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; on a stream, state older than the watermark goes."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def ingest(docs: DataFrame, root: str, checkpoint: str, *, name: str = "stream", **options):
    """Ingests a stream of normalised documents batch by batch below ``root``; a batch that failed is done again in its own partition.

    Partitions are named by the query's own identifier, which its checkpoint keeps: a stream with another checkpoint has
    partitions of its own, and what it reads again the ledger skips.
    """

    def batch(df: DataFrame, number: int) -> None:
        query = json.loads(df.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        writer.ingest(df, root, f"{name}-{query}-{number}", **options)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
