"""Watermarked window aggregates of a transfer stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume(transfers: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Transfers and laundering per window of event time; rows later than ``late`` are dropped by the watermark."""
    rows = transfers.withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", size)).agg(F.count("*").alias("transactions"), F.sum("is_laundering").cast("long").alias("laundering"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "transactions", "laundering")


def account_sessions(transfers: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a sender's transfers that are less than ``gap`` apart."""
    rows = transfers.withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy("sender_id", F.session_window("at", gap)).agg(F.count("*").alias("transactions"), F.sum("amount_paid").alias("amount"))
    return out.select("sender_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "transactions", "amount")
