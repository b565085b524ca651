"""Attach rings to transfers by their content, and count what the attachment found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("event_time", "sender_id", "receiver_id", "payment_format")


def ring_keys(ring_txns: DataFrame) -> DataFrame:
    """One row per content key: the least ring and, on its own, the least typology, with how many rings claim the key."""
    keys = ring_txns.groupBy(*KEYS, F.round("amount_paid", 2).alias("amount_2"))
    return keys.agg(F.min("ring_id").alias("ring_id"), F.min("typology").alias("typology"), F.count_distinct("ring_id").alias("n_rings"))


def attach_rings(txns: DataFrame, ring_txns: DataFrame) -> DataFrame:
    """Every transfer with the nullable ring_id and typology of its content key.

    The ring side has one row a key, so no transfer is repeated; adaptive execution broadcasts it
    where it is small enough.
    """
    keys = ring_keys(ring_txns)
    keys = keys.select(*[F.col(k).alias(f"k_{k}") for k in (*KEYS, "amount_2")], "ring_id", "typology")
    on = [F.col(k) == F.col(f"k_{k}") for k in KEYS] + [F.round("amount_paid", 2) == F.col("k_amount_2")]
    plain = txns.drop("ring_id", "typology")
    return plain.join(keys, on, "left").select(*plain.columns, "ring_id", "typology")


def reconcile(labeled: DataFrame, ring_txns: DataFrame) -> DataFrame:
    """One row: how labels and rings agree."""
    flag, ring = F.col("is_laundering") == 1, F.col("ring_id").isNotNull()
    counts = labeled.agg(
        F.count("*").alias("rows"), F.count_if(flag).alias("flagged_txns"), F.count_if(ring).alias("with_ring"), F.count_if(flag & ring).alias("flagged_with_ring"),
        F.count_if(flag & ~ring).alias("flagged_without_ring"), F.count_if((F.col("is_laundering") == 0) & ring).alias("unflagged_but_in_a_ring"),
    )
    keys = ring_keys(ring_txns).agg(F.count_if(F.col("n_rings") > 1).alias("ambiguous_content_keys"))
    total = ring_txns.agg(F.count("*").alias("ring_txns_in_patterns_file"))
    out = counts.crossJoin(keys).crossJoin(total)  # three single rows
    share = F.round(100.0 * F.col("flagged_with_ring") / F.nullif("flagged_txns", F.lit(0)), 2)
    return out.select(
        "rows", "flagged_txns", "ring_txns_in_patterns_file", "flagged_with_ring", "flagged_without_ring", share.alias("typology_coverage_pct"),
        "unflagged_but_in_a_ring", (F.col("ring_txns_in_patterns_file") - F.col("with_ring")).alias("ring_txns_not_found_in_trans"), "ambiguous_content_keys",
    )
