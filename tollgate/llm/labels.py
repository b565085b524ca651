"""Labelled rows for the classifiers: which may be learned from, and which are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document may not be learned from: remainder 1; false for a null id."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """One row (l_id, y) of each id that may be learned from; several labels of one id give the larger."""
    rows = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("y"))
    rows = rows.where(F.col("y").isin(0.0, 1.0) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    return rows.groupBy("l_id").agg(F.max("y").alias("y"))
