"""Expressions with the same value in every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, n: int, seed: str = "") -> Column:
    """Portable hash bucket 0..n-1 of a value's text: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % n


def order_key(*parts: Column | str) -> Column:
    """MD5 of the parts joined by ``|``: a reproducible random order."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def roundness(amount: Column) -> Column:
    """3, 2, 1 or 0: the amount is whole thousands, hundreds, units, or none."""
    return F.when(amount == F.round(amount, -3), 3).when(amount == F.round(amount, -2), 2).when(amount == F.round(amount, 0), 1).otherwise(0)


def epoch(t: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp."""
    return F.unix_timestamp(t.cast("timestamp"))


def day_of_week(t: Column) -> Column:
    """0 Sunday to 6 Saturday."""
    return F.dayofweek(t) - 1
