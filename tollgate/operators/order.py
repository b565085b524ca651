"""Exact positions in a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import ContractError, check
from ..storage import materialize

_LOW = (1 << 33) - 1


def number_partitions(df: DataFrame, name: str = "position") -> DataFrame:
    """Number rows from 0 in their present partition and row order.

    The rows are written with their partition and offset first, so the counts of each partition and
    the numbers made from them see the same rows, whatever is run again. One row a partition is
    broadcast.
    """
    held = materialize(df.withColumn("at_", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("part_", F.shiftright("at_", 33)).withColumn("off_", F.col("at_").bitwiseAND(F.lit(_LOW)))
    sizes = held.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("part_").alias("p_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    out = held.join(F.broadcast(sizes), F.col("part_") == F.col("p_"))
    return out.withColumn(name, F.col("off_") + F.col("before_")).drop("at_", "part_", "off_", "p_", "before_")


def positions(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Add each row's position from 0 in the total ``order``: a range-partitioned sort and one offset a partition."""
    return number_partitions(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def account_codes(txns: DataFrame) -> DataFrame:
    """Exact dense codes (account_id, code) of all accounts in account order, from 1."""
    ids = txns.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id")).distinct()
    return positions(ids, "account_id").select("account_id", (F.col("position") + 1).alias("code"))


def coded(txns: DataFrame) -> DataFrame:
    """Add sender_code and receiver_code, the accounts' dense codes; ``ContractError`` unless every row comes back once."""
    codes = materialize(account_codes(txns), "codes")
    out = txns
    for side in ("sender", "receiver"):
        own = codes.select(F.col("account_id").alias(f"{side}_a"), F.col("code").alias(f"{side}_code"))
        out = out.join(own, F.col(f"{side}_id") == F.col(f"{side}_a")).drop(f"{side}_a")
    out = materialize(out, "coded")
    have, got = txns.count(), out.count()
    check(have == got, ContractError, f"{have} transfers, {got} with account codes")
    return out
