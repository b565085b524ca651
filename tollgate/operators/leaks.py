"""Deliberate leaks, to prove that the harness sees one, and their placebo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import MINUTE, WINDOWS, LeakageError, check
from ..functions.columns import order_key
from .history import account_events, two_sided

KINDS = ("reversed_window", "future_counterparty", "target")
COLUMNS = {
    "reversed_window": ("n_next_1d", "n_next_7d", "max_amt_next_7d"),
    "future_counterparty": ("secs_until_next_cp", "n_future_with_cp"),
    "target": ("account_ever_laundered", "account_laundering_rate"),
}


def plant(txns: DataFrame, kind: str) -> DataFrame:
    """(txn_id, s_ and r_ columns of the kind): windows that face the future, or that hold the label.

    reversed_window turns the history frames forward; future_counterparty looks for the next contact
    with the same counterparty; target sums up the label over an account's whole life.
    """
    check(kind in KINDS, ValueError, f"kind must be one of {KINDS}")
    events = account_events(txns, "is_laundering")
    if kind == "reversed_window":
        ahead = {k: Window.partitionBy("account_id").orderBy("t").rangeBetween(MINUTE, s) for k, s in WINDOWS.items()}
        made = [F.count("*").over(ahead["1d"]), F.count("*").over(ahead["7d"]), F.max("amount_paid").over(ahead["7d"])]
    elif kind == "future_counterparty":
        ahead = Window.partitionBy("account_id", "cp").orderBy("t").rangeBetween(MINUTE, Window.unboundedFollowing)
        made = [F.min("t").over(ahead) - F.col("t"), F.count("*").over(ahead)]
    else:
        made = None
        whole = events.groupBy("account_id").agg(F.max("is_laundering").alias("account_ever_laundered"), F.avg("is_laundering").alias("account_laundering_rate"))
        whole = whole.withColumnRenamed("account_id", "w_account")
        events = events.join(whole, F.col("account_id") == F.col("w_account"))
    if made:
        events = events.select("txn_id", "side", *[c.alias(n) for c, n in zip(made, COLUMNS[kind])])
    return two_sided(events, COLUMNS[kind])


def permute(leak: DataFrame, strata: DataFrame, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """The placebo: the columns' rows dealt anew, as blocks, within each stratum.

    ``strata`` has (txn_id, stratum). Every stratum keeps its multiset of rows; only which transfer
    has which changes, in an order that any engine reproduces.
    """
    rows = leak.join(strata, "txn_id")
    home = Window.partitionBy("stratum").orderBy("txn_id")
    mixed = Window.partitionBy("stratum").orderBy(order_key(F.lit(str(seed)), F.col("txn_id")), "txn_id")
    to = rows.select("txn_id", F.col("stratum").alias("t_stratum"), F.row_number().over(home).alias("t_place"))
    of = rows.select("stratum", F.row_number().over(mixed).alias("place"), *columns)
    out = to.join(of, (F.col("t_stratum") == F.col("stratum")) & (F.col("t_place") == F.col("place")))
    return out.select("txn_id", *columns)


def merge(features: DataFrame, leak: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features with the leak's columns; refuses a partial join, which is not the same as null values."""
    right = leak.select(F.col("txn_id").alias("l_txn_id"), *columns, F.lit(True).alias("matched"))
    out = features.join(right, F.col("txn_id") == F.col("l_txn_id"), "left")
    missing = out.where("matched is null").count()
    check(missing == 0, LeakageError, f"{missing} rows have no leak row")
    return out.drop("l_txn_id", "matched")


def stratum(part: Column, day: Column) -> Column:
    """Split side and day, within which a placebo permutes."""
    return F.concat_ws("|", part, F.date_format(day, "yyyy-MM-dd"))


def verdict(real: Sequence[float], placebo: Sequence[float]) -> dict[str, float | bool]:
    """Whether a channel separates: every paired difference above 0, and the least real ratio above the greatest placebo."""
    diff = [a - b for a, b in zip(real, placebo, strict=True)]
    mean = lambda x: round(sum(x) / len(x), 4)
    return {
        "ap_ratio_real_mean": mean(real), "ap_ratio_placebo_mean": mean(placebo), "paired_diff_mean": mean(diff), "paired_diff_min": round(min(diff), 4),
        "separates_from_placebo": min(diff) > 0 and min(real) > max(placebo),
    }
