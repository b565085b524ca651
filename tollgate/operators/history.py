"""Causal two-sided account history: what an account had done before this minute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..contract import HISTORY, MINUTE, WINDOWS, require
from ..functions.columns import bucket, day_of_week, epoch, ratio, roundness
from ..storage import materialize
from .frames import Times

KEYS = ("txn_id", "event_time", "event_date", "sender_id", "receiver_id", "is_laundering", "ring_id", "typology")
_SPAN = WINDOWS["30d"]
_REAL = ("mean_amt_7d", "std_amt_7d", "max_amt_30d", "out_share_7d", "new_cp_rate_7d")
#: Days of a chunk of a hub's time, and events that make an account a hub.
HUB_DAYS, HUB_EVENTS = 30, 1_000_000
#: Events of the accounts that numpy takes at once, about; a single account may have more.
_GROUP = 1 << 14


def account_events(txns: DataFrame, *extra: str) -> DataFrame:
    """Two events of each transfer, as its sender and its receiver see it, from one scan."""
    side = lambda s, me, other, out: F.struct(F.lit(s).alias("side"), F.col(me).alias("account_id"), F.col(other).alias("cp"), F.lit(out).alias("is_out"))
    both = F.explode(F.array(side("s", "sender_id", "receiver_id", 1), side("r", "receiver_id", "sender_id", 0)))
    rows = txns.select("txn_id", epoch(F.col("event_time")).alias("t"), "amount_paid", *extra, both.alias("e"))
    return rows.select("txn_id", "t", "amount_paid", *extra, "e.*")


def _first_contacts(events: DataFrame) -> DataFrame:
    """Add the seconds of the account's last earlier contact with this counterparty, null where there is none."""
    earlier = Window.partitionBy("account_id", "cp").orderBy("t").rangeBetween(Window.unboundedPreceding, -MINUTE)
    rows = events.withColumn("prev_cp", F.max("t").over(earlier))
    return rows.withColumn("is_new_cp", F.col("prev_cp").isNull().cast("int"))


def history(txns: DataFrame, hub_days: int = HUB_DAYS, hub_events: int = HUB_EVENTS) -> DataFrame:
    """History of every account event: (txn_id, side, the columns of ``HISTORY``).

    Frames end one minute before the event, so it sees neither itself, nor others of its minute, nor
    the future. Counts and sums of an empty frame are 0; means, deviations, maxima, ratios and
    seconds are null on a cold start. All frames share one shuffle on groups of accounts, which numpy
    takes together, as most accounts are small. A frame's values are put together from those of a few
    whole stretches of time, so an account costs n log n in its times, where a sliding window of the
    engine reads each frame anew.

    An account of more than ``hub_events`` events is a hub, and no task holds its whole life: its time
    is cut into chunks of ``hub_days`` days (30 at least), an event is read in its own chunk and, as
    history only, in the next, and the running degree adds the sums of earlier chunks. Values are the
    same. Hubs are found by a count; there are fewer than the events over ``hub_events``.
    """
    if hub_days * 86_400 < _SPAN:
        raise ValueError("a chunk must be as long as the longest frame")
    events = _first_contacts(account_events(require(txns, ("txn_id", "event_time", "amount_paid", "sender_id", "receiver_id"))))
    by, own, earlier = ["account_id"], F.lit(True), F.lit(0)
    ends = txns.select(F.explode(F.array("sender_id", "receiver_id")).alias("hub"))
    sizes = materialize(ends.groupBy("hub").agg(F.count("*").alias("n")), "sizes")
    hubs, total = sizes.where(F.col("n") > hub_events).select("hub"), sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not hubs.isEmpty():
        chunk = F.when(F.col("hub").isNotNull(), F.floor(F.col("t") / (hub_days * 86_400))).otherwise(0)
        events = events.join(hubs, F.col("account_id") == F.col("hub"), "left").withColumn("home", chunk).drop("cp")
        events = materialize(events, "contacts")  # read twice, and its windows cost more than it
        sums = events.where("hub is not null").groupBy("account_id", "home").agg(F.sum("is_new_cp").alias("new"))
        before = Window.partitionBy("account_id").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("account_id").alias("k_account"), F.col("home").alias("k_chunk"), F.coalesce(F.sum("new").over(before), F.lit(0)).alias("new_before"))
        sums = materialize(sums, "degrees")
        seen = F.when(F.col("hub").isNotNull(), F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))
        events = events.withColumn("chunk", F.explode(seen))
        events = events.join(sums, (F.col("account_id") == F.col("k_account")) & (F.col("chunk") == F.col("k_chunk")), "left")
        events = events.where("hub is null or k_chunk is not null")  # a chunk without events of its own asks for nothing
        own, by, earlier = F.col("home") == F.col("chunk"), ["account_id", "chunk"], F.coalesce("new_before", F.lit(0))
    new = F.when(own, F.col("is_new_cp")).otherwise(0).alias("own_new")
    group = F.pmod(F.xxhash64(*by), F.lit(total // _GROUP + 1)).alias("group")
    rows = events.select(group, *by, "txn_id", "side", "t", F.col("amount_paid").cast("double").alias("amount"), "is_out", "is_new_cp", new, "prev_cp", own.alias("own"), F.lit(earlier).cast("long").alias("earlier"))
    kinds = {"side": StringType()} | {c: DoubleType() if c in _REAL else LongType() for c in HISTORY}
    schema = StructType([StructField("txn_id", rows.schema["txn_id"].dataType), *[StructField(c, k) for c, k in kinds.items()]])
    return rows.groupBy("group").applyInArrow(_frames, schema)


#: What events without a time count as; nothing is in their frames.
_NEVER = -(1 << 62)


def _frames(rows: pa.Table) -> pa.Table:
    """History of the ``own`` events of some accounts, or of some chunks of their time.

    These stand behind one another in one time, further apart than the longest frame.
    """
    col = {c: rows[c].combine_chunks() for c in rows.column_names}
    t, timed = col["t"].fill_null(0).to_numpy(), col["t"].is_valid().to_numpy(zero_copy_only=False)
    who = _codes(col["account_id"])
    if "chunk" in col:
        chunk = _codes(col["chunk"])
        _, who = np.unique(who * (chunk.max() + 1) + chunk, return_inverse=True)
    least, most = (f(t[timed]) if timed.any() else 0 for f in (np.min, np.max))
    apart = int(most - least) + _SPAN + 2 * MINUTE
    t = np.where(timed, t - least + who * apart, _NEVER)
    amount, known = col["amount"].fill_null(0.0).to_numpy(), col["amount"].is_valid().to_numpy(zero_copy_only=False)
    times = Times.of(t, amount, known, col["is_out"].to_numpy().astype(np.int64), np.where(timed, col["is_new_cp"].to_numpy(), 0))
    mine = np.flatnonzero(col["own"].to_numpy(zero_copy_only=False))
    at, of = np.unique(t[mine], return_inverse=True)
    values, null = times.features(at)
    # First contacts of the halo are among those of earlier chunks.
    first, when = np.where(timed, col["own_new"].to_numpy(), 0), np.argsort(t, kind="stable")
    ever, when = np.concatenate([[0], np.cumsum(first[when])]), t[when]
    begun = np.where(at == _NEVER, 0, ever[np.searchsorted(when, at // apart * apart)])
    values["n_distinct_cp_ever"] = ever[np.searchsorted(when, at - MINUTE, "right")] - begun
    out = {c: pa.array(values[c][of], mask=null[c][of] if c in null else None) for c in values}
    mine = pa.array(mine)
    out["n_distinct_cp_ever"] = pc.add(out["n_distinct_cp_ever"], col["earlier"].take(mine))
    out["secs_since_prev_cp"] = pc.subtract(col["t"], col["prev_cp"]).take(mine)
    return pa.table({"txn_id": col["txn_id"].take(mine), "side": col["side"].take(mine)} | {c: out[c] for c in HISTORY})


def _codes(values: pa.Array) -> np.ndarray:
    """A number from 0 for each distinct value, null among them."""
    return values.dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def transaction_features(txns: DataFrame) -> list[Column]:
    """The twelve features that a transfer has by itself; categories get a portable code below 1000."""
    paid, got, t = F.col("amount_paid"), F.col("amount_received"), F.col("event_time")
    flag = lambda c, name: c.cast("tinyint").alias(name)
    return [
        F.log1p(paid).alias("log_amount_paid"), F.log1p(got).alias("log_amount_received"), ratio(got, paid).alias("fx_ratio"),
        flag(F.col("payment_currency") != F.col("receiving_currency"), "currency_mismatch"), roundness(paid).alias("amount_roundness"),
        F.hour(t).alias("hour"), day_of_week(t).alias("dayofweek"), flag(day_of_week(t).isin(0, 6), "is_weekend"),
        flag(F.col("sender_id") == F.col("receiver_id"), "is_self_transfer"), flag(F.col("sender_bank") != F.col("receiver_bank"), "is_cross_bank"),
        bucket(F.col("payment_format"), 1000).alias("payment_format_code"), bucket(F.col("payment_currency"), 1000).alias("payment_currency_code"),
    ]


def two_sided(sides: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Event rows folded to one row a transfer, ``s_`` and ``r_`` columns: one aggregation instead of two joins."""
    one = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    return sides.groupBy("txn_id").agg(*[one(s, c) for s in "sr" for c in columns])


def feature_table(txns: DataFrame, hub_days: int = HUB_DAYS, hub_events: int = HUB_EVENTS) -> DataFrame:
    """Keys, the twelve transfer features, both sides' history and the amounts against both means."""
    folded = two_sided(history(txns, hub_days, hub_events), HISTORY).withColumnRenamed("txn_id", "h_txn_id")
    rows = txns.select(*KEYS, "amount_paid", *transaction_features(txns)).join(folded, F.col("txn_id") == F.col("h_txn_id"), "left").drop("h_txn_id")
    for s in "sr":
        rows = rows.withColumn(f"{s}_amt_vs_hist", ratio(F.col("amount_paid"), F.col(f"{s}_mean_amt_7d")))
    return rows.drop("amount_paid")


def feature_summary(features: DataFrame) -> DataFrame:
    """One row: size, positives, and how many senders start cold."""
    return features.agg(
        F.count("*").alias("rows"), F.sum("is_laundering").cast("long").alias("positives"),
        F.round(100 * F.avg((F.col("s_n_7d") == 0).cast("int")), 2).alias("pct_sender_no_7d_history"),
        F.round(100 * F.avg(F.col("s_secs_since_prev").isNull().cast("int")), 2).alias("pct_sender_first_ever_txn"),
    )
