"""Train and test by time, without a ring or a ring's account on both sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import LeakageError, check
from ..functions.columns import bucket

PROTOCOLS = ("ring-aware", "naive")
FRACTIONS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def rings_of(labeled: DataFrame) -> DataFrame:
    """Rings seen in labelled transfers: (ring_id, typology, start_time, end_time, n_txns)."""
    rows = labeled.where("ring_id is not null").groupBy("ring_id")
    return rows.agg(F.min("typology").alias("typology"), F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"), F.count("*").alias("n_txns"))


def ring_accounts_of(labeled: DataFrame) -> DataFrame:
    """The bridge (ring_id, account_id)."""
    rows = labeled.where("ring_id is not null")
    return rows.select("ring_id", F.explode(F.array("sender_id", "receiver_id")).alias("account_id")).distinct()


def ring_sides(rings: DataFrame, accounts: DataFrame, cut: str) -> DataFrame:
    """Each ring's side at the cut: train, kept (test) or dropped.

    A test ring with any account that a train ring has is dropped whole.
    """
    at = F.lit(cut).cast("timestamp_ntz")
    sides = rings.select("ring_id", F.when(F.col("start_time") < at, "train").otherwise("test").alias("side"))
    members = accounts.join(sides, "ring_id")
    train = members.where("side = 'train'").select("account_id").distinct()
    shared = members.where("side = 'test'").join(train, "account_id", "left_semi").select("ring_id").distinct()
    shared = shared.select(F.col("ring_id").alias("x_ring"))
    out = sides.join(shared, F.col("ring_id") == F.col("x_ring"), "left")
    return out.select("ring_id", F.when(F.col("side") == "train", "train").when(F.col("x_ring").isNotNull(), "dropped").otherwise("kept").alias("side"))


def split_sets(rings: DataFrame, accounts: DataFrame, cut: str) -> DataFrame:
    """One row: sizes of the sets that the cut makes."""
    sides = ring_sides(rings, accounts, cut)
    members = accounts.join(sides, "ring_id")
    test = members.where("side != 'train'").select("account_id")
    overlap = members.where("side = 'train'").select("account_id").intersect(test).agg(F.count("*").alias("overlap_accounts"))
    counts = sides.agg(
        F.count_if(F.col("side") == "train").alias("train_rings"), F.count_if(F.col("side") != "train").alias("test_rings_raw"),
        F.count_if(F.col("side") == "dropped").alias("dropped_rings"), F.count_if(F.col("side") == "kept").alias("test_rings"),
    )
    return counts.crossJoin(overlap)  # two single rows


def sweep(rings: DataFrame, accounts: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """What each candidate cut costs and keeps: all fractions in one pass over rings and accounts.

    A cut lies a fraction of the whole days between the first and the last ring start after the
    first, at midnight.
    """
    spark = rings.sparkSession
    ends = rings.agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"), F.count_distinct("typology").alias("n_typ")).first()
    if ends["lo"] is None:
        return spark.createDataFrame([], "frac double, cut string, train_rings long, test_rings_raw long, straddling long, overlap_accounts long, dropped long, test_rings_kept long, per_typology long")
    cuts = [(f, (ends["lo"] + timedelta(days=(ends["hi"] - ends["lo"]).days * f)).strftime("%Y-%m-%d")) for f in fractions]
    cuts = spark.createDataFrame(cuts, "frac double, cut string")
    early = F.col("start_time") < F.col("cut").cast("timestamp_ntz")
    rows = rings.join(F.broadcast(cuts))  # a handful of cuts
    rings_at = rows.select("frac", "cut", "ring_id", early.alias("train"), (early & (F.col("end_time") >= F.col("cut").cast("timestamp_ntz"))).alias("straddles"))
    members = accounts.join(rings_at, "ring_id")
    both = members.groupBy("frac", "account_id").agg(F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_test")).where("in_train and in_test")
    lost = members.where("not train").join(both.select("frac", "account_id"), ["frac", "account_id"], "left_semi").groupBy("frac").agg(F.count_distinct("ring_id").alias("dropped"))
    shared = both.groupBy("frac").agg(F.count("*").alias("overlap_accounts"))
    out = rings_at.groupBy("frac", "cut").agg(
        F.count_if("train").alias("train_rings"), F.count_if(~F.col("train")).alias("test_rings_raw"), F.count_if("straddles").alias("straddling"),
    )
    out = out.join(lost, "frac", "left").join(shared, "frac", "left").na.fill(0, ["dropped", "overlap_accounts"])
    kept = F.col("test_rings_raw") - F.col("dropped")
    per = F.bround(kept / F.lit(max(ends["n_typ"], 1)), 0).cast("long")
    return out.select("frac", "cut", "train_rings", "test_rings_raw", "straddling", "overlap_accounts", "dropped", kept.alias("test_rings_kept"), per.alias("per_typology"))


def _dated(cut: str, after: bool) -> str:
    """The cut on the partition column too, so that whole days are pruned."""
    day = datetime.fromisoformat(cut).date()
    return f"event_date >= DATE'{day}'" if after else f"event_date <= DATE'{day}'"


def split_rows(labeled: DataFrame, sides: DataFrame, cut: str, protocol: str = "ring-aware") -> DataFrame:
    """Transfers of either side with ``part`` train or test; naive keeps every ring's rows in test."""
    check(protocol in PROTOCOLS, ValueError, f"protocol must be one of {PROTOCOLS}")
    at = F.lit(cut).cast("timestamp_ntz")
    train = labeled.where(_dated(cut, False)).where(F.col("event_time") < at).withColumn("part", F.lit("train"))
    test = labeled.where(_dated(cut, True)).where(F.col("event_time") >= at)
    if protocol == "ring-aware":
        kept = sides.where("side = 'kept'").select(F.col("ring_id").alias("kept_ring"))
        test = test.join(kept, F.col("ring_id") == F.col("kept_ring"), "left").where("ring_id is null or kept_ring is not null").drop("kept_ring")
    return train.unionByName(test.withColumn("part", F.lit("test")))


def positive_account_days(rows: DataFrame) -> DataFrame:
    """Account-days of test rows: (acct, event_date, y, unlabeled)."""
    ends = rows.select("event_date", "is_laundering", F.col("ring_id").isNull().cast("int").alias("unlabeled"), F.explode(F.array("sender_id", "receiver_id")).alias("acct"))
    return ends.groupBy("acct", "event_date").agg(F.max("is_laundering").alias("y"), F.max("unlabeled").alias("unlabeled"))


def option_b(test: DataFrame, accounts: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: test account-days, positive ones, and positive unringed ones of accounts that a train ring has."""
    train = accounts.join(sides.where("side = 'train'"), "ring_id").select(F.col("account_id").alias("t_acct"), F.lit(True).alias("in_train")).distinct()
    days = positive_account_days(test).join(train, F.col("acct") == F.col("t_acct"), "left")
    return days.agg(
        F.count("*").alias("test_total_account_days"), F.count_if(F.col("y") == 1).alias("test_positive_account_days"),
        F.count_if((F.col("y") == 1) & (F.col("unlabeled") == 1) & F.col("in_train")).alias("unlabeled_positive_acct_days_touching_train_rings"),
    )


def train_sample(rows: DataFrame, share: float) -> DataFrame:
    """A reproducible sample that keeps rings whole: by ring where there is one, else by transfer. For train rows only."""
    check(isinstance(share, (int, float)) and 0 < share <= 1, ValueError, f"share must be in (0, 1], got {share!r}")
    if share == 1:
        return rows
    at = F.when(F.col("ring_id").isNull(), bucket(F.col("txn_id"), 10_000)).otherwise(bucket(F.col("ring_id"), 10_000))
    return rows.where(at < int(share * 10_000))


@dataclass(frozen=True)
class SplitReport:
    """What a split must record; ``assertions`` names the checks that it passed."""

    counts: dict[str, int | float]
    protocol: str
    assertions: tuple[str, ...]


def assert_split(rows: DataFrame, accounts: DataFrame, sides: DataFrame, cut: str, protocol: str = "ring-aware", min_positive: int = 100) -> SplitReport:
    """Check a materialised split, or raise ``LeakageError``: rings and ring accounts disjoint, no bleed over the cut, no ring tails, enough positives."""
    at = F.lit(cut).cast("timestamp_ntz")
    bleed = ((F.col("part") == "train") & (F.col("event_time") >= at)) | ((F.col("part") == "test") & (F.col("event_time") < at))
    train_ring = F.col("side") == "train"
    tagged = rows.join(sides.withColumnRenamed("ring_id", "s_ring"), F.col("ring_id") == F.col("s_ring"), "left")
    got = tagged.agg(
        F.count_if(bleed).alias("bleed"), F.count_if((F.col("part") == "test") & train_ring).alias("tails"),
        F.count_if((F.col("part") == "test") & (F.col("side") == "dropped")).alias("dropped_rows"),
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"),
        F.sum(F.when(F.col("part") == "train", F.col("is_laundering"))).alias("train_positives"), F.sum(F.when(F.col("part") == "test", F.col("is_laundering"))).alias("test_positives"),
    ).first().asDict()
    members = accounts.join(sides.where("side != 'dropped'"), "ring_id").groupBy("account_id").agg(F.count_distinct("side").alias("n"))
    shared = members.where("n > 1").count()
    positive = positive_account_days(rows.where("part = 'test'")).where("y = 1").count()
    check(got["bleed"] == 0, LeakageError, f"{got['bleed']} rows lie on the wrong side of the cut")
    passed = ["no_temporal_bleed"]
    if protocol == "ring-aware":
        check(shared == 0, LeakageError, f"{shared} accounts are in rings of both sides")
        check(got["dropped_rows"] == 0, LeakageError, f"{got['dropped_rows']} test rows belong to dropped rings")
        check(got["tails"] == 0, LeakageError, f"{got['tails']} test rows are tails of train rings")
        passed = ["accounts_disjoint", "rings_disjoint", "no_temporal_bleed", "no_train_ring_tails_in_test"]
    check(positive >= min_positive, LeakageError, f"only {positive} positive account-days in test, {min_positive} wanted: move the cut")
    counts = {k: v or 0 for k, v in got.items() if k not in ("bleed", "dropped_rows")} | {"test_positive_account_days": positive}
    return SplitReport(counts, protocol, tuple(passed))


def cut_dates(spark: SparkSession, rings: DataFrame, fraction: float) -> str:
    """The cut that ``sweep`` has for a fraction."""
    ends = rings.agg(F.min("start_time"), F.max("start_time")).first()
    day: date = (ends[0] + timedelta(days=(ends[1] - ends[0]).days * fraction)).date()
    return str(day)
