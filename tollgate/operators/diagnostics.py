"""Where alerts and volume come from: units, window segments, payment formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import COLLAPSE, MetricError, check
from ..functions.columns import ratio
from . import alerts


def ingest_stats(txns: DataFrame) -> DataFrame:
    """One row: size, labels, time range, senders, and whether ids run from 1 without a gap."""
    got = txns.agg(
        F.count("*").alias("rows"), F.sum("is_laundering").cast("long").alias("positives"), F.min("event_time").alias("min_event_time"), F.max("event_time").alias("max_event_time"),
        F.count_distinct("event_date").alias("days"), F.count_distinct("sender_id").alias("distinct_senders"), F.count_distinct("txn_id").alias("ids"), F.min("txn_id").alias("lo"), F.max("txn_id").alias("hi"),
    )
    whole = (F.col("ids") == F.col("rows")) & (F.col("lo") == 1) & (F.col("hi") == F.col("rows"))
    return got.select(
        "rows", "positives", F.round(100 * ratio(F.col("positives"), F.col("rows")), 4).alias("prevalence_pct"), "min_event_time", "max_event_time", "days", "distinct_senders",
        whole.alias("txn_id_contiguous"),
    )


def volume(txns: DataFrame) -> DataFrame:
    """(day, transactions, laundering, prevalence, thin): thin days have under a hundredth of the median volume."""
    days = txns.groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("transactions"), F.sum("is_laundering").cast("long").alias("laundering"))
    median = days.agg(F.percentile("transactions", 0.5).alias("median"))
    rows = days.crossJoin(F.broadcast(median))  # a single row
    return rows.select("day", "transactions", "laundering", F.round(ratio(F.col("laundering"), F.col("transactions")), 6).alias("prevalence"), (F.col("transactions") < COLLAPSE * F.col("median")).alias("thin"))


def first_thin_day(txns: DataFrame) -> str | None:
    """The first thin day, where the volume has collapsed."""
    day = volume(txns).where("thin").agg(F.min("day")).first()[0]
    return None if day is None else str(day)


def window_decomposition(topk: DataFrame, positives: DataFrame, boundary: str, budgets: Sequence[int] = (50, 200)) -> DataFrame:
    """Alerts, true positives and ceiling before and from ``boundary``, one row a budget.

    The days are all that have an alert or a positive.
    """
    head = F.col("day") < F.lit(boundary).cast("date")
    hit = F.col("rank") <= F.col("k")
    on = lambda c: F.count_if(c)
    top = topk.select("y", "rank", head.alias("head"), alerts._budgets(budgets)).groupBy("k").agg(
        on(hit & F.col("head")).alias("alerts_head"), on(hit & ~F.col("head")).alias("alerts_tail"),
        on(hit & F.col("head") & (F.col("y") == 1)).alias("true_positives_head"), on(hit & ~F.col("head") & (F.col("y") == 1)).alias("true_positives_tail"), on(hit).alias("alerts"),
    )
    p, k = F.col("positive_account_days"), F.col("k").cast("long")
    ceiling = positives.select("positive_account_days", head.alias("head"), alerts._budgets(budgets)).groupBy("k").agg(
        F.sum(F.when(F.col("head"), F.least(p, k)).otherwise(0)).alias("ceiling_count_head"), F.sum(F.when(~F.col("head"), F.least(p, k)).otherwise(0)).alias("ceiling_count_tail"),
    )
    rows = top.join(ceiling, "k")
    c = F.col
    share = lambda a, b, name: F.round(ratio(a, b), 5).alias(name)
    return rows.select(
        "k", "alerts_head", "alerts_tail", "true_positives_head", "true_positives_tail", "ceiling_count_head", "ceiling_count_tail",
        share(c("true_positives_tail"), c("true_positives_head") + c("true_positives_tail"), "true_positive_share_tail"),
        share(c("ceiling_count_tail"), c("ceiling_count_head") + c("ceiling_count_tail"), "ceiling_share_tail"),
        share(c("true_positives_head"), c("alerts_head"), "precision_head"), share(c("true_positives_tail"), c("alerts_tail"), "precision_tail"),
        share(c("true_positives_head") + c("true_positives_tail"), c("alerts"), "precision_pooled"),
    )


def ring_ends(members: DataFrame, rings: DataFrame, topk: DataFrame, budget: int) -> DataFrame:
    """(ring_id, typology, end_day, hit) of every evaluated ring: the last day it is seen, and whether the budget alerts it."""
    ranks = topk.select("day", "acct", "rank")
    hit = F.max(F.coalesce((F.col("rank") <= budget).cast("int"), F.lit(0))).alias("hit")
    out = members.join(ranks, ["day", "acct"], "left").groupBy("ring_id").agg(F.max("day").alias("end_day"), hit)
    return out.join(rings.select("ring_id", "typology"), "ring_id", "left")


def segment_rates(ends: DataFrame, boundary: str) -> DataFrame:
    """Per shape: rings, those that end from ``boundary`` on and their share, and detection rates of both parts and all."""
    after = F.col("end_day") >= F.lit(boundary).cast("date")
    rate = lambda on, name: F.round(F.avg(F.when(on, F.col("hit"))), 5).alias(name)
    return ends.groupBy("typology").agg(
        F.count("*").alias("n_rings"), F.count_if(after).alias("n_after"), F.round(ratio(F.count_if(after), F.count("*")), 4).alias("share_after"),
        rate(~after, "head_rate"), rate(after, "tail_rate"), rate(F.lit(True), "rate"),
    )


def assert_population(rates: DataFrame, detected: dict[str, int]) -> None:
    """Exposure and detection must be of the same rings: their numbers by shape agree, or ``MetricError``."""
    got = {r["typology"]: r["n_rings"] for r in rates.collect()}  # a row a shape
    check(got == detected, MetricError, f"rings by typology differ: {got} and {detected}")


def nonbinding_rings(ends: DataFrame, topk: DataFrame, cap: int, budget: int) -> DataFrame:
    """Per shape: rings that end on a day which the budget alerts whole, so that any ranker catches them."""
    days = topk.groupBy(F.col("day").alias("n_day")).agg(F.max("rank").alias("mx")).where(F.col("mx") <= min(cap - 1, budget))
    rows = ends.join(days, F.col("end_day") == F.col("n_day"), "left")
    free = F.count("n_day")
    return rows.groupBy("typology").agg(F.count("*").alias("n_rings"), free.alias("n_on_nonbinding_days"), F.round(ratio(free, F.count("*")), 4).alias("share"))


def assert_partition(rows: DataFrame, alerts_of: dict[int, int]) -> None:
    """Head and tail must add up to the alerts counted on their own."""
    for r in rows.collect():  # a row a budget
        check(r["alerts_head"] + r["alerts_tail"] == alerts_of[r["k"]], MetricError, f"head and tail alerts do not add up at {r['k']}")


def alert_unit_coupling(topk: DataFrame, ends: DataFrame, rt: DataFrame, budgets: Sequence[int] = (10, 50, 200)) -> DataFrame:
    """How alerted account-days map to ring transfers, one row a budget.

    A ring transfer is an alert's source where its score equals the account-day's exactly, which a
    maximum keeps bit for bit. Groups of one day and score are ties.
    """
    top = topk.select("day", "acct", "score", "y", "rank", alerts._budgets(budgets)).where(F.col("rank") <= F.col("k"))
    ties = top.groupBy("k", "day", "score").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    ties = ties.groupBy("k").agg(
        F.sum("n").alias("alerted_account_days"), F.count("*").alias("tie_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("tie_label_discordant_groups"),
        F.round(F.avg("hi"), 5).alias("precision_per_tie_group"), F.round(F.avg("n"), 4).alias("tie_account_days_per_group"),
    )
    pre = top.groupBy("k").agg(F.round(F.avg("y"), 5).alias("precision_per_account_day"))
    scores = rt.select(F.col("rt").alias("s_rt"), F.col("score").alias("txn_score"))
    found = ends.join(scores, F.col("rt") == F.col("s_rt"))
    found = found.select(F.col("day").alias("e_day"), F.col("acct").alias("e_acct"), "rt", "txn_score").distinct()
    found = found.join(top, (F.col("e_day") == F.col("day")) & (F.col("e_acct") == F.col("acct"))).withColumn("source", F.col("txn_score") == F.col("score"))
    all_ = found.groupBy("k").agg(F.count("*").alias("ring_endpoints_in_alerted"), F.count_if("source").alias("ring_endpoints_attributable"))
    src = found.where("source")
    per_txn = src.groupBy("k", "day", "rt").agg(F.count("*").alias("n")).groupBy("k")
    per_txn = per_txn.agg(F.count("*").alias("alerting_ring_txns"), F.count_if(F.col("n") == 2).alias("alerting_ring_txns_with_both_endpoints"))
    tied = src.groupBy("k", "day", "acct").agg(F.count_distinct("rt").alias("n")).groupBy("k")
    tied = tied.agg(F.count_if(F.col("n") > 1).alias("ring_account_days_with_tied_max"), F.count("*").alias("ring_account_days_attributed"))
    spans = src.groupBy("k", "day", "score").agg(F.count_distinct("rt").alias("n")).groupBy("k")
    spans = spans.agg(F.count("*").alias("ring_score_groups"), F.count_if(F.col("n") > 1).alias("ring_score_groups_spanning_multiple_txns"))
    out = ties
    for part in (pre, all_, per_txn, tied, spans):
        out = out.join(part, "k", "left")
    share = F.round(ratio(F.col("alerting_ring_txns_with_both_endpoints"), F.col("alerting_ring_txns")), 4)
    return out.withColumn("both_endpoint_share", share)


def tie_histogram(topk: DataFrame, budget: int) -> DataFrame:
    """(size, groups): how many groups of equal day and score an alert list has, by size."""
    sizes = topk.where(F.col("rank") <= budget).groupBy("day", "score").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


def raw_account_days(txns: DataFrame) -> DataFrame:
    """(day, raw): account-days of each day."""
    return alerts.ends(txns).distinct().groupBy("day").agg(F.count("*").alias("raw"))


def format_facts(txns: DataFrame) -> DataFrame:
    """Per payment format: rows, positives, laundering rate, and shares of all rows and positives, in per cent."""
    by = txns.groupBy(F.col("payment_format").alias("format")).agg(F.count("*").alias("rows"), F.sum("is_laundering").cast("long").alias("positives"))
    total = by.agg(F.sum("rows").alias("all_rows"), F.sum("positives").alias("all_positives"))
    rows = by.crossJoin(F.broadcast(total))  # a single row
    pct = lambda a, b, n, name: F.round(100 * ratio(F.col(a), F.col(b)), n).alias(name)
    return rows.select(
        "format", "rows", "positives", pct("positives", "rows", 4, "laundering_rate_pct"), pct("rows", "all_rows", 2, "share_of_rows_pct"), pct("positives", "all_positives", 2, "share_of_positives_pct"),
    )


def digest(scores: DataFrame) -> DataFrame:
    """One row: rows, an order-free digest of (txn_id, score), and one of scores rounded to six places.

    Portable: sums of the first 60 bits of MD5 of ``id|units``, units being the score in steps of
    2^-40, or of one millionth.
    """
    part = lambda units: F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("txn_id").cast("string"), units.cast("decimal(38,0)").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)"))
    exact, rounded = F.floor(F.col("score") * F.lit(2.0**40)), F.round(F.col("score") * 1_000_000 + 2.5e-2, 0)
    return scores.agg(F.count("*").alias("rows"), part(exact).cast("string").alias("digest"), part(rounded).cast("string").alias("digest_rounded"))


def feasible_tail(rates: DataFrame) -> DataFrame:
    """One row: which detection rates of the later segment could give the pooled rate, with an earlier rate in [0, 1].

    ``rates`` are those of ``segment_rates``.
    """
    n = F.sum("n_rings")
    one = rates.agg(ratio(F.sum("n_after"), n).alias("share"), ratio(F.sum(F.col("n_rings") * F.col("rate")), n).alias("pooled"))
    share, pooled = F.col("share"), F.col("pooled")
    return one.select(
        F.round(share, 5).alias("after_share"), F.round(pooled, 5).alias("pooled_rate"), F.round(F.least(F.lit(1.0), ratio(pooled, share)), 5).alias("max_feasible_tail_rate"),
        F.round(F.greatest(F.lit(0.0), ratio(pooled - (1 - share), share)), 5).alias("min_feasible_tail_rate"),
    )
