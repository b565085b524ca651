"""Account-days, their daily ranks, and metrics under a daily review budget.

The alert unit of budget metrics is the account-day; average precision and ROC area are over
transactions and carry the suffix ``__txn``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import BUDGETS, MetricError, check, require
from ..functions.columns import ratio

NEEDED = ("event_date", "sender_id", "receiver_id", "is_laundering", "ring_id", "score")
#: Parts that a day is pre-ranked in, so that no task holds a day.
SALTS = 32


def validate(scored: DataFrame) -> DataFrame:
    """The frame itself if metrics are defined on it: columns there, rows, finite scores, both classes."""
    require(scored, NEEDED, "scored transfers")
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    got = scored.agg(F.count("*").alias("n"), F.count_if(ok).alias("finite"), F.min("is_laundering").alias("lo"), F.max("is_laundering").alias("hi")).first()
    check(got["n"] > 0, MetricError, "no transfers to evaluate")
    check(got["finite"] == got["n"], MetricError, f"{got['n'] - got['finite']} scores are missing or not finite")
    check(got["lo"] != got["hi"], MetricError, "only one class among the labels")
    return scored


def ends(scored: DataFrame, *columns: str) -> DataFrame:
    """Both endpoints of each transfer as (day, acct, ...)."""
    return scored.select(F.col("event_date").alias("day"), F.explode(F.array("sender_id", "receiver_id")).alias("acct"), *columns)


def account_days(scored: DataFrame, with_txn_id: bool = False, with_touched: bool = False) -> DataFrame:
    """(day, acct, score, y, other_max): the best score and label of the day, and the best score outside rings.

    With ``with_txn_id`` also the transfer that gave the score, the least id among equals; with
    ``with_touched`` whether a ring transfer that has an id is among those of a known day and account.
    """
    rows = ends(scored, "score", "is_laundering", "ring_id", *(["txn_id"] if with_txn_id or with_touched else []))
    best = [F.max_by("txn_id", F.struct("score", -F.col("txn_id"))).alias("argmax_txn_id")] if with_txn_id else []
    known = F.col("day").isNotNull() & F.col("acct").isNotNull()
    best += [(F.bool_or(F.col("ring_id").isNotNull() & F.col("txn_id").isNotNull()) & known).alias("touched")] if with_touched else []
    other = F.max(F.when(F.col("ring_id").isNull(), F.col("score"))).alias("other_max")
    return rows.groupBy("day", "acct").agg(F.max("score").alias("score"), F.max("is_laundering").alias("y"), other, *best)


def membership(scored: DataFrame) -> DataFrame:
    """The many-to-many relation (day, acct, ring_id); an account-day may be in several rings."""
    return ends(scored.where("ring_id is not null"), "ring_id").distinct()


def endpoints(scored: DataFrame) -> DataFrame:
    """(day, acct, ring_id, rt, txn_score) of every ring transfer's endpoints."""
    return ends(scored.where("ring_id is not null"), "ring_id", F.col("txn_id").alias("rt"), F.col("score").alias("txn_score")).distinct()


def ranked(days: DataFrame, cap: int | None = None) -> DataFrame:
    """Add each account-day's rank within its day under three tie policies.

    rank_first breaks ties by account, rank_min resolves them for the row, rank_max against it. With
    a ``cap`` only rows whose rank_min is at most that are kept, all exactly ranked: parts of a day
    are cut to the cap first, so no task sorts a whole day.
    """
    if cap is not None:
        part = Window.partitionBy("day", F.pmod(F.xxhash64("acct"), F.lit(SALTS))).orderBy(F.col("score").desc())
        days = days.withColumn("in_part", F.rank().over(part)).where(F.col("in_part") <= cap).drop("in_part")
    by = Window.partitionBy("day").orderBy(F.col("score").desc())
    rows = days.select(
        "*", F.row_number().over(by.orderBy(F.col("score").desc(), "acct")).alias("rank_first"), F.rank().over(by).alias("rank_min"),
        F.count("*").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("rank_max"),
    )
    return rows if cap is None else rows.where(F.col("rank_min") <= cap)


def per_day(days: DataFrame) -> DataFrame:
    """(day, n, positives)."""
    return days.groupBy("day").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


def _budgets(budgets: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(b)) for b in budgets])).alias("k")


def budget_metrics(days: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """One row a budget: caught, alerts, recall, its ceiling, efficiency, precision, and the bracket of ties.

    All budgets come from one ranking of the rows that the largest could reach. Undefined values are
    null.
    """
    top = ranked(days, max(budgets)).select("y", "rank_first", "rank_min", "rank_max", _budgets(budgets))
    first, low, high, pos = (F.col("rank_first") <= F.col("k")), (F.col("rank_min") <= F.col("k")), (F.col("rank_max") <= F.col("k")), F.col("y") == 1
    found = top.groupBy("k").agg(
        F.count_if(first).alias("n_alerts"), F.count_if(first & pos).alias("caught"), F.count_if(low & ~high).alias("tied_at_boundary"),
        F.count_if(low & pos).alias("opt"), F.count_if(high & pos).alias("pess"),
    )
    best = per_day(days).select("positives", _budgets(budgets)).groupBy("k")
    best = best.agg(F.sum("positives").alias("total_pos"), F.sum(F.least("positives", F.col("k").cast("long"))).alias("ceiling_count"))
    rows = best.join(found, "k", "left")
    total = F.col("total_pos")
    return rows.select(
        "k", "n_alerts", "caught", "total_pos", "ceiling_count", ratio(F.col("caught"), total).alias("recall"), ratio(F.col("ceiling_count"), total).alias("recall_ceiling"),
        ratio(F.col("caught"), F.col("ceiling_count")).alias("recall_efficiency"), ratio(F.col("caught"), F.col("n_alerts")).alias("precision"),
        ratio(F.col("n_alerts"), F.col("caught")).alias("alerts_per_true_positive"), "tied_at_boundary",
        ratio(F.col("opt"), total).alias("recall_tie_optimistic"), ratio(F.col("pess"), total).alias("recall_tie_pessimistic"),
    )


def member_ranks(days: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """Every membership row with its account-day's rank_first, null beyond the cap."""
    ranks = ranked(days, cap).select(F.col("day").alias("r_day"), F.col("acct").alias("r_acct"), "rank_first")
    return members.join(ranks, (F.col("day") == F.col("r_day")) & (F.col("acct") == F.col("r_acct")), "left").drop("r_day", "r_acct")


def refuse_orphans(days: DataFrame, ends_of_rings: DataFrame) -> None:
    """Every ring endpoint (day, acct) must be an account-day, or ``MetricError``: membership and scores disagree."""
    have = days.select(F.col("day").alias("h_day"), F.col("acct").alias("h_acct"))
    lost = ends_of_rings.select("day", "acct").join(have, (F.col("day") == F.col("h_day")) & (F.col("acct") == F.col("h_acct")), "left_anti").count()
    check(lost == 0, MetricError, f"{lost} ring endpoints have no account-day")


def ring_recall(days: DataFrame, members: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """One row a budget: share of rings with an alerted account-day, ring sizes, the members' own recall, and closed-form nulls.

    The closed forms take a ring's account-days as caught independently, at the members' own recall
    or, pooled, at that of all positive account-days; they are for comparison only.
    """
    found = member_ranks(days, members, max(budgets))
    rows = found.select("ring_id", "day", "acct", "rank_first", _budgets(budgets)).withColumn("hit", F.coalesce((F.col("rank_first") <= F.col("k")).cast("int"), F.lit(0)))
    rings = rows.groupBy("k", "ring_id").agg(F.max("hit").alias("hit"), F.count("*").alias("size"))
    units = rows.select("k", "day", "acct", "hit").distinct().groupBy(F.col("k").alias("u_k")).agg(F.count("*").alias("n_ring_account_days"), F.avg("hit").alias("ring_eligible_recall"))
    pooled = budget_metrics(days, budgets).select(F.col("k").alias("p_k"), F.col("recall").alias("pooled"))
    rings = rings.join(units, F.col("k") == F.col("u_k")).join(pooled, F.col("k") == F.col("p_k"))
    rows = rings.groupBy("k", "n_ring_account_days", "ring_eligible_recall").agg(
        F.count("*").alias("n_rings"), F.avg("hit").alias("ring_recall"), F.percentile("size", 0.5).alias("ring_size_median"), F.percentile("size", 0.9).alias("ring_size_p90"),
        F.avg(1 - F.pow(1 - F.col("ring_eligible_recall"), F.col("size"))).alias("ring_recall_null_analytic"), F.avg(1 - F.pow(1 - F.col("pooled"), F.col("size"))).alias("ring_recall_null_analytic_pooled"),
    )
    return rows.withColumn("ring_recall_lift_analytic_pooled", F.round(ratio(F.col("ring_recall"), F.col("ring_recall_null_analytic_pooled")), 3))


def ring_recall_by_typology(scored: DataFrame, days: DataFrame, budget: int = 50) -> DataFrame:
    """(typology, n_rings, ring_recall) at one budget; a ring's typology is its least one."""
    rings = scored.where("ring_id is not null").groupBy(F.col("ring_id").alias("t_ring")).agg(F.min("typology").alias("typology"))
    hits = member_ranks(days, membership(scored), budget).groupBy("ring_id")
    hits = hits.agg(F.max(F.coalesce((F.col("rank_first") <= budget).cast("int"), F.lit(0))).alias("hit"))
    rows = hits.join(rings, F.col("ring_id") == F.col("t_ring")).where("typology is not null")
    return rows.groupBy("typology").agg(F.count("*").alias("n_rings"), F.avg("hit").alias("ring_recall"))


def running_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest: its rows n and positives p, and those above it.

    Scores are cut into ranges by approximate quantiles; running sums add the totals of the ranges
    above, so no task sorts all scores.
    """
    hist = scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("is_laundering").cast("long").alias("p"))
    return running(hist, by, score_ranges(scored))


def score_ranges(scored: DataFrame, parts: int = 64) -> list[float]:
    """Cuts of the scores into ranges of about as many rows each."""
    return sorted(set(scored.approxQuantile("score", [i / parts for i in range(1, parts)], 0.005)))


def running(hist: DataFrame, by: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """``running_counts`` of a histogram (by, score, n, p)."""
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    hist = hist.withColumn("part", part)
    sums = hist.groupBy(*by, "part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    above = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in by], F.col("part").alias("s_part"), F.sum("n").over(above).alias("n_up"), F.sum("p").over(above).alias("p_up"))
    within = Window.partitionBy(*by, "part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("n_in", F.sum("n").over(within)).withColumn("p_in", F.sum("p").over(within))
    on = [F.col(c) == F.col(f"s_{c}") for c in by] + [F.col("part") == F.col("s_part")]
    rows = hist.join(sums, on)
    zero = F.lit(0).cast("long")
    return rows.select(
        *by, "score", "n", "p", (F.coalesce("n_in", zero) + F.coalesce("n_up", zero)).alias("n_above"), (F.coalesce("p_in", zero) + F.coalesce("p_up", zero)).alias("p_above"),
    )


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group): step-wise average precision and ROC area over transactions, equal scores as one step."""
    c = running_counts(scored, by)
    total = c.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = c.join(total, list(by)) if by else c.crossJoin(total)  # a single row
    step = ratio(F.col("p"), F.col("all_p")) * ratio(F.col("p_above") + F.col("p"), F.col("n_above") + F.col("n"))
    neg = F.col("n") - F.col("p")
    won = neg.cast("double") * (F.col("p_above") + F.col("p") / F.lit(2.0))
    area = ratio(won, F.col("all_p") * (F.col("all_n") - F.col("all_p")))
    return c.groupBy(*by).agg(F.sum(step).alias("average_precision__txn"), F.sum(area).alias("roc_auc_footnote_only__txn"))


def coverage(scored: DataFrame, days: DataFrame) -> DataFrame:
    """One row: share of positive account-days without a ring, and of positive transfers with one; their units differ."""
    members = membership(scored).select(F.col("day").alias("m_day"), F.col("acct").alias("m_acct")).distinct()
    rows = days.where("y = 1").join(members, (F.col("day") == F.col("m_day")) & (F.col("acct") == F.col("m_acct")), "left")
    acct = rows.agg(F.round(100 * F.avg(F.col("m_day").isNull().cast("int")), 2).alias("pct_positive_acct_days_without_ring"))
    txn = scored.where("is_laundering = 1").agg(F.round(100 * F.avg(F.col("ring_id").isNotNull().cast("int")), 2).alias("typology_coverage_pct__txn"))
    return acct.crossJoin(txn)  # two single rows


def evaluation(scored: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Every metric as rows (metric, k, value, alert_unit); k is null where no budget applies."""
    days = account_days(scored)
    size = days.agg(F.count("*").cast("double").alias("n_account_days"), F.sum("y").cast("double").alias("n_positive_account_days"))

    def long(df: DataFrame, unit: str, k: Column) -> DataFrame:
        names = [c for c in df.columns if c != "k"]
        rows = df.select(k.cast("int").alias("k"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m"))
        return rows.select("m.metric", "k", "m.value", F.lit(unit).alias("alert_unit"))

    none = F.lit(None)
    out = long(size, "account-day", none).unionByName(long(average_precision(scored), "transaction", none))
    out = out.unionByName(long(coverage(scored, days), "mixed", none)).unionByName(long(budget_metrics(days, budgets), "account-day", F.col("k")))
    return out.unionByName(long(ring_recall(days, membership(scored), budgets), "ring", F.col("k")))


def evaluate(scored: DataFrame, budgets: Sequence[int] = BUDGETS, per_typology: bool = True) -> dict[str, object]:
    """``evaluation`` as a dictionary ``metric@k`` after validation, with ring recall by typology."""
    rows = evaluation(validate(scored), budgets).collect()  # a few rows a budget
    out: dict[str, object] = {r["metric"] if r["k"] is None else f"{r['metric']}@{r['k']}": r["value"] for r in rows}
    if per_typology:
        b = 50 if 50 in budgets else budgets[0]
        found = ring_recall_by_typology(scored, account_days(scored), b).collect()  # one row a typology
        out["per_typology"] = {r["typology"]: {"n_rings": r["n_rings"], f"ring_recall@{b}": r["ring_recall"]} for r in found}
    return out


def scored_by(txns: DataFrame, scores: DataFrame) -> DataFrame:
    """Transfers joined to (txn_id, score) one to one, or ``MetricError``: ids unique on both sides, no transfer without a score."""
    for name, df in (("transfers", txns), ("scores", scores)):
        got = df.agg(F.count("*").alias("n"), F.count_distinct("txn_id").alias("d")).first()
        check(got["n"] == got["d"], MetricError, f"{name} repeat a txn_id")
    out = txns.drop("score").join(scores.select(F.col("txn_id").alias("s_id"), "score", F.lit(True).alias("matched")), F.col("txn_id") == F.col("s_id"), "left")
    missing = out.where("matched is null").count()
    check(missing == 0, MetricError, f"{missing} transfers have no score")
    return out.drop("s_id", "matched")
