"""Replay bundles: the few rows from which published metrics can be computed again."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import BUNDLE_CAP, MetricError, check
from ..functions.columns import ratio
from ..sources import files
from ..storage import materialize
from . import alerts

TABLES = ("account_days_topk", "per_day_positives", "ring_membership", "ring_endpoints", "ring_transactions")
TOLERANCE = 1e-9


def account_days_topk(days: DataFrame, members: DataFrame, cap: int = BUNDLE_CAP, ties: bool = False) -> DataFrame:
    """Each day's ranks up to the cap and every ring account-day: (day, acct, score, other_max, y, rank).

    Ranks up to the cap come from a day's parts, each cut to the cap first. A ring account-day beyond
    it is ranked by the account-days that score higher, counted by ranges of scores, and its place
    among those of its own score; no task sorts a day. With ``ties`` every member of a tie that the cap
    cuts stays too.
    """
    extra = [c for c in ("argmax_txn_id",) if c in days.columns]
    out = ["day", "acct", "score", "other_max", "y", F.col("rank_first").cast("int").alias("rank"), *extra]
    top = alerts.ranked(days, cap)
    top = (top if ties else top.where(F.col("rank_first") <= cap)).select(*out)
    ringed = members.select(F.col("day").alias("m_day"), F.col("acct").alias("m_acct")).distinct().withColumn("ringed", F.lit(True))
    known = top.select(F.col("day").alias("t_day"), F.col("acct").alias("t_acct"))
    far = days.join(ringed, (F.col("day") == F.col("m_day")) & (F.col("acct") == F.col("m_acct")), "left_semi")
    far = materialize(far.join(known, (F.col("day") == F.col("t_day")) & (F.col("acct") == F.col("t_acct")), "left_anti"), "beyond")
    hist = days.groupBy("day", "score").agg(F.count("*").alias("n")).withColumn("p", F.lit(0).cast("long"))
    asked = far.select(F.col("day").alias("a_day"), F.col("score").alias("a_score")).distinct()
    above = alerts.running(hist, ["day"], alerts.score_ranges(days)).join(asked, (F.col("day") == F.col("a_day")) & (F.col("score") == F.col("a_score")), "left_semi")
    above = materialize(above.select(F.col("day").alias("u_day"), F.col("score").alias("u_score"), "n_above"), "above")
    level = days.join(above, (F.col("day") == F.col("u_day")) & (F.col("score") == F.col("u_score")))
    level = level.withColumn("rank_first", F.col("n_above") + F.row_number().over(Window.partitionBy("day", "score").orderBy("acct")))
    mine = far.select(F.col("day").alias("f_day"), F.col("acct").alias("f_acct"))
    return top.unionByName(level.join(mine, (F.col("day") == F.col("f_day")) & (F.col("acct") == F.col("f_acct")), "left_semi").select(*out))


def per_day_positives(days: DataFrame) -> DataFrame:
    """(day, positive_account_days) of days with any."""
    return days.where("y = 1").groupBy("day").agg(F.count("*").alias("positive_account_days"))


def build(scored: DataFrame, cap: int = BUNDLE_CAP, transaction_unit: bool = False) -> dict[str, DataFrame]:
    """The bundle's tables; transaction ids are dense numbers that name nothing outside it."""
    days = alerts.account_days(scored, transaction_unit)
    members, ends = alerts.membership(scored), alerts.endpoints(scored)
    rt = scored.where("ring_id is not null").select(F.col("txn_id").alias("rt"), F.col("event_date").alias("day"), "score").distinct()
    return {
        "account_days_topk": account_days_topk(days, members, cap), "per_day_positives": per_day_positives(days), "ring_membership": members,
        "ring_endpoints": ends.select("day", "acct", "ring_id", "rt"), "ring_transactions": rt,
    }


def write(tables: dict[str, DataFrame], dest: str, cap: int = BUNDLE_CAP, data_origin: str = "synthetic") -> None:
    """Write the tables and ``_bundle.json``, which readers of the folder's tables pass over."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{dest}/{name}")
    spark = next(iter(tables.values())).sparkSession
    files.write_text(spark, f"{dest}/_bundle.json", json.dumps({"max_budget": cap, "data_origin": data_origin, "tables": list(tables)}))


def read(spark: SparkSession, dest: str) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{dest}/{n}") for n in TABLES}, json.loads(files.read_text(spark, f"{dest}/_bundle.json"))


def recompute(tables: dict[str, DataFrame], cap: int, budgets: Sequence[int]) -> DataFrame:
    """Budget metrics and ring recall from the bundle alone, one row a budget; budgets beyond the cap are refused."""
    over = [b for b in budgets if b > cap]
    check(not over, MetricError, f"budgets {over} exceed the bundle's cap of {cap}")
    top, per = tables["account_days_topk"], tables["per_day_positives"]
    hit = F.col("rank") <= F.col("k")
    found = top.select("y", "rank", alerts._budgets(budgets)).groupBy("k").agg(F.count_if(hit).alias("n_alerts"), F.count_if(hit & (F.col("y") == 1)).alias("caught"))
    best = per.select("positive_account_days", alerts._budgets(budgets)).groupBy("k")
    best = best.agg(F.sum("positive_account_days").alias("total"), F.sum(F.least("positive_account_days", F.col("k").cast("long"))).alias("ceiling"))
    ranks = tables["ring_membership"].join(top.select("day", "acct", "rank"), ["day", "acct"], "left")
    missing = ranks.where("rank is null").count()
    check(missing == 0, MetricError, f"{missing} ring account-days are missing from the bundle")
    rings = ranks.select("ring_id", "rank", alerts._budgets(budgets)).groupBy("k", "ring_id").agg(F.max(hit.cast("int")).alias("hit"))
    rings = rings.groupBy("k").agg(F.avg("hit").alias("ring_recall"), F.count("*").alias("n_rings"))
    out = best.join(found, "k").join(rings, "k", "left")
    c, t, m = F.col("caught"), F.col("total"), F.col("ceiling")
    return out.select(
        "k", ratio(c, t).alias("recall"), ratio(m, t).alias("recall_ceiling"), ratio(c, m).alias("recall_efficiency"), ratio(c, F.col("n_alerts")).alias("precision"), "ring_recall", "n_rings",
    )


def compare(recomputed: dict[str, float], published: dict[str, float], tolerance: float = TOLERANCE) -> dict[str, object]:
    """Which published metrics the bundle gives again; comparing nothing is not passing."""
    common = sorted(set(recomputed) & set(published))
    bad = [k for k in common if abs(float(recomputed[k]) - float(published[k])) > tolerance]
    return {"compared": len(common), "mismatches": bad, "exit": 2 if not common else 1 if bad else 0}


def keyed(rows: DataFrame) -> dict[str, float]:
    """One row a budget as ``metric@k``."""
    out = [{f"{c}@{r['k']}": r[c] for c in rows.columns if c != "k" and r[c] is not None} for r in rows.collect()]  # a row a budget
    return reduce(lambda a, b: a | b, out, {})
