import random

import pytest

from tollgate.contract import MetricError
from tollgate.operators import alerts


def _metrics(txns, rows, k=(1,)):
    return {r["k"]: r for r in alerts.budget_metrics(alerts.account_days(txns(rows)), k).collect()}


def _one(i, day, score, y, ring=None):
    return {"id": i, "t": day, "s": f"01_S{i}", "r": f"01_R{i}", "score": score, "y": y, "ring": ring}


def test_perfect_and_worst_ranking(txns):
    rows = [_one(i, 0, 10 - i, int(i == 0)) for i in range(5)]
    assert _metrics(txns, rows, (2,))[2]["recall"] == 1.0 == _metrics(txns, rows, (2,))[2]["precision"]
    worst = [_one(i, 0, i, int(i == 0)) for i in range(5)]
    assert _metrics(txns, worst, (2,))[2]["recall"] == 0.0 and _metrics(txns, worst, (2,))[2]["alerts_per_true_positive"] is None


def test_no_positives_is_null_not_zero(txns):
    got = _metrics(txns, [_one(i, 0, i, 0) for i in range(3)])[1]
    assert got["recall"] is None and got["recall_ceiling"] is None and got["precision"] == 0.0


def test_budget_renews_every_day(txns):
    rows = [_one(2 * d + y, d, y, y) for d in range(4) for y in (0, 1)]
    got = _metrics(txns, rows, (2,))[2]
    assert got["n_alerts"] == 8 and got["recall"] == 1.0


def test_a_transfer_makes_two_account_days_and_a_ceiling(txns):
    days = alerts.account_days(txns([_one(i, 0, i, 1) for i in range(4)]))
    assert days.count() == 8
    got = alerts.budget_metrics(days, (1,)).first()
    assert got["recall_ceiling"] == 0.125 and got["recall_efficiency"] == 1.0


def test_affine_identity(txns):
    rng = random.Random(5)
    for r in _metrics(txns, [_one(i, i % 3, rng.random(), int(rng.random() < 0.3)) for i in range(60)], (1, 5, 20)).values():
        assert r["recall"] == pytest.approx(r["precision"] * r["n_alerts"] / r["total_pos"]) and r["recall_efficiency"] == pytest.approx(r["recall"] / r["recall_ceiling"])


def test_tie_bracket(txns):
    rows = [{"id": i, "t": 0, "s": f"01_S{i}", "r": f"01_S{i}", "score": 1.0, "y": int(i < 3)} for i in range(6)]
    got = _metrics(txns, rows, (2,))[2]
    assert got["tied_at_boundary"] == 6 and got["recall_tie_optimistic"] == 1.0 and got["recall_tie_pessimistic"] == 0.0
    assert got["recall_tie_pessimistic"] <= got["recall"] <= got["recall_tie_optimistic"]


def test_capped_ranks_equal_full_ranks(txns):
    rng = random.Random(2)
    days = alerts.account_days(txns([_one(i, i % 2, rng.randrange(15), 0) for i in range(300)])).persist()
    full = alerts.ranked(days).where("rank_min <= 12")
    capped = alerts.ranked(days, 12)
    assert full.exceptAll(capped).isEmpty() and capped.exceptAll(full).isEmpty()


def test_membership_is_many_to_many(txns):
    rows = [{"id": 1, "t": 0, "s": "01_A", "r": "01_B", "score": 9, "y": 1, "ring": 1}, {"id": 2, "t": 0, "s": "01_A", "r": "01_C", "score": 1, "y": 1, "ring": 2}, {"id": 3, "t": 0, "s": "01_D", "r": "01_E", "score": 5, "y": 0}]
    df = txns(rows)
    assert alerts.membership(df).where("acct = '01_A'").count() == 2
    got = alerts.ring_recall(alerts.account_days(df), alerts.membership(df), (2,)).first()
    assert got["n_rings"] == 2 and got["ring_recall"] == 1.0 and got["n_ring_account_days"] == 3 and got["ring_eligible_recall"] == pytest.approx(2 / 3)
    days = {r["acct"]: r for r in alerts.account_days(df, True).collect()}
    assert days["01_A"]["argmax_txn_id"] == 1 and days["01_A"]["other_max"] is None and days["01_D"]["other_max"] == 5


def test_average_precision_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40) / 4.0, int(rng.random() < 0.2)) for _ in range(400)]
    got = alerts.average_precision(spark.createDataFrame(rows, "score double, is_laundering int")).first()
    levels, total, ap, tp, n, auc = sorted({s for s, _ in rows}, reverse=True), sum(y for _, y in rows), 0.0, 0, 0, 0.0
    for s in levels:
        p, m = sum(y for v, y in rows if v == s), sum(v == s for v, _ in rows)
        auc += (m - p) * (tp + p / 2)
        tp, n = tp + p, n + m
        ap += p / total * tp / n
    assert got["average_precision__txn"] == pytest.approx(ap, abs=1e-12) and got["roc_auc_footnote_only__txn"] == pytest.approx(auc / (total * (len(rows) - total)), abs=1e-12)


def test_evaluate_and_refusals(spark, txns):
    rows = [_one(i, i % 2, i, int(i % 4 == 0), 7 if i % 4 == 0 else None) for i in range(12)]
    got = alerts.evaluate(txns(rows), (1, 2))
    assert got["n_account_days"] == 24 and got["per_typology"] == {"CYCLE": {"n_rings": 1, "ring_recall@1": 1.0 if got["ring_recall@1"] else 0.0}}
    assert {r["alert_unit"] for r in alerts.evaluation(txns(rows), (1,)).collect()} == {"account-day", "transaction", "mixed", "ring"}
    for bad in ([], rows[1:4], [{**r, "score": float("nan")} for r in rows]):
        with pytest.raises(MetricError):
            alerts.evaluate(txns(bad), (1,))


def test_scores_join_one_to_one(spark, txns):
    df = txns([_one(i, 0, 0, 0) for i in range(3)])
    good = spark.createDataFrame([(i, 0.5) for i in range(3)], "txn_id long, score double")
    assert alerts.scored_by(df, good).count() == 3
    for bad in (good.union(good), good.where("txn_id < 2")):
        with pytest.raises(MetricError):
            alerts.scored_by(df, bad)
