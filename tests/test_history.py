from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tollgate.contract import HISTORY, ContractError
from tollgate.operators import history

BASE = datetime(2022, 9, 1, 10, 0)


def _rows(df):
    return {(r["txn_id"], r["side"]): r.asDict() for r in df.collect()}


def test_a_future_outlier_moves_nothing(txns):
    daily = [{"id": i, "t": BASE + timedelta(days=i), "s": "01_A", "r": f"01_B{i}", "amount": 100.0 + i} for i in range(5)]
    later = {"id": 99, "t": BASE + timedelta(days=6), "s": "01_A", "r": "01_Z", "amount": 1e7}
    a, b = _rows(history.history(txns(daily))), _rows(history.history(txns([*daily, later])))
    assert all(a[k] == b[k] for k in a)


def test_siblings_of_a_minute_do_not_see_each_other(txns):
    rows = [{"id": 1, "t": BASE, "s": "01_A", "r": "01_B"}, {"id": 2, "t": BASE, "s": "01_A", "r": "01_C"}, {"id": 3, "t": BASE + timedelta(minutes=1), "s": "01_A", "r": "01_B"}]
    got = _rows(history.history(txns(rows)))
    assert got[1, "s"]["n_1d"] == got[2, "s"]["n_1d"] == 0
    assert got[3, "s"]["n_1d"] == 2 and got[3, "s"]["secs_since_prev"] == 60 == got[3, "s"]["secs_since_prev_cp"]
    assert got[3, "s"]["n_distinct_cp_ever"] == 2


def test_history_is_two_sided_and_keyed_by_bank(txns):
    rows = [{"id": 1, "t": BASE, "s": "01_X", "r": "02_M", "amount": 50.0}, {"id": 2, "t": BASE + timedelta(hours=1), "s": "02_M", "r": "03_Y"}, {"id": 3, "t": BASE + timedelta(hours=2), "s": "09_M", "r": "03_Y"}]
    got = _rows(history.history(txns(rows)))
    assert got[2, "s"]["n_7d"] == 1 and got[2, "s"]["n_out_7d"] == 0 and got[2, "s"]["n_in_7d"] == 1 and got[2, "s"]["out_share_7d"] == 0.0
    assert got[3, "s"]["n_7d"] == 0


def test_cold_start_keeps_null_apart_from_zero(txns):
    got = _rows(history.history(txns([{"id": 1, "t": BASE, "s": "01_A", "r": "01_B"}])))[1, "s"]
    zero = ("n_1d", "n_7d", "n_30d", "n_out_7d", "n_in_7d", "n_new_cp_7d", "n_distinct_cp_ever")
    assert all(got[c] == 0 for c in zero) and all(got[c] is None for c in HISTORY if c not in zero)


def test_frames_end_where_they_say(txns):
    at = [0, 7 * 24 * 60, 7 * 24 * 60 + 1]
    got = _rows(history.history(txns([{"id": i, "t": BASE + timedelta(minutes=m), "s": "01_A", "r": f"02_{i}"} for i, m in enumerate(at)])))
    assert got[1, "s"]["n_7d"] == 1 and got[2, "s"]["n_7d"] == 1 and got[2, "s"]["n_30d"] == 2


def test_self_transfer_counts_on_both_sides(txns):
    rows = [{"id": 1, "t": BASE, "s": "01_A", "r": "01_A"}, {"id": 2, "t": BASE + timedelta(hours=1), "s": "01_A", "r": "01_B"}]
    got = _rows(history.history(txns(rows)))
    assert got[2, "s"]["n_1d"] == 2 and got[1, "r"]["n_1d"] == 0


def _world(seed=3):
    import random

    rng, out, i = random.Random(seed), [], 0
    accounts = [f"0{b}_{a}" for b in range(3) for a in range(4)]
    for day in range(50):
        for _ in range(rng.randint(3, 6)):
            i += 1
            out.append({"id": i, "t": BASE + timedelta(days=day, minutes=rng.randrange(600)), "s": rng.choice(accounts), "r": rng.choice(accounts), "amount": rng.choice([9000.0, 8700.0, 123.45, 1000.0])})
    for _ in range(3):
        i += 1
        out.append({"id": i, "t": BASE + timedelta(days=6, hours=2), "s": accounts[0], "r": accounts[1]})
    return out


def _oracle(rows):
    """Every feature from its definition, event by event."""
    events = [(r["id"], s, r["t"], r["s" if s == "s" else "r"], r["r" if s == "s" else "s"], r.get("amount", 10.0), int(s == "s")) for r in rows for s in "sr"]
    out = {}
    first = lambda e: not any(o[3] == e[3] and o[4] == e[4] and o[2] <= e[2] - timedelta(minutes=1) for o in events)
    new = {id(e): first(e) for e in events}
    for e in events:
        prior = [o for o in events if o[3] == e[3] and o[2] <= e[2] - timedelta(minutes=1)]
        w = {d: [o for o in prior if o[2] >= e[2] - timedelta(days=d)] for d in (1, 7, 30)}
        amounts = [o[5] for o in w[7]]
        mean = sum(amounts) / len(amounts) if amounts else None
        same = [o[2] for o in prior if o[4] == e[4]]
        n7, out7, new7 = len(w[7]), sum(o[6] for o in w[7]), sum(new[id(o)] for o in w[7])
        out[e[0], e[1]] = {
            "n_1d": len(w[1]), "n_7d": n7, "n_30d": len(w[30]), "mean_amt_7d": mean, "std_amt_7d": (sum((a - mean) ** 2 for a in amounts) / n7) ** 0.5 if n7 else None,
            "max_amt_30d": max((o[5] for o in w[30]), default=None), "n_out_7d": out7, "secs_since_prev": (e[2] - max(o[2] for o in w[30])).total_seconds() if w[30] else None,
            "secs_since_prev_cp": (e[2] - max(same)).total_seconds() if same else None, "n_in_7d": n7 - out7, "out_share_7d": out7 / n7 if n7 else None, "n_new_cp_7d": new7,
            "new_cp_rate_7d": new7 / n7 if n7 else None, "n_distinct_cp_ever": sum(new[id(o)] for o in prior),
        }
    return out


@pytest.mark.parametrize("hub_events", [10**6, 40, 1])
def test_batch_equals_the_definition(txns, hub_events):
    rows = _world()
    got, want = _rows(history.history(txns(rows), 30, hub_events)), _oracle(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in HISTORY:
            assert got[k][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-9, abs=1e-6)), (k, c)


def test_feature_table(spark, txns):
    rows = [{"id": 1, "t": datetime(2022, 9, 4, 9, 5), "s": "01_A", "r": "02_B", "amount": 3000.0, "received": 1500.0, "currency": "Euro"}, {"id": 2, "t": datetime(2022, 9, 5, 9, 5), "s": "01_A", "r": "01_A", "amount": 0.0}]
    a, b = history.feature_table(txns(rows)).orderBy("txn_id").collect()
    assert (a["amount_roundness"], a["dayofweek"], a["is_weekend"], a["is_cross_bank"], a["currency_mismatch"], a["fx_ratio"]) == (3, 0, 1, 1, 1, 0.5)
    assert b["fx_ratio"] is None and b["is_self_transfer"] == 1 and b["dayofweek"] == 1 and b["s_amt_vs_hist"] == 0.0
    assert history.feature_summary(history.feature_table(txns(rows))).first()["rows"] == 2
    with pytest.raises(ContractError):
        history.history(txns(rows).drop("txn_id"))


def test_all_frames_share_one_shuffle(spark, txns):
    df = history.history(txns(_world()))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2, text
    assert F is not None


def test_no_frame_is_read_anew_for_each_event(txns):
    text = history.history(txns(_world()))._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -" not in text, text  # a frame with a moving start costs its whole length an event


def test_times_equal_brute_force():
    import numpy as np

    from tollgate.operators.frames import Times

    rng = np.random.default_rng(4)
    t = rng.integers(0, 20_000, 700) * 60
    amount, known, out, new = rng.choice([0.1, 3.7, 1e6], 700), rng.random(700) < 0.8, rng.integers(0, 2, 700), rng.integers(0, 2, 700)
    at = np.unique(t)
    half = Times.of(*(x[:300] for x in (t, amount, known, out, new))).plus(Times.of(*(x[300:] for x in (t, amount, known, out, new))))
    for times in (Times.of(t, amount, known, out, new), half):
        got, null = times.features(at, 5)
        for i, q in enumerate(at):
            upto = t <= q - 60
            w = {d: upto & (t >= q - d * 86_400) for d in (1, 7, 30)}
            assert [got[c][i] for c in ("n_1d", "n_7d", "n_30d", "n_out_7d", "n_new_cp_7d", "n_distinct_cp_ever")] == [*(x.sum() for x in w.values()), out[w[7]].sum(), new[w[7]].sum(), new[upto].sum() + 5]
            week, month = amount[w[7] & known], amount[w[30] & known]
            assert null["mean_amt_7d"][i] == (not len(week)) and null["max_amt_30d"][i] == (not len(month))
            if len(week):
                assert (got["mean_amt_7d"][i], got["std_amt_7d"][i]) == (pytest.approx(week.mean()), pytest.approx(week.std(), abs=1e-6)) and got["max_amt_30d"][i] == month.max()


@pytest.mark.parametrize("hub_events", [10**6, 1])
def test_null_amounts_count_but_weigh_nothing(txns, hub_events):
    df = txns([{"id": i, "t": BASE + timedelta(days=20 * i), "s": "01_A", "r": f"01_{i}", "amount": 7.0} for i in range(4)])
    got = _rows(history.history(df.withColumn("amount_paid", F.when(F.col("txn_id") != 1, F.col("amount_paid"))), 30, hub_events))
    assert [(got[i, "s"]["n_30d"], got[i, "s"]["max_amt_30d"], got[i, "s"]["n_distinct_cp_ever"]) for i in range(4)] == [(0, None, 0), (1, 7.0, 1), (1, None, 2), (1, 7.0, 3)]


def test_chunks_without_own_events_are_not_made(txns):
    df = txns([{"id": i, "t": BASE + timedelta(days=90 * i), "s": "01_A", "r": "01_B"} for i in range(3)])
    text = history.feature_table(df, 30, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in text and "isnotnull(k_chunk" in text.replace("#", " ").lower()


def test_small_accounts_are_taken_together(txns, monkeypatch):
    df = txns(_world()).withColumn("event_time", F.when(F.col("txn_id") % 9 != 0, F.col("event_time")))
    together = history.history(df)
    assert together.select(F.spark_partition_id()).distinct().count() == 1  # one group of all twelve accounts
    monkeypatch.setattr(history, "_GROUP", 1)
    many, few = _rows(history.history(df)), _rows(together)
    assert set(few) == set(many)
    for key in few:
        assert all(few[key][c] == pytest.approx(many[key][c]) for c in HISTORY), key


def test_contacts_of_hubs_are_found_once(txns):
    plan = history.history(txns(_world()), 30, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # they are written, and not found again behind the degrees
