from datetime import datetime, timedelta

import pandas as pd

from tollgate.operators import history
from tollgate.streaming import online, queries, windows

from .test_history import _rows, _world


def _stream(spark, df, path, cuts):
    for a, b in zip(cuts, cuts[1:]):
        df.where(f"event_time >= timestamp_ntz'{a}' and event_time < timestamp_ntz'{b}'").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_online_equals_batch_over_any_batches(spark, txns, tmp_path):
    df = txns(_world(5)).persist()
    days = [datetime(2022, 9, 1) + timedelta(days=d) for d in (0, 7, 20, 41, 99)]
    got = _rows(queries.run(spark, online.online_history(_stream(spark, df, tmp_path / "in", days))))
    want = _rows(history.history(df))
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == v or abs(got[k][c] - v) < 1e-6, (k, c)


def test_late_events_are_told(spark, txns, tmp_path):
    df = txns([{"id": 1, "t": 5, "s": "01_A", "r": "01_B"}, {"id": 2, "t": 3, "s": "01_A", "r": "01_C"}, {"id": 3, "t": 6, "s": "01_A", "r": "01_C"}])
    for i in (1, 2, 3):
        df.where(f"txn_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = {(r["txn_id"], r["side"]): r for r in queries.run(spark, online.online_history(stream)).collect()}
    assert len(got) == 6 and got[2, "s"]["n_30d"] is None and got[2, "r"]["n_30d"] == 0 and got[3, "s"]["n_30d"] == 1


def test_watermarked_windows(spark, txns, tmp_path):
    df = txns([{"id": i, "t": i / 4, "s": "01_A", "r": "01_B", "y": i % 2} for i in range(16)])
    out = queries.run(spark, windows.volume(_stream(spark, df, tmp_path / "v", [datetime(2022, 9, 1), datetime(2022, 9, 3), datetime(2022, 9, 9)]))).collect()
    assert {r["start"].day: r["transactions"] for r in out} == {1: 4, 2: 4, 3: 4}
    s = queries.run(spark, windows.account_sessions(_stream(spark, df, tmp_path / "s", [datetime(2022, 9, 1), datetime(2022, 9, 9)]), "7 hours")).collect()
    assert all(r["sender_id"] == "01_A" for r in s)


def test_state_grows_with_times_not_with_events():
    import pickle

    import numpy as np

    account, n = online.Account(), 60_000
    for day in range(3):
        got = account.observe(day * 86_400 + np.arange(n) % 100 * 60, np.array(["a", "b"] * (n // 2), object), np.ones(n), np.ones(n, np.int64))
    assert len(pickle.dumps(account)) < 50_000 and len(account.times.t) == 300 and len(account.cps) <= 4
    assert max(got["n_7d"]) == 2 * n + 99 * n // 100 and max(got["n_distinct_cp_ever"]) == 2 * n // 100


def test_contacts_within_a_minute_are_not_seen():
    import numpy as np

    account, one = online.Account(), lambda x: np.array([x])
    got = [account.observe(one(t), np.array(["a"], object), one(1.0), one(1))["secs_since_prev_cp"][0] for t in (0, 30, 70, 95)]
    assert [None if x is pd.NA else x for x in got] == [None, None, 70, 65]
