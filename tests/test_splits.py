from datetime import datetime, timedelta

import pytest

from tollgate.contract import LeakageError
from tollgate.operators import splits

CUT = "2022-09-10"


@pytest.fixture(scope="module")
def world(txns):
    day = lambda d: datetime(2022, 9, d, 12)
    ring = [(0, "01_A", "01_B", 1), (0, "01_A", "01_B", 5), (0, "01_A", "01_B", 12), (1, "01_C", "01_D", 11), (1, "01_C", "01_D", 13), (2, "01_B", "01_E", 12), (2, "01_B", "01_E", 14)]
    rows = [{"id": i, "t": day(d), "s": s, "r": r, "y": 1, "ring": k} for i, (k, s, r, d) in enumerate(ring)]
    rows += [{"id": 100 + 20 * d + i, "t": day(1) + timedelta(days=d), "s": f"01_N{i}", "r": f"01_M{i}"} for d in range(15) for i in range(20)]
    df = txns(rows).persist()
    rings, accounts = splits.rings_of(df), splits.ring_accounts_of(df)
    return df, rings, accounts, splits.ring_sides(rings, accounts, CUT)


def test_sides(world):
    _, rings, accounts, sides = world
    assert {r["ring_id"]: r["side"] for r in sides.collect()} == {0: "train", 1: "kept", 2: "dropped"}
    assert splits.split_sets(rings, accounts, CUT).first().asDict() == {"train_rings": 1, "test_rings_raw": 2, "dropped_rings": 1, "test_rings": 1, "overlap_accounts": 1}


def test_naive_leaks_and_ring_aware_does_not(world):
    df, _, accounts, sides = world
    naive, aware = (splits.split_rows(df, sides, CUT, p) for p in splits.PROTOCOLS[::-1])
    tails = lambda rows: rows.where("part = 'test' and ring_id = 0").count()
    assert tails(naive) == 1 and tails(aware) == 0
    a, b = (x.where("part = 'train'") for x in (naive, aware))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    report = splits.assert_split(aware, accounts, sides, CUT, min_positive=1)
    assert report.assertions == ("accounts_disjoint", "rings_disjoint", "no_temporal_bleed", "no_train_ring_tails_in_test")
    assert report.counts["train_positives"] == 2 and report.counts["test_positives"] == 2
    assert splits.assert_split(naive, accounts, sides, CUT, "naive", 1).assertions == ("no_temporal_bleed",)
    with pytest.raises(LeakageError):
        splits.assert_split(naive, accounts, sides, CUT, "ring-aware", 1)
    with pytest.raises(LeakageError, match="positive"):
        splits.assert_split(aware, accounts, sides, CUT, min_positive=10_000)


def test_the_cut_prunes_partitions(spark, world, tmp_path):
    df, _, _, sides = world
    df.write.partitionBy("event_date").parquet(str(tmp_path / "t"))
    rows = splits.split_rows(spark.read.parquet(str(tmp_path / "t")), sides, CUT).where("part = 'train'")
    assert "PartitionFilters: [isnotnull(event_date" in rows._jdf.queryExecution().executedPlan().toString()


def test_sweep_and_option_b(world):
    df, rings, accounts, sides = world
    got = splits.sweep(rings, accounts, (0.0, 0.8)).orderBy("frac").collect()
    assert got[0]["train_rings"] == 0 and got[0]["test_rings_kept"] == 3 and got[1]["cut"] == "2022-09-10" and got[1]["straddling"] == 1 and got[1]["dropped"] == 1
    b = splits.option_b(splits.split_rows(df, sides, CUT).where("part = 'test'"), accounts, sides).first()
    assert b["test_positive_account_days"] == 4 and b["unlabeled_positive_acct_days_touching_train_rings"] == 0
    assert splits.sweep(rings.limit(0), accounts).count() == 0


def test_sample_keeps_rings_whole(world):
    df = world[0]
    got = splits.train_sample(df, 0.5)
    assert 0 < got.count() < df.count()
    kept = {r["ring_id"]: r["n"] for r in got.where("ring_id is not null").groupBy("ring_id").count().withColumnRenamed("count", "n").collect()}
    full = {r["ring_id"]: r["n"] for r in df.where("ring_id is not null").groupBy("ring_id").count().withColumnRenamed("count", "n").collect()}
    assert all(full[k] == n for k, n in kept.items())
    for bad in (0, 1.5, float("nan"), -1):
        with pytest.raises(ValueError):
            splits.train_sample(df, bad)
    assert splits.train_sample(df, 1) is df
