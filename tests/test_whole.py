"""Registered queries over all rows and at their full number of draws, beside brute force."""

import os
import random
from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest

from tollgate import registry, storage
from tollgate.operators import alerts, nulls
from tollgate.plans import core, models
from tollgate.sources import adapters

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@tables
def test_splits_hold_every_ring(spark):
    e = adapters.evts(spark, SF)
    rings = e.where("ring_id is not null").select("ring_id").distinct().count()
    sets = _run(spark, "split_ring_sets")[0]
    assert rings > 17 and sets["train_rings"] + sets["test_rings_raw"] == rings
    assert {r["train_rings"] + r["test_rings_raw"] for r in _run(spark, "split_sweep")} == {rings}
    assert _run(spark, "split_optb_sensitivity") and sum(r["rows"] for r in _run(spark, "split_naive_vs_ring") if r["protocol"] == "naive") == e.count()


@tables
def test_components_hold_every_ring(spark):
    nodes, rings = defaultdict(set), defaultdict(set)
    pos, members = set(), set()
    for r in adapters.evts(spark, SF).collect():
        for a in (r["sender_id"], r["receiver_id"]):
            if r["is_laundering"]:
                pos.add((r["event_date"], a))
            if r["ring_id"] is not None:
                members.add(((r["event_date"], a), r["ring_id"]))
    for n, ring in members:
        nodes[n].add(ring)
        rings[ring].add(n)
    want = {}
    for n in pos:
        seen, todo = {n}, [n]
        while todo:
            for ring in nodes[todo.pop()]:
                todo += rings[ring] - seen
                seen |= rings[ring]
        day, acct = min(seen)
        want[n] = f"a:{day.isoformat()}|{acct}"
    got = {(r["day"], r["acct"]): r["cluster"] for r in _run(spark, "ring_components")}
    assert got == want and len(rings) > 17
    assert len(_run(spark, "bootstrap_ci")) == 3


def test_counterfactual_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.3), float(rng.randrange(40))) for i in range(300)]
    kept, out = rows[:220], [r for r in rows[220:] if r[1]]
    frame = lambda x: spark.createDataFrame(x, "txn_id long, is_laundering int, score double")
    got = {r["draw"]: r["ap"] for r in nulls.counterfactual(frame(rows[220:]), frame(kept), 6, 5).collect()}
    pool = sorted((md5(str(i).encode()).hexdigest(), i, s) for i, y, s in kept if y)
    for draw in range(7):
        moved = out if not draw else [(i, 1, pool[int(md5(f"5|{draw}|{i}".encode()).hexdigest()[:8], 16) % len(pool)][2]) for i, _, _ in out]
        every = kept + moved
        total = sum(y for _, y, _ in every)
        ap = 0.0
        for s in {x[2] for x in every}:
            above = [y for _, y, v in every if v >= s]
            ap += sum(y for _, y, v in every if v == s) / total * sum(above) / len(above)
        assert got[draw] == pytest.approx(ap)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_splice_holds_every_instance(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["drift_splice_checks"](spark, sf).first()
    made = registry.queries()["drift_instance_txns"](spark, sf)
    background = adapters.txns(spark, sf).where("is_laundering = 0").count()
    assert got["ring_instances"] == 96 == made.select("instance_id").distinct().count() and got["positives"] == made.count()
    assert got["rows"] == got["distinct_ids"] == background + got["positives"]
    assert got["accounts_in_several_rings"] == 0 and got["laundering_accounts_also_in_background"] == got["laundering_accounts"]


@tables
def test_full_permutation_summary(spark):
    draws, got = _run(spark, "permutation_null"), _run(spark, "permutation_summary")
    for r in got:
        seen = next(x["ring_recall"] for x in draws if (x["draw"], x["k"]) == (0, r["k"]))
        null = [x["ring_recall"] for x in draws if x["draw"] and x["k"] == r["k"]]
        assert r["permutations"] == 1000 == len(null) and r["p"] == pytest.approx((1 + sum(x >= seen for x in null)) / 1001, abs=1e-8)
        assert (r["null_lo"], r["null_hi"]) == pytest.approx(tuple(np.quantile(null, [0.025, 0.975])), abs=1e-8)


@tables
@pytest.mark.parametrize("name", ["typology_spread_ratio", "typology_concentration", "holm_resolution", "permutation_summary"])
def test_nulls_leave_no_tables_of_days(spark, monkeypatch, name):
    monkeypatch.setattr(core, "DRAWS", 70)
    before = set(storage._WRITTEN)
    _run(spark, name)
    left = [storage._WRITTEN[p] for p in set(storage._WRITTEN) - before]
    assert left and set(left) <= {"draws", "rates", "shapes", "spread"}


@tables
def test_full_bootstrap_equals_brute_force(spark):
    e = adapters.evts(spark, SF)
    rank = {(r["day"], r["acct"]): r["rank_first"] for r in alerts.ranked(alerts.account_days(e)).collect()}
    own = [(r["cluster"], rank[r["day"], r["acct"]]) for r in nulls.clusters(alerts.account_days(e), alerts.membership(e)).collect()]
    got = _run(spark, "bootstrap_ci")
    weights = []
    for draw in range(1, 1001):
        u = {c: int(md5(f"0|{draw}|{c}".encode()).hexdigest()[:8], 16) % 10**8 / 1e8 for c, _ in own}
        weights.append({c: sum(x >= p for p in nulls.POISSON) for c, x in u.items()})
    for r in got:
        recall = [sum(w[c] for c, at in own if at <= r["k"]) / sum(w[c] for c, _ in own) for w in weights]
        assert r["n_bootstrap"] == 1000 and (r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(np.quantile(recall, [0.025, 0.975])), abs=1e-8)


@tables
def test_boosted_trees_keep_their_settings(spark, monkeypatch):
    used = {}

    class Seen(Exception):
        pass

    def trees(**settings):
        used.update(settings)
        raise Seen

    monkeypatch.setattr(models, "GBTClassifier", trees)
    with pytest.raises(Seen):
        registry.queries()["model_gbt_scores"](spark, SF)
    assert models.GBT.items() <= used.items()


@tables
def test_fits_read_written_rows(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(rows, *a, **settings):
        assert (files := rows.inputFiles()) and all("/tollgate-model_rows-" in f for f in files)
        raise Seen

    monkeypatch.setattr(models, "train", fit)
    with pytest.raises(Seen):
        registry.queries()["model_gbt_scores"](spark, SF)
