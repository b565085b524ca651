"""The pipeline's stages over folders, each under a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import BUDGETS, FEATURES, ContractError, check
from ..operators import alerts, diagnostics, drift, history, labeling, leaks, nulls, replay, splits
from ..runlog import stage
from ..sources import files, transfers
from . import models


def verify_dataset(s: SparkSession, path: str, digest: str) -> dict:
    """Refuse a file that is not the one pinned by its SHA-256."""
    got = files.sha256(s, path)
    check(got == digest, ContractError, f"{path} has SHA-256 {got}, not {digest}")
    return {"path": path, "sha256": got}


def normalize(s: SparkSession, raw: str, dest: str, force: bool = False) -> dict:
    """Raw CSV to transfers by date, ids assigned once and checked on what was written."""

    def work(run):
        transfers.write_partitioned(transfers.normalize(transfers.read_raw(s, raw)), f"{dest}/txns")
        out = s.read.parquet(f"{dest}/txns")
        transfers.assert_identity(out)
        run.record(**diagnostics.ingest_stats(out).first().asDict())

    return stage(s, "normalize", {"raw": raw}, dest, [raw], work, force)


def parse_patterns(s: SparkSession, text: str, dest: str, force: bool = False) -> dict:
    """Pattern text to rings, ring_txns and ring_accounts."""

    def work(run):
        for name, df in transfers.ring_tables(transfers.read_patterns(s, text)).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{dest}/{name}")
        rings = s.read.parquet(f"{dest}/rings")
        got = rings.agg(
            F.count("*").alias("rings"), F.sum("n_txns").alias("ring_txns"), F.count_distinct("typology").alias("typologies"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
            F.median("n_txns").alias("median_txns_per_ring"), F.median("n_accounts").alias("median_accounts_per_ring"), F.max("duration_days").alias("max_duration_days"), F.count_if(F.col("n_txns") >= 3).alias("rings_ge_3_txns"),
        ).first().asDict()
        accounts = s.read.parquet(f"{dest}/ring_accounts").select("account_id").distinct().count()
        run.record(**got, distinct_ring_accounts=accounts, typology_counts={r["typology"]: r["count"] for r in rings.groupBy("typology").count().collect()})

    return stage(s, "parse_patterns", {"text": text}, dest, [text], work, force)


def reconcile(s: SparkSession, txns: str, patterns: str, dest: str, force: bool = False) -> dict:
    """Transfers with rings attached."""

    def work(run):
        rt = s.read.parquet(f"{patterns}/ring_txns")
        transfers.write_partitioned(labeling.attach_rings(s.read.parquet(f"{txns}/txns"), rt), f"{dest}/txns_labeled")
        run.record(**labeling.reconcile(s.read.parquet(f"{dest}/txns_labeled"), rt).first().asDict())

    return stage(s, "reconcile_labels", {"txns": txns, "patterns": patterns}, dest, [txns, patterns], work, force)


def build_features(s: SparkSession, labeled: str, dest: str, hub_days: int = history.HUB_DAYS, hub_events: int = history.HUB_EVENTS, force: bool = False) -> dict:
    """The causal feature table by date."""

    def work(run):
        transfers.write_partitioned(history.feature_table(s.read.parquet(f"{labeled}/txns_labeled"), hub_days, hub_events), f"{dest}/features")
        run.record(**history.feature_summary(s.read.parquet(f"{dest}/features")).first().asDict(), n_features=len(FEATURES), features=list(FEATURES))

    return stage(s, "build_features", {"labeled": labeled, "hub_days": hub_days, "hub_events": hub_events}, dest, [labeled], work, force)


def _sides(s: SparkSession, patterns: str, cut: str) -> tuple[DataFrame, DataFrame]:
    accounts = s.read.parquet(f"{patterns}/ring_accounts")
    return splits.ring_sides(s.read.parquet(f"{patterns}/rings"), accounts, cut), accounts


def build_splits(s: SparkSession, patterns: str, rows: str, cut: str, dest: str, protocol: str = "ring-aware", min_positive: int = 100, force: bool = False) -> dict:
    """Train and test rows of a table folder, checked as written."""

    def work(run):
        sides, accounts = _sides(s, patterns, cut)
        out = splits.split_rows(s.read.parquet(rows), sides, cut, protocol)
        out.write.mode("overwrite").partitionBy("part", "event_date").parquet(f"{dest}/split")
        sides.coalesce(1).write.mode("overwrite").parquet(f"{dest}/sides")
        got = s.read.parquet(f"{dest}/split")
        report = splits.assert_split(got, accounts, sides, cut, protocol, min_positive)
        more = splits.split_sets(s.read.parquet(f"{patterns}/rings"), accounts, cut).first().asDict() | splits.option_b(got.where("part = 'test'"), accounts, sides).first().asDict()
        run.record(cut_time=cut, protocol=protocol, assertions_passed=list(report.assertions), **(more | report.counts))

    return stage(s, "build_splits", {"patterns": patterns, "rows": rows, "cut": cut, "protocol": protocol}, dest, [patterns, rows], work, force)


def split_sweep(s: SparkSession, patterns: str, labeled: str, fractions: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> dict:
    """What each cut point would cost and keep, with the positive rate of what lies on either side."""
    rows = splits.sweep(s.read.parquet(f"{patterns}/rings"), s.read.parquet(f"{patterns}/ring_accounts"), tuple(float(f) for f in fractions)).orderBy("frac").collect()  # a row a cut
    txns = s.read.parquet(f"{labeled}/txns_labeled")
    flag, counts = F.col("is_laundering") == 1, []
    for i, r in enumerate(rows):
        before = F.col("event_time") < F.lit(r["cut"]).cast("timestamp_ntz")
        counts += [F.count_if(c).alias(f"{n}_{i}") for n, c in (("train_txns", before), ("test_txns", ~before), ("train_positives", before & flag), ("test_positives", ~before & flag))]
    got = txns.agg(*counts).first().asDict() if rows else {}
    return {"cuts": [r.asDict() | {n: got[f"{n}_{i}"] for n in ("train_txns", "test_txns", "train_positives", "test_positives")} for i, r in enumerate(rows)]}


def _sampled(rows: DataFrame, sample: float) -> tuple[DataFrame, DataFrame]:
    return splits.train_sample(rows.where("part = 'train'").drop("part"), sample), rows.where("part = 'test'").drop("part")


def model_stability(s: SparkSession, split: str, dest: str, seeds: Sequence[int] = (0, 1, 2, 3, 4), configs: str = "", budgets: Sequence[int] = (10, 50, 200), sample: float = 1.0, force: bool = False, **settings) -> dict:
    """How far each named configuration's metrics wander over seeds, and which to recommend."""

    def work(run):
        fit, test = _sampled(_checked_split(s, split), sample)
        names = [c for c in configs.split(",") if c] or list(models.CONFIGS)
        unknown = sorted(set(names) - set(models.CONFIGS))
        check(not unknown, ContractError, f"unknown configurations {unknown}")
        got = models.stability(fit, test, {n: {**models.CONFIGS[n], **settings} for n in names}, list(seeds), budgets)
        run.record(results=got, **(models.recommend(got) if "current" in got else {}))

    return stage(s, "model_stability", {"split": split, "seeds": list(seeds), "configs": configs, "budgets": list(budgets), "sample": sample, **settings}, dest, [f"{split}/split"], work, force)


def leak_sweep(s: SparkSession, split: str, leak_root: str, dest: str, seeds: Sequence[int] = (0, 1, 2, 3, 4), iters: int = models.GBT["maxIter"], sample: float = 1.0, force: bool = False, **settings) -> dict:
    """What every planted leak under ``leak_root`` buys over its placebo; fails unless the control separates."""

    def work(run):
        fit, test = _sampled(_checked_split(s, split), sample)
        kinds = [k for k in leaks.KINDS if files.exists(s, f"{leak_root}/{k}/leak")]
        check(bool(kinds), ContractError, f"no planted leak under {leak_root}")
        run.record(**models.leak_sweep(fit, test, {k: s.read.parquet(f"{leak_root}/{k}/leak") for k in kinds}, list(seeds), maxIter=iters, **settings))

    return stage(s, "leak_sweep", {"split": split, "leak_root": leak_root, "seeds": list(seeds), "iters": iters, "sample": sample, **settings}, dest, [f"{split}/split", leak_root], work, force)


def _checked_split(s: SparkSession, split: str) -> DataFrame:
    """The written split, refused unless it holds the rows that its manifest counted."""
    rows = s.read.parquet(f"{split}/split")
    if files.exists(s, f"{split}/_manifest.json"):
        want = files.read_json(s, f"{split}/_manifest.json").get("metrics", {})
        got = {f"{r['part']}_rows": r["count"] for r in rows.groupBy("part").count().collect()}
        wrong = {k: (got.get(k, 0), want[k]) for k in ("train_rows", "test_rows") if k in want and got.get(k, 0) != want[k]}
        check(not wrong, ContractError, f"the split and its manifest disagree: {wrong}")
    return rows


def train(s: SparkSession, split: str, dest: str, kind: str = "gbt", seed: int = 0, sample: float = 1.0, budgets: Sequence[int] = BUDGETS, resume: bool = False, force: bool = False, **settings) -> dict:
    """Fit on the train rows (sampled by ring), score the whole test side, evaluate.

    With ``resume`` a model that an earlier, failed run of the same settings has saved is taken as it is.
    """
    how = {"split": split, "kind": kind, "seed": seed, "sample": sample, **settings}

    def work(run):
        rows = _checked_split(s, split)
        saved = f"{dest}/model_of.json"
        if resume and files.exists(s, saved) and files.read_json(s, saved) == how:
            model = PipelineModel.load(f"{dest}/model")
        else:
            model = models.train(splits.train_sample(rows.where("part = 'train'").drop("part"), sample), kind, seed=seed, **settings)
            model.write().overwrite().save(f"{dest}/model")
            files.write_json(s, saved, how)  # last, so that a broken save is never taken
        test = rows.where("part = 'test'").drop("part")
        models.score(model, test).write.mode("overwrite").parquet(f"{dest}/scores")
        scores = s.read.parquet(f"{dest}/scores")
        run.record(**alerts.evaluate(alerts.scored_by(test, scores), budgets), **diagnostics.digest(scores).first().asDict())

    return stage(s, "train", {**how, "budgets": list(budgets)}, dest, [f"{split}/split"], work, force)


def rescore(s: SparkSession, model: str, rows: DataFrame) -> DataFrame:
    """Scores of a saved model."""
    return models.score(PipelineModel.load(model), rows)


def evaluate(s: SparkSession, split: str, scores: str, dest: str, budgets: Sequence[int] = BUDGETS, draws: int = 200, seed: int = 0, force: bool = False) -> dict:
    """Metrics of saved scores beside the permutation null and the bootstrap interval."""

    def work(run):
        test = alerts.scored_by(s.read.parquet(f"{split}/split").where("part = 'test'").drop("part"), s.read.parquet(scores)).persist()
        days, members = alerts.account_days(test), alerts.membership(test)
        alerts.refuse_orphans(days, alerts.endpoints(test))
        run.record(**alerts.evaluate(test, budgets))
        run.record(**replay.keyed(nulls.permutation_summary(nulls.permutation_draws(test, budgets, draws, seed))))
        run.record(**replay.keyed(nulls.bootstrap_ci(days, members, budgets, draws, seed)), ci_budget=50 if 50 in budgets else budgets[0])
        test.unpersist()

    return stage(s, "evaluate", {"split": split, "scores": scores, "budgets": list(budgets), "draws": draws, "seed": seed}, dest, [split, scores], work, force)


def plant_leak(s: SparkSession, labeled: str, dest: str, kind: str, force: bool = False) -> dict:
    """One leak's columns for every transfer."""

    def work(run):
        leaks.plant(s.read.parquet(f"{labeled}/txns_labeled"), kind).write.mode("overwrite").parquet(f"{dest}/leak")
        run.record(kind=kind, rows=s.read.parquet(f"{dest}/leak").count(), leak_columns=[f"{x}_{c}" for x in "sr" for c in leaks.COLUMNS[kind]])

    return stage(s, "plant_leak", {"labeled": labeled, "kind": kind}, dest, [labeled], work, force)


def make_drift(s: SparkSession, patterns: str, dest: str, n_buckets: int = 4, magnitude: float = 1.0, seed: int = 0, per_bucket: int | None = None, force: bool = False) -> dict:
    """Ring instances whose mix drifts, with their transfers."""

    def work(run):
        rings = s.read.parquet(f"{patterns}/rings")
        rt = s.read.parquet(f"{patterns}/ring_txns")
        made = drift.instances(rings, n_buckets, magnitude, seed, per_bucket)
        made.write.mode("overwrite").parquet(f"{dest}/drift_rings")
        made = s.read.parquet(f"{dest}/drift_rings")
        if "txn_id" not in rt.columns:
            rt = rt.withColumn("txn_id", F.xxhash64("ring_id", "event_time", "sender_id", "receiver_id", "amount_paid"))
        drift.instance_txns(made, rt).write.mode("overwrite").parquet(f"{dest}/drift_ring_txns")
        effect = drift.assert_drift(made, n_buckets, magnitude)
        run.record(instances=made.count(), drift_txns=s.read.parquet(f"{dest}/drift_ring_txns").count(), drift_is="INDUCED, not observed", **effect)

    return stage(s, "make_drift", {"patterns": patterns, "n_buckets": n_buckets, "magnitude": magnitude, "seed": seed, "per_bucket": per_bucket}, dest, [patterns], work, force)


def splice_drift(s: SparkSession, labeled: str, drifted: str, dest: str, seed: int = 0, force: bool = False) -> dict:
    """Background transfers with the drift spliced in."""

    def work(run):
        out = drift.splice(s.read.parquet(f"{labeled}/txns_labeled"), s.read.parquet(f"{drifted}/drift_ring_txns"), seed)
        transfers.write_partitioned(out, f"{dest}/txns_labeled")
        run.record(**drift.assert_splice(s.read.parquet(f"{dest}/txns_labeled")))

    return stage(s, "splice_drift", {"labeled": labeled, "drifted": drifted, "seed": seed}, dest, [labeled, drifted], work, force)


def drift_experiment(s: SparkSession, features: str, dest: str, t0: str, bucket_days: float, n_buckets: int, force: bool = False, **settings) -> dict:
    """All strategies on bucketed features; rows as CSV too."""

    def work(run):
        rows = drift.time_buckets(s.read.parquet(f"{features}/features"), t0, bucket_days, n_buckets)
        got = models.drift_experiment(rows, n_buckets, **settings)
        s.createDataFrame(got).coalesce(1).write.mode("overwrite").csv(f"{dest}/results", header=True)
        run.record(rows=got, recovery=models.recovery(got))

    return stage(s, "drift_experiment", {"features": features, "t0": t0, "bucket_days": bucket_days, "n_buckets": n_buckets, **settings}, dest, [features], work, force)


def make_bundle(s: SparkSession, split: str, scores: str, dest: str, cap: int = 1000, data_origin: str = "synthetic", force: bool = False) -> dict:
    """The replay bundle of saved scores."""

    def work(run):
        test = alerts.scored_by(s.read.parquet(f"{split}/split").where("part = 'test'").drop("part"), s.read.parquet(scores))
        replay.write(replay.build(test, cap), dest, cap, data_origin)
        run.record(max_budget=cap, tables=list(replay.TABLES))

    return stage(s, "make_bundle", {"split": split, "scores": scores, "cap": cap, "data_origin": data_origin}, dest, [split, scores], work, force)


def verify_bundle(s: SparkSession, bundle: str, manifest: str, budgets: Sequence[int]) -> dict:
    """Compare the metrics that a bundle gives with those that a manifest published."""
    tables, meta = replay.read(s, bundle)
    return replay.compare(replay.keyed(replay.recompute(tables, meta["max_budget"], budgets)), files.read_json(s, manifest)["metrics"])


def demo(s: SparkSession, dest: str, cut: str = "2022-09-07", budgets: Sequence[int] = (5, 20)) -> dict:
    """A small synthetic corpus through every stage from the raw files to a verified bundle; what each stage recorded."""
    raw, text = transfers.demo_corpus(s, f"{dest}/raw")
    got = {"normalize": normalize(s, raw, f"{dest}/bronze"), "parse_patterns": parse_patterns(s, text, f"{dest}/patterns"), "reconcile": reconcile(s, f"{dest}/bronze", f"{dest}/patterns", f"{dest}/gold")}
    got["build_features"] = build_features(s, f"{dest}/gold", f"{dest}/features")
    got["build_splits"] = build_splits(s, f"{dest}/patterns", f"{dest}/features/features", cut, f"{dest}/split", min_positive=1)
    got["train"] = train(s, f"{dest}/split", f"{dest}/model", "lr", budgets=budgets)
    got["evaluate"] = evaluate(s, f"{dest}/split", f"{dest}/model/scores", f"{dest}/eval", budgets, draws=20)
    got["make_bundle"] = make_bundle(s, f"{dest}/split", f"{dest}/model/scores", f"{dest}/bundle", 30)
    got["verify_bundle"] = verify_bundle(s, f"{dest}/bundle", f"{dest}/eval/_manifest.json", list(budgets))
    check(got["verify_bundle"]["exit"] == 0, ContractError, f"the bundle does not give the metrics again: {got['verify_bundle']}")
    return got
