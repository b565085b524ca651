"""Classifiers on the feature table, and the experiments that refit them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import FEATURES, LeakNotDetected, MetricError, check
from ..functions.columns import bucket
from ..functions.stats import spread
from ..operators import alerts, leaks
from ..operators.boost import GBTClassifier
from ..operators.drift import typology_weights
from ..operators.history import feature_table
from ..operators.order import coded
from ..storage import materialize

#: Settings of the boosted trees; fixed values.
GBT = {"stepSize": 0.1, "maxIter": 300, "maxDepth": 8, "minInstancesPerNode": 40}
CONFIGS = {
    "current": GBT, "slow_long": {**GBT, "stepSize": 0.05, "maxIter": 600}, "slow_long_bigleaf": {**GBT, "stepSize": 0.05, "maxIter": 600, "minInstancesPerNode": 200},
    "bigleaf": {**GBT, "minInstancesPerNode": 200}, "unweighted": {**GBT, "weighted": False},
}
CATEGORICAL = ("payment_format_code", "payment_currency_code")
STRATEGIES = ("frozen", "naive_retrain", "sliding_window", "typology_replay")
REPORT = ("average_precision__txn", "recall_efficiency@50", "precision@50", "recall@50", "ring_recall@200")


def class_weights(rows: DataFrame) -> DataFrame:
    """(is_laundering, n, weight): all rows over twice the class's."""
    counts = rows.groupBy("is_laundering").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("is_laundering", "n", (F.col("total") / (F.lit(2.0) * F.col("n"))).alias("weight"))  # two rows and one


def weighted(rows: DataFrame, weights: str | None = None) -> DataFrame:
    """Add ``w``: the class's weight, times a column where one is named."""
    by = class_weights(rows).select(F.col("is_laundering").alias("w_class"), F.col("weight").alias("class_weight"))
    out = rows.join(F.broadcast(by), F.col("is_laundering") == F.col("w_class"))  # two rows
    return out.withColumn("w", F.col("class_weight") * (F.col(weights) if weights else F.lit(1.0))).drop("w_class", "class_weight")


def _flags(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, and whether each was null: a cold start is information that imputing loses."""
    return rows.select("*", *[F.col(f).cast("double").alias(f"x_{f}") for f in features], *[F.col(f).isNull().cast("double").alias(f"null_{f}") for f in features])


def train(rows: DataFrame, kind: str = "gbt", features: Sequence[str] = FEATURES, seed: int = 0, weights: str | None = None, one_hot: bool = False, **settings) -> PipelineModel:
    """Fit a logistic regression (``lr``) or boosted trees (``gbt``) with balanced classes.

    Nulls are imputed by the median beside an indicator; the regression's inputs are standardised.
    With ``one_hot`` the categories of the train rows become indicators, unseen ones none of them.
    """
    check(kind in ("lr", "gbt"), ValueError, f"unknown model {kind!r}")
    plain = [f for f in features if not (one_hot and f in CATEGORICAL)]
    seen = rows.agg(F.count_distinct("is_laundering").alias("classes"), *[F.count(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f"n_{k}") for k, f in enumerate(plain)]).first()
    check(seen["classes"] == 2, MetricError, "train rows hold one class only")
    inputs = [f"x_{f}" for k, f in enumerate(plain) if seen[f"n_{k}"]]  # what has no value at all has no median, and only its indicator is used
    stages = [Imputer(strategy="median", inputCols=inputs, outputCols=[f"i_{c}" for c in inputs])] if inputs else []
    columns = [f"i_{c}" for c in inputs] + [f"null_{f}" for f in plain]
    if one_hot:
        cats = [f for f in features if f in CATEGORICAL]
        stages += [StringIndexer(inputCols=cats, outputCols=[f"n_{c}" for c in cats], handleInvalid="keep"), OneHotEncoder(inputCols=[f"n_{c}" for c in cats], outputCols=[f"o_{c}" for c in cats])]
        columns += [f"o_{c}" for c in cats]
    stages.append(VectorAssembler(inputCols=columns, outputCol="raw"))
    balanced = settings.pop("weighted", True)
    if kind == "lr":
        stages += [StandardScaler(withMean=True, inputCol="raw", outputCol="vector"), LogisticRegression(labelCol="label", featuresCol="vector", weightCol="w", maxIter=settings.get("maxIter", 100))]
    else:
        stages.append(GBTClassifier(labelCol="label", featuresCol="raw", weightCol="w", seed=seed, checkpointInterval=50, **{**GBT, **settings}))
    data = weighted(rows, weights) if balanced else rows.withColumn("w", F.lit(1.0))
    return Pipeline(stages=stages).fit(_flags(data, features).withColumn("label", F.col("is_laundering").cast("double")))


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(txn_id, score): the probability of laundering, keyed by id and never by position."""
    out = model.transform(_flags(rows, features))
    return out.select("txn_id", vector_to_array("probability")[1].alias("score"))


def load_test(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """What evaluation needs of test rows: features as floats, labels, and dense account codes for the ids; no row is lost or repeated."""
    keep = [c for c in ("txn_id", "event_time", "event_date", "is_laundering", "ring_id", "typology") if c in rows.columns]
    floats = [F.col(f).cast("float").alias(f) for f in features]
    return coded(rows.select(*keep, "sender_id", "receiver_id", *floats)).drop("sender_id", "receiver_id").withColumnsRenamed({"sender_code": "sender_id", "receiver_code": "receiver_id"})


def scored(model: PipelineModel, rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return alerts.scored_by(rows, score(model, rows, features))


def ensemble(scores: Sequence[DataFrame]) -> DataFrame:
    """Mean score of each transfer over several fits."""
    rows = scores[0]
    for s in scores[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("txn_id").agg(F.avg("score").alias("score"))


def stability(train_rows: DataFrame, test: DataFrame, configs: Mapping[str, Mapping], seeds: Sequence[int], budgets: Sequence[int] = (10, 50, 200), features: Sequence[str] = FEATURES) -> dict[str, dict]:
    """Per configuration: metrics of every seed, their spread, the ensemble's, and its curve over sizes."""
    out = {}
    for name, settings in configs.items():
        scores = [score(train(train_rows, "gbt", features, s, **dict(settings)), test, features).persist() for s in seeds]
        per_seed = [alerts.evaluate(alerts.scored_by(test, p), budgets) for p in scores]
        sizes = [alerts.evaluate(alerts.scored_by(test, ensemble(scores[:n])), budgets) for n in range(1, len(seeds) + 1)]
        keys = [k for k in REPORT if all(m.get(k) is not None for m in per_seed)]
        out[name] = {
            "per_seed": [{k: m[k] for k in keys} for m in per_seed], "stability": {k: spread([m[k] for m in per_seed]) for k in keys},
            "ensemble": {k: sizes[-1][k] for k in keys}, "ensemble_size_curve": [{k: m[k] for k in keys} for m in sizes],
            "per_typology": typology_summary([m["per_typology"] for m in per_seed], sizes[-1]["per_typology"]),
        }
        for p in scores:
            p.unpersist()
    return out


def typology_summary(per_seed: Sequence[Mapping], whole: Mapping, budget: int = 50) -> dict[str, dict]:
    """Ring recall of each shape over seeds, and how far the easiest lies from the hardest."""
    key, out = f"ring_recall@{budget}", {"_metric": {"metric": f"ring_recall@{budget}", "budget": budget}}
    for t in sorted({t for d in per_seed for t in d}):
        v = [d[t][key] for d in per_seed if t in d and key in d[t]]
        if v:
            out[t] = {"per_seed_mean": round(sum(v) / len(v), 4), "per_seed_min": round(min(v), 4), "per_seed_max": round(max(v), 4), "n_seeds": len(v), "ensemble": round(whole[t][key], 4) if t in whole and key in whole[t] else None}
    held = {t: x["ensemble"] for t, x in out.items() if x.get("ensemble") is not None}
    if len(held) > 1:
        lo, hi = min(held, key=held.get), max(held, key=held.get)
        out["_spread"] = {"hardest": lo, "easiest": hi, "ratio": round(held[hi] / held[lo], 2) if held[lo] else None}
    return out


def recommend(results: Mapping[str, Mapping], key: str = "recall_efficiency@50", incumbent: str = "current") -> dict[str, object]:
    """Stable first, then good: of the configurations with at most half the incumbent's spread, the best ensemble; else the steadiest."""
    wide = {n: r["stability"][key]["spread_pct"] for n, r in results.items()}
    fit = [n for n in results if wide[n] <= wide[incumbent] / 2]
    pick = max(fit, key=lambda n: results[n]["ensemble"]["average_precision__txn"]) if fit else min(results, key=lambda n: wide[n])
    return {"recommended_config": pick, "incumbent_spread_pct": wide[incumbent], "recommended_spread_pct": wide[pick], "halved_incumbent_spread": bool(fit)}


def leak_sweep(train_rows: DataFrame, test: DataFrame, tables: Mapping[str, DataFrame], seeds: Sequence[int], features: Sequence[str] = FEATURES, control: str = "target", **settings) -> dict[str, object]:
    """Per leak: the average precision it buys over the clean fit against its placebo, paired by seed.

    Raises ``LeakNotDetected`` unless the label-derived control separates.
    """
    strata = train_rows.select("txn_id", leaks.stratum(F.lit("train"), F.col("event_date")).alias("stratum"))
    strata = strata.unionByName(test.select("txn_id", leaks.stratum(F.lit("test"), F.col("event_date")).alias("stratum")))
    ratios: dict[str, dict[str, list[float]]] = {k: {"real": [], "placebo": []} for k in tables}
    ap = lambda model, rows, used: alerts.average_precision(scored(model, rows, used)).first()["average_precision__txn"]
    for seed in seeds:
        clean = ap(train(train_rows, "gbt", features, seed, **settings), test, features)
        for kind, table in tables.items():
            columns = [f"{s}_{c}" for s in "sr" for c in leaks.COLUMNS[kind]]
            used = [*features, *columns]
            for arm, held in (("real", table), ("placebo", leaks.permute(table, strata, columns, 1000 + seed))):
                a, b = leaks.merge(train_rows, held, columns), leaks.merge(test, held, columns)
                ratios[kind][arm].append(ap(train(a, "gbt", used, seed, **settings), b, used) / clean if clean else float("inf"))
    ladder = {k: leaks.verdict(r["real"], r["placebo"]) for k, r in ratios.items()}
    every = [x for r in ratios.values() for x in r["placebo"]]
    found = {"ladder": ladder, "noise_floor": {"placebo_ap_ratio_min": min(every), "placebo_ap_ratio_max": max(every)}, "channels_separating_from_placebo": sum(v["separates_from_placebo"] for v in ladder.values())}
    if control in ladder:
        check(ladder[control]["separates_from_placebo"], LeakNotDetected, f"the label-derived control did not separate: {ladder[control]}")
    return found


def drift_experiment(rows: DataFrame, n_buckets: int, train_buckets: int = 2, budgets: Sequence[int] = (10, 50, 200), seed: int = 0, window: int = 2, features: Sequence[str] = FEATURES, sample: float = 1.0, **settings) -> list[dict]:
    """Metrics (bucket, strategy, ...) of bucketed feature rows, refitting by each strategy.

    frozen keeps the fit on the first buckets; naive_retrain adds every bucket before; sliding_window
    keeps the last ones; typology_replay is naive_retrain with every shape weighing the same.
    ``sample`` keeps a share of the transfers, by a hash of their ids.
    """
    if sample < 1:
        rows = rows.where(bucket(F.col("txn_id"), 10_000) < int(sample * 10_000))
    past = {"frozen": lambda b: F.col("bucket") < train_buckets, "naive_retrain": lambda b: F.col("bucket") < b, "sliding_window": lambda b: F.col("bucket").between(b - window, b - 1), "typology_replay": lambda b: F.col("bucket") < b}
    out, frozen = [], None
    for b in range(train_buckets, n_buckets):
        test = rows.where(F.col("bucket") == b).drop("bucket")
        for name in STRATEGIES:
            known = rows.where(past[name](b)).drop("bucket")
            if name == "frozen" and frozen is not None:
                model = frozen
            elif name == "typology_replay":
                model = train(typology_weights(known), "gbt", features, seed, weights="weight", **settings)
            else:
                model = train(known, "gbt", features, seed, **settings)
            frozen = model if name == "frozen" else frozen
            got = alerts.evaluate(scored(model, test, features), budgets, per_typology=False)
            out.append({"bucket": b, "strategy": name} | {k: v for k, v in got.items() if isinstance(v, (int, float))})
    return out


def recovery(rows: Sequence[Mapping], key: str = "recall_efficiency@50") -> dict[str, float | None]:
    """How far the frozen model decays from the first evaluated bucket to the last, and the share that each other strategy wins back there."""
    first, last = min(r["bucket"] for r in rows), max(r["bucket"] for r in rows)
    at = {(r["bucket"], r["strategy"]): r[key] for r in rows}
    decay = at[first, "frozen"] - at[last, "frozen"]
    return {"frozen_decay": decay} | {s: (at[last, s] - at[last, "frozen"]) / decay if decay else None for s in STRATEGIES[1:]}


def ablation(train_rows: DataFrame, test: DataFrame, budgets: Sequence[int] = (10, 50, 200), features: Sequence[str] = FEATURES, **settings) -> dict[str, dict]:
    """Metrics with the categories as codes, without them, and as indicators of the train vocabulary."""
    bare = [f for f in features if f not in CATEGORICAL]
    arms = {"full": (features, False), "no_categorical": (bare, False), "one_hot": (features, True)}
    return {n: alerts.evaluate(scored(train(train_rows, "gbt", f, one_hot=hot, **settings), test, f), budgets) for n, (f, hot) in arms.items()}


def train_stage(labeled: DataFrame, cut: str, sides: DataFrame, kind: str = "lr", protocol: str = "ring-aware", **settings) -> tuple[PipelineModel, DataFrame]:
    """Features, split, fit and scores of the test side, ready for ``alerts.evaluate``.

    The feature rows are written once: a fit reads its rows many times before the first round.
    """
    from ..operators.splits import split_rows

    rows = materialize(split_rows(materialize(feature_table(labeled), "features"), sides, cut, protocol), "model_rows")
    model = train(rows.where("part = 'train'").drop("part"), kind, **settings)
    return model, scored(model, rows.where("part = 'test'").drop("part"))
