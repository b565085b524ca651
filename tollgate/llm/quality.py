"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels as L
from .common import gather, materialize, small_batches

#: Fourier features, width of the Gaussian kernel over standardised statistics, ridge, and seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 42
#: Bins of raw scores that isotonic calibration pools, over the range that raw scores of 0/1 labels have.
BINS, LOW, HIGH = 2048, -1.0, 2.0
#: Share of the score that follows the raw score, so that order is kept where calibration is flat.
SLOPE = 0.01
_CUT = 0.5

_KINDS = np.zeros((256, 7))
for _c in range(256):
    _k = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in b" \t\n\r\x0b\x0c" else 4 if chr(_c) in ".,;:'\"-()?" else 5 if _c < 128 else 6
    _KINDS[_c, _k] = 1
STATS = ("lower", "upper", "digit", "space", "mark", "symbol", "beyond_ascii", "entropy", "log_words", "word_length", "word_spread", "long_words",
         "distinct_words", "top_word", "repeat_pairs", "log_lines", "line_words", "distinct_lines", "capital_words", "end_symbols")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of ``STATS``; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    flat = np.frombuffer(raw, np.uint8)
    n = max(1, len(flat))
    hist = np.bincount(flat, minlength=256)
    kinds = hist @ _KINDS / n
    p = hist[hist > 0] / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    pairs = len(set(zip(words, words[1:])))
    capital = sum(c for w, c in count.items() if 65 <= w[0] <= 90)
    odd = sum(c for w, c in count.items() if w[-1] in b"!#$%&*|@^~+=<>{}[]\\/_`")
    return [
        *kinds, float(-(p * np.log2(p)).sum()) if len(p) else 0.0, float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), float((sizes > 20).mean()),
        len(count) / m, max(count.values(), default=0) / m, 1 - pairs / max(1, m - 1) if m > 1 else 0.0, float(np.log1p(len(lines))), min(100.0, m / k), len(set(lines)) / k, capital / m, odd / m,
    ]


def statistics_of(text: Column) -> Column:
    """``statistics`` as a column of arrays of doubles."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return F.pandas_udf(batch, "array<double>")(text)


@dataclass(frozen=True)
class QualityModel:
    """A fitted scorer; a few thousand numbers, whatever it was fitted on."""

    center: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.center) / self.spread)

    def calibrate(self, raw: np.ndarray) -> np.ndarray:
        flat = np.interp(raw, self.knots, self.levels)
        steep = 1 / (1 + np.exp(-4 * np.clip(raw - _CUT, -50, 50)))
        return np.clip((1 - SLOPE) * flat + SLOPE * steep, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrate(self.fourier(stats) @ self.beta) if len(stats) else np.zeros(0)


def fourier(x: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Random Fourier features whose products approximate exp(-|x-y|^2 / (2 width^2)), and a constant."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((x.shape[1], features)) / width
    shift = rng.uniform(0, 2 * np.pi, features)
    return np.hstack([np.cos(np.clip(x, -10, 10) @ lines + shift) * np.sqrt(2 / features), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising x: centres and levels of the pools."""
    pools: list[list[float]] = []
    for a, w, m in zip(x, weight, mean):
        pools.append([a * w, w, m])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            b, v, q = pools.pop()
            p = pools[-1]
            p[2] = (p[2] * p[1] + q * v) / (p[1] + v)
            p[0] += b
            p[1] += v
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] for p in pools])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", ridge: float = RIDGE) -> QualityModel:
    """Fit on every labelled row that may be learned from.

    ``stats`` has (doc_id, stats). Each partition sums its normal equations, separately for two
    halves of the rows; the sums are added by matrix row, so the driver gets one matrix per half,
    whatever the number of partitions. Calibration pools the scores that each half gets from the
    other half's solution, summed in fixed bins. Without labels, or with one class only, all
    scores are near the mean label (0.5 without labels).
    """
    rows = stats.join(L.known(labels, label), F.col("doc_id") == F.col("l_id"))
    rows = gather(rows.select("stats", "y", F.pmod(F.xxhash64("l_id"), F.lit(2)).cast("int").alias("half")), "labelled")
    moments = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(len(STATS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *moments).first()
    zero, one = np.zeros(FEATURES + 1), np.array([0.0])
    if not got["n"] or got["y"] in (0.0, 1.0):
        return QualityModel(np.zeros(len(STATS)), np.ones(len(STATS)), zero, one, np.array([0.5 if not got["n"] else got["y"]]))
    center = np.array([got[f"m{i}"] for i in range(len(STATS))])
    spread = np.maximum([got[f"s{i}"] for i in range(len(STATS))], 1e-3)
    model = QualityModel(center, spread, zero, one, one)
    width = FEATURES + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width, width))
        for b in batches:
            z = np.hstack([model.fourier(np.stack(b["stats"])), b["y"].to_numpy()[:, None]])
            for h in (0, 1):
                own = z[b["half"].to_numpy() == h]
                total[h] += own.T @ own
        for h in (0, 1):
            yield pd.DataFrame({"half": h, "row": np.arange(width), "sums": list(total[h])})

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"half": [key[0]], "row": [key[1]], "sums": [np.sum(np.stack(b["sums"]), axis=0)]})

    schema = "half int, row int, sums array<double>"
    both = np.zeros((2, width, width))
    for r in rows.mapInPandas(sums, schema).groupBy("half", "row").applyInPandas(add, schema).collect():  # 2 x 258 rows
        both[r["half"], r["row"]] = r["sums"]

    def solve(m: np.ndarray) -> np.ndarray:
        n = max(1.0, m[-2, -2])
        return np.linalg.solve(m[:-1, :-1] + ridge * n * np.diag([1.0] * FEATURES + [1e-6]) + 1e-9 * np.eye(width - 1), m[:-1, -1])

    betas = [solve(both[1]), solve(both[0])]  # of each half, from the other

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, half = model.fourier(np.stack(b["stats"])), b["half"].to_numpy()
            raw = np.where(half == 0, z @ betas[0], z @ betas[1])
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            w = np.bincount(at, minlength=BINS)
            on = np.flatnonzero(w)
            yield pd.DataFrame({"bin": on, "n": w[on], "y": np.bincount(at, b["y"].to_numpy(), BINS)[on]})

    pooled = rows.mapInPandas(bins, "bin int, n long, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    x = np.array([LOW + (r["bin"] + 0.5) * (HIGH - LOW) / BINS for r in pooled])
    n = np.array([r["n"] for r in pooled], float)
    knots, levels = isotonic(x, n, np.array([r["y"] for r in pooled]) / n)
    return QualityModel(center, spread, solve(both[0] + both[1]), knots, levels)


def _scores(model: QualityModel, stats: Column) -> Column:
    def batch(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x)) if len(x) else [], dtype=float)

    return F.pandas_udf(batch, "double")(stats)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted); predicted 1 from a score of 0.5.

    Only statistics of the whole text enter a score. Labels are learned from rows whose crc32 of the
    id as text, mod 3, is not 1. One row per input row; null and empty texts are scored by their
    (zero) statistics, repeated rows alike; a null doc_id is not held out. No rows give no rows, no
    labels a score of about 0.5. Texts of any length are read whole; other columns, of whatever name,
    are not read.
    """
    with small_batches(docs.sparkSession):
        stats = materialize(docs.select("doc_id", statistics_of(F.col("text")).alias("stats")), "stats")
    model = fit(stats, labels, label)
    out = stats.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), _scores(model, F.col("stats")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= _CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents that the classifier predicts as good, with all columns of ``docs``; as ``classify`` otherwise.

    The statistics are taken once and written beside the documents.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), statistics_of(F.col("text")).alias("stats"))
    with small_batches(docs.sparkSession):
        rows = materialize(rows, "stats")
    model = fit(rows.select(F.col("d_id").alias("doc_id"), "stats"), labels, label)
    return rows.where(_scores(model, F.col("stats")) >= _CUT).select("row.*")
