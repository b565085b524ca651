"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alerts
from . import labels as L
from .common import buckets_for, gather, materialize, passing, small_batches

#: Rows of the embedding table, its columns, filters of each width, and the widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
#: Parts of a word whose hashed rows add up to its embedding: the word itself and its beginnings.
HEADS = (3, 4, 5, 6)
#: Labelled documents of each class that training starts from at most, documents beside them at most, and bytes of
#: text of either at most (documents in hash order until it is reached). All labelled documents follow.
TRAIN_EACH, CALIBRATE, MOST_BYTES = 2500, 4000, 32_000_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.05, 42
#: Rounds over all labelled documents, and documents of a shard, which goes on from the round's net by itself.
ROUNDS, SHARD = 2, 4000
#: A document is predicted toxic from this score.
CUT = 0.7
#: Words of the texts that one step convolves at most; a longer text goes in overlapping windows.
STEP = 200_000
#: Common words that tell a text's language, for thresholds; fixed values.
COMMON = {
    "en": ("the", "of", "and", "to", "is", "that", "for", "with", "was", "are"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "von", "zu", "mit", "den"),
    "fr": ("le", "les", "et", "des", "est", "une", "du", "dans", "pour", "que"),
    "es": ("el", "los", "las", "y", "del", "una", "por", "con", "para", "es"),
}
#: Words whose numbers a worker remembers between steps; beyond it the memory is emptied, which costs time only.
MEMORY = 300_000
_WORKER: list[Words] = []
_WORD = re.compile(r"\w+")
_PAD = 0


_LANGUAGES = (*COMMON, "other")
_SPOKEN = {w: k for k, words in enumerate(COMMON.values()) for w in words}


class Words(dict):
    """Number of each word seen, 0 for padding, with the table rows of its embedding and its language, if it is a common word."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[list[int]] = []
        self.rows = np.zeros((1, 1 + len(HEADS)), np.int64)
        self.spoken: list[int] = [len(COMMON)]

    def __missing__(self, word: str) -> int:
        parts = [f"w {word}", *(f"{n} {word[:n]}" if len(word) >= n else f"w {word}" for n in HEADS)]
        self.fresh.append([1 + zlib.crc32(p.encode("utf-8", "replace")) % (BUCKETS - 1) for p in parts])
        self.spoken.append(_SPOKEN.get(word, len(COMMON)))
        self[word] = len(self.spoken) - 1
        return self[word]

    def table_rows(self) -> np.ndarray:
        """Table rows of every word so far, by its number."""
        if self.fresh:
            self.rows = np.concatenate([self.rows, np.array(self.fresh, np.int64)])
            self.fresh = []
        return self.rows

    def numbers(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.__getitem__, _WORD.findall((text or "").lower()))), np.int32)

    def languages(self, docs: Sequence[np.ndarray]) -> list[str]:
        """Language whose common words each document has most of; ``other`` where it has none."""
        spoken = np.array(self.spoken, np.int8)
        counts = [np.bincount(spoken[d], minlength=len(_LANGUAGES))[: len(COMMON)] for d in docs]
        return [_LANGUAGES[int(c.argmax())] if c.any() else "other" for c in counts]


@dataclass
class Net:
    """Embedding table, filters of each width (width x DIM x FILTERS) with biases, and the output layer."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    limits: dict[str, float] = field(default_factory=dict)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(1)

    def pooled(self, docs: Sequence[np.ndarray], embedded: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Largest response of each filter over each document, and where; documents are padded with number 0.

        A word's part in a filter is computed once per distinct word, so a position costs additions.
        """
        wide = max(WIDTHS) - 1
        lens = np.array([len(d) for d in docs], np.int64) + 1 + wide
        flat = np.zeros(int(lens.sum()), np.int32)
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        for s, d in zip(starts, docs):
            flat[s : s + len(d)] = d
        n = len(flat) - wide
        ends = starts + lens - wide
        out, at = [], []
        for f, b in zip(self.filters, self.bias):
            r = (embedded @ f[0])[flat[:n]]
            for j in range(1, len(f)):
                r += (embedded @ f[j])[flat[j : n + j]]
            spans = np.stack([starts, ends], 1).ravel()
            top = np.maximum.reduceat(r, spans[: -1 if spans[-1] >= n else None])[::2]
            out.append(top + b)
            if where:
                at.append(np.stack([s + r[s:e].argmax(0) for s, e in zip(starts, ends)]))
        return np.hstack(out), np.stack(at, 1) if where else None, flat

    def logits(self, docs: Sequence[np.ndarray], embedded: np.ndarray) -> np.ndarray:
        """Logit of each document; long ones in windows that overlap by the widest filter, whose largest responses count."""
        out = np.zeros(len(docs))
        wide = max(WIDTHS) - 1
        step, size, todo = [], 0, []
        for k, d in enumerate(docs):
            cuts = [d[a : a + STEP + wide] for a in range(0, max(1, len(d)), STEP)]
            todo += [(k, c) for c in cuts]
        best = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for i, (k, c) in enumerate(todo):
            step.append((k, c))
            size += len(c)
            if size >= STEP or i == len(todo) - 1:
                top, _, _ = self.pooled([c for _, c in step], embedded)
                np.maximum.at(best, [k for k, _ in step], top.astype(np.float32))
                step, size = [], 0
        if len(docs):
            out = np.maximum(best, 0) @ self.out + self.shift
        return out

    def scores(self, texts: Sequence[str | None], words: Words | None = None) -> np.ndarray:
        """Score of each text from 0 to 1: its logit above its language's limit, set so that the limit scores ``CUT``."""
        words = words if words is not None else Words()
        docs = [words.numbers(t) for t in texts]
        limit = np.array([self.limits.get(k, self.limits[""]) for k in words.languages(docs)])
        used, flat = np.unique(np.concatenate([[_PAD], *docs]), return_inverse=True)
        cuts = np.cumsum([len(d) for d in docs])[:-1]
        embedded = self.embed(words.table_rows()[used])
        z = self.logits(np.split(flat[1:].astype(np.int32), cuts), embedded) - limit + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def new_net(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    table[_PAD] = 0
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.2).astype(np.float32)
    return Net(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, 0.0)


def gradient(net: Net, docs: Sequence[np.ndarray], rows: np.ndarray, y: np.ndarray) -> dict[str, object]:
    """Gradient of the mean log loss of some documents; it reaches only the words that a filter's maximum came from.

    ``rows`` are the table rows of each word's number. The table's gradient is given as the ids of the
    rows that it touches and their sums; the padding row has none.
    """
    used = np.unique(np.concatenate([[_PAD], *docs])).astype(np.int64)
    embedded = net.embed(rows[used])
    top, at, flat = net.pooled([np.searchsorted(used, d).astype(np.int32) for d in docs], embedded, True)
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.shift, -40, 40)))
    g = (p - y).astype(np.float32) / len(y)
    up = g[:, None] * net.out * (top > 0)
    back = np.zeros_like(embedded)
    filters, bias = [], []
    for k, f in enumerate(net.filters):
        own = up[:, k * FILTERS : (k + 1) * FILTERS]
        step = np.zeros_like(f)
        for j in range(len(f)):
            w = flat[at[:, k] + j]
            step[j] = np.einsum("bf,bfd->df", own, embedded[w])
            np.add.at(back, w, own[..., None] * f[j].T[None])
        filters.append(step)
        bias.append(own.sum(0))
    hit = np.flatnonzero(np.abs(back).sum(1) > 0)
    ids, inverse = np.unique(rows[used[hit]].ravel(), return_inverse=True)
    table = np.zeros((len(ids), DIM), np.float32)
    np.add.at(table, inverse, np.repeat(back[hit], rows.shape[1], axis=0))
    table[ids == _PAD] = 0
    return {"filters": filters, "bias": bias, "out": h.T @ g, "shift": float(g.sum()), "ids": ids, "table": table}


class Adagrad:
    """A net in training, with the sums of its squared gradients."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.table, self.out, self.shift = np.full(net.table.shape, 1e-6, np.float32), np.full(len(net.out), 1e-6), 1e-6
        self.filters = [np.full(f.shape, 1e-6, np.float32) for f in net.filters]
        self.bias = [np.full(FILTERS, 1e-6, np.float32) for _ in WIDTHS]

    def step(self, docs: Sequence[np.ndarray], rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One step on some documents; the table rows that it touches."""
        net, d = self.net, gradient(self.net, docs, rows, y)
        for k, (f, b) in enumerate(zip(d["filters"], d["bias"])):
            self.filters[k] += f**2
            net.filters[k] -= RATE * f / np.sqrt(self.filters[k])
            self.bias[k] += b**2
            net.bias[k] -= RATE * b / np.sqrt(self.bias[k])
        self.out += d["out"] ** 2
        net.out -= (RATE * d["out"] / np.sqrt(self.out)).astype(np.float32)
        self.shift += d["shift"] ** 2
        net.shift -= RATE * d["shift"] / np.sqrt(self.shift)
        ids = d["ids"]
        self.table[ids] += d["table"] ** 2
        net.table[ids] -= RATE * d["table"] / np.sqrt(self.table[ids])
        return ids


def _started(texts: Sequence[str | None], y: np.ndarray, epochs: int, seed: int) -> Adagrad:
    fit = Adagrad(new_net(seed))
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [words.numbers(t) for t in texts]
    rows = words.table_rows()
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, -(-len(docs) // BATCH))):
            if len(batch):
                fit.step([docs[i] for i in batch], rows, y[batch])
    return fit


def train(texts: Sequence[str | None], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Fit a net by Adagrad on the log loss."""
    return _started(texts, y, epochs, seed).net


def _flat(net: Net) -> np.ndarray:
    """All numbers of a net but its limits as rows of ``DIM``, the table's first."""
    small = np.concatenate([*[f.ravel() for f in net.filters], *net.bias, net.out, [net.shift], np.zeros(DIM - 1)])
    return np.concatenate([net.table, small.reshape(-1, DIM)])


def _unflat(net: Net, flat: np.ndarray) -> None:
    """Put the rows of ``_flat`` into a net."""
    net.table[:] = flat[:BUCKETS]
    rest, at = flat[BUCKETS:].ravel(), 0
    for part in (*net.filters, *net.bias, net.out):
        part[...] = rest[at : at + part.size].reshape(part.shape)
        at += part.size
    net.shift = float(rest[at])


def _shards(sent: Broadcast, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each shard's documents change of the net, one row for each row of ``_flat`` that they touch, times their number."""
    shard, fit, touched, n, words = None, None, set(), 0, Words()
    step, labels, size = [], [], 0

    def go() -> None:
        nonlocal n, size
        touched.update(fit.step(step, words.table_rows(), np.array(labels)).tolist())
        n, size = n + len(step), 0
        step.clear()
        labels.clear()
        if len(words) > MEMORY:
            words.__init__()
            words.clear()

    def end() -> pd.DataFrame:
        if step:
            go()
        keys = np.concatenate([np.array(sorted(touched), np.int64), np.arange(BUCKETS, len(before))])
        moved = n * (_flat(fit.net).astype(float) - before)[keys]
        return pd.DataFrame({"key": keys, "n": n} | {f"d{i}": moved[:, i] for i in range(DIM)})

    before = _flat(sent.value.net).astype(float)
    for batch in batches:
        for s, text, y in zip(batch["shard"], batch["text"], batch["y"]):
            if s != shard:
                if fit is not None:
                    yield end()
                shard, fit, touched, n = s, deepcopy(sent.value), set(), 0
            step.append(words.numbers(text))
            labels.append(y)
            size += len(step[-1])
            if len(step) == BATCH or size > STEP:
                go()
    if fit is not None:
        yield end()


def _round(fit: Adagrad, rows: DataFrame) -> None:
    """Train on all of ``rows(shard, order, l_id, text, y)``: every shard goes on from the same net, and what they change is averaged.

    A table row is averaged over the shards that touch it. What is collected has the size of the net.
    """
    sent = rows.sparkSession.sparkContext.broadcast(fit)  # a few MB, by BUCKETS and DIM
    schema = "key long, n long, " + ", ".join(f"d{i} double" for i in range(DIM))
    moved = rows.mapInPandas(lambda batches: _shards(sent, batches), schema)
    found = moved.groupBy("key").agg(*[(F.sum(f"d{i}") / F.sum("n")).alias(f"d{i}") for i in range(DIM)]).toPandas()
    flat = _flat(fit.net).astype(float)
    flat[found["key"].to_numpy()] += found[[f"d{i}" for i in range(DIM)]].to_numpy()
    _unflat(fit.net, flat)


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(l_id, order, y, text, shard), written: every labelled document, rows equal in id and text once; shard -1 where limits are set on it."""
    known = L.known(labels, label).withColumn("order", F.xxhash64(F.lit("toxicity"), "l_id")).withColumn("name", F.col("l_id").cast("string"))
    known = gather(known, "known")
    shards = buckets_for(known.count(), SHARD)
    some = passing(docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("name")), known.select("name"), "name").drop("name")
    rows = some.join(known, F.col("doc_id") == F.col("l_id")).withColumn("t", F.xxhash64("text")).dropDuplicates(["order", "l_id", "t"])
    shard = F.when(F.pmod("order", F.lit(4)) == 0, -1).otherwise(F.pmod(F.xxhash64("order"), F.lit(shards)))
    rows = rows.select("l_id", "order", "t", "y", "text", shard.cast("int").alias("shard"))
    return materialize(rows, "labelled")


def _limits(net: Net, rows: DataFrame) -> dict[str, float]:
    """The limit of each language with five toxic documents or more among ``rows(text, y)``, and, as "", that of all.

    Running sums over ranges of logits, so no task sorts all of them; a language or two logits' gap is all that is collected.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def told(texts: pd.Series) -> pd.DataFrame:
        words, out = Words(), []
        for a in range(0, len(texts), 512):
            numbers = [words.numbers(t) for t in texts.iloc[a : a + 512]]
            z = sent.value.logits(numbers, sent.value.embed(words.table_rows()))
            out.append(pd.DataFrame({"k": words.languages(numbers), "score": z}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "score": []})

    seen = rows.select("y", F.pandas_udf(told, "k string, score double")("text").alias("x")).select("y", "x.k", "x.score")
    levels = gather(seen.groupBy("k", "score").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("p")), "levels")
    n = levels.agg(F.sum("n")).first()[0] or 0
    empty = net.logits([np.zeros(0, np.int32)], net.embed(Words().table_rows()))
    floor = rows.sparkSession.createDataFrame([("", float(empty[0]), 1 + n // 20, 0)], levels.schema)
    whole = levels.withColumn("k", F.lit("")).unionByName(floor).groupBy("k", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    levels = gather(levels.where(F.col("k").isin(*COMMON)).unionByName(whole), "levels")
    total = levels.groupBy(F.col("k").alias("t_k")).agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    enough = (F.col("all_p") >= F.when(F.col("t_k") == "", 1).otherwise(5)) & (F.col("all_p") < F.col("all_n"))
    steps = alerts.running(levels, ["k"], alerts.score_ranges(levels)).join(F.broadcast(total.where(enough)), F.col("k") == F.col("t_k"))  # five languages at most
    f1 = 2 * (F.col("p_above") + F.col("p")) / (F.col("n_above") + F.col("n") + F.col("all_p"))
    best = steps.groupBy("k").agg(F.max_by("score", F.struct(f1, "score")).alias("best")).collect()  # one row a language
    out = {}
    for r in best:
        below = levels.where((F.col("k") == r["k"]) & (F.col("score") < r["best"])).agg(F.max("score")).first()[0]
        out[r["k"]] = (r["best"] + below) / 2 if below is not None else r["best"] - 1
    return {"": 0.0} | out


def limit(z: np.ndarray, y: np.ndarray) -> float | None:
    """The logit from which predicting 1 gives the best F1, in the middle of the gap below it; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


#: Tags of the samples: training documents of either class, and those that limits are set on.
_TOXIC, _OTHER, _LIMITS = 0, 1, 2


def _samples(docs: DataFrame, labels: DataFrame, label: str) -> dict[int, tuple[list[str | None], np.ndarray]]:
    """Texts and labels of each sample, by tag, from one pass over the documents.

    A sample takes the labelled ids of the least hashes, and of their documents at most as many, within
    ``MOST_BYTES``, in the order of hash, id and text. Rows equal in id and text count once.
    """
    most = {_TOXIC: TRAIN_EACH, _OTHER: TRAIN_EACH, _LIMITS: CALIBRATE}
    rows = L.known(labels, label).withColumn("order", F.xxhash64(F.lit("toxicity"), "l_id"))
    tag = F.when(F.pmod("order", F.lit(4)) == 0, _LIMITS).when(F.col("y") == 1, _TOXIC).otherwise(_OTHER)
    rows = gather(rows.withColumn("tag", tag), "tagged")
    parts = [rows.where(F.col("tag") == t).orderBy("order", "l_id").limit(n) for t, n in most.items()]
    ids = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "chosen")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # at most as many rows as the bounds add up to
    found = found.select("tag", "order", "l_id", "y", "text", F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    found = gather(found, "sample")
    key = ["order", "l_id", "t"]
    out: dict[int, tuple[list[str | None], np.ndarray]] = {}
    for t, n in most.items():
        own = found.where(F.col("tag") == t)
        sizes = own.groupBy(*key).agg(F.first("size").alias("size")).orderBy(*key).limit(n).collect()  # small rows, as many as the bound says
        total, kept = 0, set()
        for r in sizes:
            total += r["size"]
            if total > MOST_BYTES and kept:
                break
            kept.add(tuple(r[c] for c in key))
        out[t] = [], np.zeros(0)
        if kept:
            last = max(kept)
            upto = own.where(F.struct(*key) <= F.struct(*[F.lit(x).cast("long") for x in last])).dropDuplicates(key)
            texts = sorted((tuple(r[c] for c in key), r["text"], r["y"]) for r in upto.select(*key, "y", "text").collect())
            out[t] = [x[1] for x in texts], np.array([x[2] for x in texts])
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Net:
    """Train on all labelled documents, whole texts, and set a limit for each language.

    A bounded sample (``_samples``) only gives the net to start from. ``ROUNDS`` rounds over every
    labelled document follow, in shards whose changes are averaged, but for the fourth of them by hash
    that all limits are set on. A language whose documents there have one class only gets the limit of
    all; without both classes at all, no text reaches the limit.
    """
    some = _samples(docs, labels, label)
    pos, neg = some[_TOXIC], some[_OTHER]
    if not len(pos[1]) or not len(neg[1]):
        net = new_net()
        net.limits = {"": 50.0}
        return net
    empty = 1 + len(neg[1]) // 32  # a text without words is not toxic; what it yields is the floor of all others
    start = _started(pos[0] + neg[0] + [""] * empty, np.concatenate([pos[1], neg[1], np.zeros(empty)]), EPOCHS, SEED)
    rows = _labelled(docs, labels, label)
    own = rows.where("shard >= 0")
    shards = own.agg(F.max("shard")).first()[0]
    own = own.repartition((shards or 0) + 1, "shard").sortWithinPartitions("shard", "order", "l_id", "t")
    with small_batches(docs.sparkSession):
        for _ in range(ROUNDS):
            _round(start, own)
        start.net.limits = _limits(start.net, rows.where("shard = -1"))
    return start.net


def _scores(sent: Broadcast, text: Column) -> Column:
    def batch(texts: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(texts), 512):
            if len(_WORKER) == 0 or len(_WORKER[0]) > MEMORY:
                _WORKER[:] = [Words()]
            out.append(sent.value.scores(texts.iloc[a : a + 512].tolist(), _WORKER[0]))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return F.pandas_udf(batch, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Score every document: (doc_id, held_out, score, predicted); predicted 1 from a score of 0.7.

    Every word of a text is read, in windows where it is very long. The language that sets the limit
    is told from the text's own common words. Labels are learned from rows whose crc32 of the id as
    text, mod 3, is not 1. One row per input row; null and empty texts and texts without words are
    scored as padding, repeated rows alike; a null doc_id is not held out. No rows give no rows.
    Other columns are not read.
    """
    net = fit(docs, labels, label)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, by BUCKETS and DIM
    out = docs.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), _scores(sent, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
