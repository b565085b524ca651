"""Spark ML's boosted trees, fitted by one barrier stage instead of a job for each level of each tree."""

from __future__ import annotations

import json
import secrets
import socket
import struct
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, SparkContext, TaskContext
from pyspark.ml import classification
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _delete, shared_dir, swept

#: Distinct values of a feature that a task's summary holds, about; up to it thresholds are exact.
SUMMARY = 4096
#: Rows of a block of codes, and the least rows that a further task is worth.
_BLOCK, _SHARE = 2048, 20_000
#: Below this a node's impurity counts as none, as in Spark ML.
_EPSILON = 2.0**-52


class GBTClassifier(classification.GBTClassifier):
    """``pyspark.ml``'s classifier with its settings, splits and persistence, for numeric features.

    Rows are read twice: for thresholds, from summaries of every row's values where Spark ML takes a
    sample of 10,000 rows, and as codes of a byte a feature. The tasks of one barrier stage then hold
    the codes, and for each level of a tree send histograms to the driver, which adds them up in the
    order of the tasks and answers with the splits. A split node's larger child has no histogram of its
    own: it is the node's less the smaller's. What this does not do (subsampling, drawn features,
    validation rows, nominal features) is left to Spark ML, as are sessions that cannot run a barrier
    stage.
    """

    def _fit(self, dataset: DataFrame) -> classification.GBTClassificationModel:
        tasks = _slots(dataset.sparkSession.sparkContext)
        if not tasks or not self._plain(dataset):
            return super()._fit(dataset)
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) and self.getWeightCol() else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w"))
        width, n, cuts = thresholds(rows, self.getMaxBins())
        if not n:
            return super()._fit(dataset)
        used = [f for f in range(width) if len(cuts[f])]
        grower = Grower(used, [cuts[f] for f in used], self.getMaxIter(), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain(), self.getStepSize())
        return self._copyValues(self._model(dataset.sparkSession, width, _grown(rows, grower, min(tasks, n // _SHARE + 1))))

    def _plain(self, dataset: DataFrame) -> bool:
        attrs = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        return (
            self.getSubsamplingRate() == 1.0 and self.getFeatureSubsetStrategy() == "all" and self.getLossType() == "logistic" and not self.getMinWeightFractionPerNode()
            and not self.isDefined(self.validationIndicatorCol) and self.getMaxBins() <= 256 and "nominal" not in attrs
        )

    def _model(self, spark: SparkSession, width: int, trees: list[Tree]) -> classification.GBTClassificationModel:
        """The trees as a model of Spark ML, read from its persisted form: one of a single tree, with its nodes replaced."""
        two = spark.createDataFrame([(Vectors.sparse(width, {}), 0.0, 1.0), (Vectors.sparse(width, {0: 1.0}), 1.0, 1.0)], [self.getFeaturesCol(), self.getLabelCol(), "w"])
        one = self.copy({self.maxIter: 1, self.minInstancesPerNode: 1, self.maxDepth: 1})
        one.clear(one.weightCol)
        path = f"{shared_dir(spark)}/tollgate-trees-{uuid.uuid4().hex}"
        try:
            classification.GBTClassifier._fit(_java(one), two).save(f"{path}/one")
            meta = json.loads(spark.read.text(f"{path}/one/metadata").first()[0])
            meta["paramMap"] |= {p.name: self.getOrDefault(p) for p in (self.maxIter, self.minInstancesPerNode, self.maxDepth)}
            if self.isDefined(self.weightCol) and self.getWeightCol():
                meta["paramMap"]["weightCol"] = self.getWeightCol()
            meta |= {"numTrees": len(trees), "uid": self.uid}
            spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/all/metadata")
            old = spark.read.parquet(f"{path}/one/treesMetadata")
            about = json.loads(old.first()[1])
            heads = [(i, json.dumps(about | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if i == 0 else self.getStepSize()) for i in range(len(trees))]
            spark.createDataFrame(heads, old.schema).write.parquet(f"{path}/all/treesMetadata")
            nodes = spark.read.parquet(f"{path}/one/data").schema
            spark.createDataFrame(_nodes(trees), nodes).write.parquet(f"{path}/all/data")
            return classification.GBTClassificationModel.load(f"{path}/all")
        finally:
            _delete(spark, path)


def _java(stage: GBTClassifier) -> GBTClassifier:
    stage._transfer_params_to_java()
    return stage


def _slots(sc: SparkContext) -> int:
    """Tasks that run at once; 0 where a barrier stage cannot run."""
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    jsc = sc._jsc.sc()
    return jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())


# Thresholds


def thresholds(rows: DataFrame, max_bins: int = 32) -> tuple[int, int, dict[int, np.ndarray]]:
    """Number of features and rows, and each feature's thresholds, by Spark ML's rule over the weighted values of all rows."""
    made = rows.select("x", "w").mapInArrow(_summaries, "feature int, n long, value array<double>, weight array<double>")
    with swept(rows.sparkSession):
        got = made.groupBy("feature").applyInArrow(lambda t: _cuts(t, max_bins), "feature int, n long, cuts array<double>").collect()
    return len(got), max((r["n"] for r in got), default=0), {r["feature"]: np.array(r["cuts"], float) for r in got}


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, of = np.unique(values, return_inverse=True)
    return at, np.bincount(of, weights, len(at))


def _thinned(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``SUMMARY`` of the values, each with the weight from the one before it on."""
    if len(values) <= SUMMARY:
        return values, weights
    reached = np.cumsum(weights)
    last = np.unique(np.concatenate([np.searchsorted(reached, reached[-1] * np.arange(1, SUMMARY) / SUMMARY), [0, len(values) - 1]]))
    return values[last], np.diff(reached[last], prepend=0.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        x, w = _matrix(b), b.column("w").to_numpy()
        held = held or [[(np.empty(0), np.empty(0))] for _ in range(x.shape[1])]
        n += len(x)
        for f, parts in enumerate(held):
            parts.append(_summed(x[:, f], w))
            if sum(len(v) for v, _ in parts) > 16 * SUMMARY:
                parts[:] = [_thinned(*_summed(*map(np.concatenate, zip(*parts))))]
    if held:
        kept = [_thinned(*_summed(*map(np.concatenate, zip(*parts)))) for parts in held]
        lists = [pa.array([k[i] for k in kept], pa.list_(pa.float64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), pa.array([n] * len(kept), pa.int64()), *lists], ["feature", "n", "value", "weight"])


def _cuts(table: pa.Table, max_bins: int) -> pa.Table:
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
    values, weights = _summed(flat("value"), flat("weight"))
    n = sum(table["n"].to_pylist())
    cuts = spark_cuts(values, weights, min(max_bins, n) - 1)
    return pa.table({"feature": table["feature"].slice(0, 1), "n": pa.array([n], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})


def spark_cuts(values: np.ndarray, weights: np.ndarray, most: int) -> list[float]:
    """All midpoints if few, else those that lie nearest to equal strides of weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle.tolist()
    stride, out = weights.sum() / (most + 1), []
    goal, reached = stride, np.cumsum(weights).tolist()
    for i in range(1, len(values)):
        if abs(reached[i - 1] - goal) < abs(reached[i] - goal):
            out.append(float(middle[i - 1]))
            goal += stride
    return out


# The stage


def _binned(cuts: list[np.ndarray], used: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of codes, a row of bytes for each feature in use: the number of thresholds below a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w = _matrix(b), b.column("y").to_numpy(), b.column("w").to_numpy()
            if not (np.isin(y, (0.0, 1.0)).all() and (w >= 0).all()):
                raise ValueError("labels must be 0 or 1 and weights at least 0")
            codes = np.empty((len(used), len(x)), np.uint8)
            for k, f in enumerate(used):
                codes[k] = np.searchsorted(cuts[k], x[:, f])
            at = [slice(i, i + _BLOCK) for i in range(0, len(x), _BLOCK)]
            columns = [pa.array([part] * len(at), pa.int64()), pa.array(range(seq, seq + len(at)), pa.int64()), *[pa.array([v[..., s].tobytes() for s in at], pa.binary()) for v in (codes, y, w)]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "codes", "y", "w"])
            seq += len(at)

    return run


def _grown(rows: DataFrame, grower: Grower, tasks: int) -> list[Tree]:
    """The trees: tasks grow them on their rows, a thread of the driver decides on the splits."""
    spark = rows.sparkSession
    conf = spark.sparkContext.getConf()
    one = conf.get("spark.master", "").startswith("local")
    host = "127.0.0.1" if one else conf.get("spark.driver.host")
    with socket.create_server(("127.0.0.1" if one else conf.get("spark.driver.bindAddress", host), 0), backlog=2 * tasks) as server:
        token = secrets.token_bytes(16)
        found = _Decider(server, grower, tasks, token)
        found.start()
        address, member = (host, server.getsockname()[1]), Member(grower)
        try:
            blocks = rows.mapInArrow(_binned(grower.cuts, grower.used), "part long, seq long, codes binary, y binary, w binary").repartition(tasks)
            with swept(spark):
                blocks.mapInArrow(lambda b: member.run(b, address, token), "n long", barrier=True).collect()
            found.join()
        finally:
            found.stop()
        if found.error:
            raise found.error
        return found.trees


def _send(conn: socket.socket, a: np.ndarray) -> None:
    conn.sendall(struct.pack("<q", a.nbytes))
    conn.sendall(memoryview(a.reshape(-1)).cast("B"))


def _take(conn: socket.socket, n: int) -> bytearray:
    out = bytearray(n)
    view = memoryview(out)
    while len(view):
        if not (got := conn.recv_into(view)):
            raise ConnectionError("the other side of the fit is gone")
        view = view[got:]
    return out


def _receive(conn: socket.socket) -> np.ndarray:
    return np.frombuffer(_take(conn, struct.unpack("<q", _take(conn, 8))[0]))


class _Decider(threading.Thread):
    """Adds up what the tasks send, in their order, and answers with the splits; begins anew with each attempt of the stage."""

    def __init__(self, server: socket.socket, grower: Grower, tasks: int, token: bytes):
        super().__init__(daemon=True)
        self.server, self.grower, self.tasks, self.token = server, grower, tasks, token
        self.trees, self.error, self.stopped, self.members = [], None, False, {}

    def run(self) -> None:
        self.server.settimeout(1.0)
        attempt = -1
        while not self.stopped:
            try:
                conn, _ = self.server.accept()
                conn.settimeout(60)
                token, part, at = bytes(_take(conn, 16)), *struct.unpack("<qq", _take(conn, 16))
                if not secrets.compare_digest(token, self.token) or at < attempt:
                    conn.close()
                    continue
                conn.settimeout(None)
                conn.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                conn.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
                self.members, attempt = ({} if at > attempt else self.members) | {part: conn}, at
                if len(self.members) == self.tasks:
                    conns = [self.members[p] for p in sorted(self.members)]
                    self.trees = self.grower.decide(lambda: self._sum(conns), lambda a: [_send(c, a) for c in conns])
                    return
            except TimeoutError:
                continue
            except OSError:  # a task is gone: the others see it too, and the stage is tried again
                self._close()
            except Exception as e:  # noqa: BLE001
                self.error = e
                break
        self._close()

    @staticmethod
    def _sum(conns: list[socket.socket]) -> np.ndarray:
        out = _receive(conns[0]).copy()
        for c in conns[1:]:
            out += _receive(c)
        return out

    def _close(self) -> None:
        for c in self.members.values():
            try:
                c.shutdown(socket.SHUT_RDWR)
            except OSError:
                pass
            c.close()
        self.members = {}

    def stop(self) -> None:
        self.stopped = True
        self._close()
        self.join()


# Growing


@dataclass
class Tree:
    """Nodes in the order they were decided on; ``left`` and ``right`` are their numbers, -1 for a leaf."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    stats: list[tuple[float, float, float, float]] = field(default_factory=list)  # rows, weight, sum, sum of squares


@dataclass
class Grower:
    """What both sides know: features in use with their thresholds, and the settings."""

    used: list[int]
    cuts: list[np.ndarray]
    rounds: int
    depth: int
    least: int
    min_gain: float
    step: float

    def __post_init__(self):
        self.bins = [len(c) + 1 for c in self.cuts]
        self.starts = np.concatenate([[0], np.cumsum(self.bins)]).astype(int)

    def decide(self, gather: Callable[[], np.ndarray], answer: Callable[[np.ndarray], object]) -> list[Tree]:
        return [self._tree(gather, answer) for _ in range(self.rounds)]

    def _tree(self, gather: Callable[[], np.ndarray], answer: Callable[[np.ndarray], object]) -> Tree:
        """One tree. Answers hold a row a node of the level: feature or -1, code, mean, and 1 if the right child is the smaller."""
        tree, level, size = Tree(), 0, int(self.starts[-1])
        number, of, small, before = [0], [], [], None
        for column in (tree.feature, tree.threshold, tree.gain, tree.left, tree.right, tree.stats):
            column.append(None)
        while number:
            got = gather()
            totals = got[: 4 * len(number)].reshape(len(number), 4)
            said = np.full((len(number), 4), -1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                said[:, 2] = np.where(totals[:, 1] > 0, totals[:, 2] / totals[:, 1], 0.0)
                impurity = totals[:, 3] / totals[:, 1] - said[:, 2] ** 2
            hist = None
            if level < self.depth and size:
                own = got[4 * len(number) :].reshape(3, -1, size)
                if before is None:
                    hist = own
                else:  # children stand in pairs
                    hist = np.empty((3, len(number), size))
                    pair = np.arange(len(of))
                    hist[:, 2 * pair + small] = own
                    hist[:, 2 * pair + 1 - small] = before[:, of] - own
                best = self._best(hist)
                split = (best[:, 0] >= 0) & ((level == 0) | ~(np.abs(impurity) < _EPSILON))
                said[split, 0], said[split, 1], said[split, 3] = best[split, 0], best[split, 1], best[split, 3]
            following = []
            for i, k in enumerate(number):
                f = int(said[i, 0])
                children = (-1, -1) if f < 0 else (len(tree.feature), len(tree.feature) + 1)
                tree.feature[k], tree.threshold[k], tree.gain[k] = (-1, 0.0, -1.0) if f < 0 else (self.used[f], float(self.cuts[f][int(said[i, 1])]), float(best[i, 2]))
                tree.left[k], tree.right[k], tree.stats[k] = *children, tuple(totals[i].tolist())
                if f >= 0:
                    following += children
                    for column in (tree.feature, tree.threshold, tree.gain, tree.left, tree.right, tree.stats):
                        column += [None, None]
            answer(said)
            of = np.flatnonzero(said[:, 0] >= 0)
            small, before, number, level = said[of, 3].astype(int), hist, following, level + 1
        return tree

    def _best(self, hist: np.ndarray) -> np.ndarray:
        """A row a node: feature or -1, code, gain, and 1 if the right side has fewer rows. Of equal gains the first feature's first threshold."""
        nodes, widest = hist.shape[1], max(self.bins)
        wide = np.zeros((3, nodes, len(self.bins), widest))
        lane = np.repeat(np.arange(len(self.bins)), self.bins)
        wide[:, :, lane, np.arange(self.starts[-1]) - self.starts[lane]] = hist
        below = np.cumsum(wide, axis=3)
        n, w, s = below[..., -1:]
        ln, lw, ls = below[..., :-1]
        ok = (ln >= max(self.least, 1)) & (n - ln >= max(self.least, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (ls * ls / lw + (s - ls) ** 2 / (w - lw) - s * s / w) / w
        gain = np.where(ok & np.isfinite(gain) & (gain >= self.min_gain), gain, -1.0).reshape(nodes, -1)
        at = gain.argmax(axis=1)
        f, code = np.divmod(at, widest - 1)
        out = np.empty((nodes, 4))
        out[:, 2] = gain[np.arange(nodes), at]
        out[:, 0], out[:, 1] = np.where(out[:, 2] > 0, f, -1), code
        left = ln[np.arange(nodes), f, code]
        out[:, 3] = n[np.arange(nodes), f, 0] - left < left
        return out


class Member:
    """A task's side of the fit."""

    def __init__(self, grower: Grower):
        self.g = grower

    def run(self, batches: Iterator[pa.RecordBatch], address: tuple[str, int], token: bytes) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        attempt = max(map(int, task.allGather(str(task.taskAttemptId()))))  # the same for all, and higher when the stage is tried again
        blocks = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["seq"]))  # the shuffle brings them in any order
        y = np.concatenate([np.frombuffer(r["y"]) for r in blocks] + [np.empty(0)]) * 2 - 1
        w = np.concatenate([np.frombuffer(r["w"]) for r in blocks] + [np.empty(0)])
        codes, at = np.empty((len(self.g.used), len(y)), np.uint8), 0
        for r in blocks:
            part = np.frombuffer(r.pop("codes"), np.uint8).reshape(len(self.g.used), len(r["y"]) // 8)
            codes[:, at : at + part.shape[1]] = part
            at += part.shape[1]
        del blocks
        with socket.create_connection(address) as conn:
            conn.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            conn.sendall(token + struct.pack("<qq", task.partitionId(), attempt))
            self.grow(codes, y, w, lambda a: _send(conn, a), lambda: _receive(conn))
        yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64())], ["n"])

    def grow(self, codes: np.ndarray, y: np.ndarray, w: np.ndarray, send: Callable[[np.ndarray], None], receive: Callable[[], np.ndarray]) -> np.ndarray:
        """The rows' scores after all rounds: means of the labels, then of the residuals of the logistic loss."""
        score = np.zeros(len(y))
        kinds, counts = np.unique(w, return_counts=True)
        self.common = float(kinds[counts.argmax()]) if len(kinds) else 0.0
        self.other = w != self.common
        for m in range(self.g.rounds):
            with np.errstate(over="ignore"):
                r = y if m == 0 else 4 * y / (1 + np.exp(2 * y * score))
            wr = w * r
            wrr, level = wr * r, 0
            nodes = counted = [np.arange(len(y))]
            while nodes:
                totals = np.array([(len(k), w[k].sum(), wr[k].sum(), wrr[k].sum()) for k in nodes])
                own = self._histograms(codes, w, wr, counted) if level < self.g.depth else np.empty(0)
                send(np.concatenate([totals.ravel(), own.ravel()]))
                following, counted = [], []
                for k, (f, code, mean, right) in zip(nodes, receive().reshape(-1, 4)):
                    if f < 0:
                        score[k] += mean * (1.0 if m == 0 else self.g.step)
                        continue
                    above = codes[int(f)].take(k, mode="clip") > code
                    pair = k[~above], k[above]
                    following += pair
                    counted.append(pair[int(right)])
                nodes, level = following, level + 1
        return score

    def _histograms(self, codes: np.ndarray, w: np.ndarray, wr: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
        """Rows, weight and weighted residual by node and code. Rows of the commonest weight are only counted."""
        if not nodes:
            return np.empty(0)
        out = np.empty((3, len(nodes), int(self.g.starts[-1])))
        rows = np.concatenate(nodes)
        node = np.repeat(np.arange(len(nodes)), [len(k) for k in nodes])
        sums, other = wr.take(rows), np.flatnonzero(self.other.take(rows))
        more = w.take(rows.take(other)) - self.common
        first: dict[int, np.ndarray] = {}
        for f, b in enumerate(self.g.bins):
            if b not in first:
                first[b] = node * b
            at, place = first[b] + codes[f].take(rows, mode="clip"), slice(self.g.starts[f], self.g.starts[f] + b)
            held = [np.bincount(at, None, len(nodes) * b), None, np.bincount(at, sums, len(nodes) * b)]
            held[1] = held[0] * self.common + np.bincount(at.take(other), more, len(nodes) * b)
            for i, h in enumerate(held):
                out[i, :, place] = h.reshape(len(nodes), b)
        return out


def _nodes(trees: list[Tree]) -> pa.Table:
    """The nodes as Spark ML persists them: numbered in preorder."""
    rows: list[dict] = []
    for t, tree in enumerate(trees):
        order, stack = [], [0]
        while stack:
            order.append(k := stack.pop())
            if tree.left[k] >= 0:
                stack += (tree.right[k], tree.left[k])
        number = {k: i for i, k in enumerate(order)} | {-1: -1}
        for k in order:
            n, w, s, ss = tree.stats[k]
            mean = s / w if w else 0.0
            split = {"featureIndex": tree.feature[k], "leftCategoriesOrThreshold": [tree.threshold[k]] if tree.left[k] >= 0 else [], "numCategories": -1}
            rows.append({"treeID": t, "nodeData": {
                "id": number[k], "prediction": mean, "impurity": ss / w - mean * mean if w else 0.0, "impurityStats": [w, s, ss], "rawCount": int(n), "gain": tree.gain[k],
                "leftChild": number[tree.left[k]], "rightChild": number[tree.right[k]], "split": split,
            }})
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    node = [("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)]
    return pa.Table.from_pylist(rows, pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct(node))]))
