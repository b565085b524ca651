"""Vectors in shards that a tree over low coordinates deals out, and the routing of queries to the shards that can matter.

Every search here takes a stated query set against all rows. A tree, fitted on a bounded sample, cuts
the rows into regions of like vectors; a region's rows are dealt to shards of bounded size, each
written as one packed row with a summary of what it holds. A query first visits one shard of its most
promising region, which gives it a k-th score. It then visits the shards of those regions alone whose
summary says that they may hold a row as good. Cells, a part of the queries with one shard, are
independent, so a lost executor costs only its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize

#: Vectors of a shard, and queries of a cell, on average.
SHARD, CHUNK = 4096, 4096
#: Tasks of one search, rows and bytes of the sample that trees are fitted on, and leaves of a tree, at most.
MOST_TASKS, SAMPLE, SAMPLE_BYTES, MOST_LEAVES = 20_000, 16_384, 16_000_000, 1024
#: Rows of a block or leaf within a shard.
BLOCK = 64
#: Queries of a batch that are routed together.
_STEP = 4096

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Tree:
    """A binary tree: the line that each inner node projects rows on, and the value that it cuts at, level by level."""

    lines: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, low: np.ndarray) -> np.ndarray:
        at = np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            go = np.zeros(len(low), np.int64)
            for node in np.unique(at):
                on = np.flatnonzero(at == node)
                go[on] = low[on] @ self.lines[node] > self.cut[node]
            at = 2 * at + 1 + go
        return at - (2**self.depth - 1)


def widest(low: np.ndarray) -> np.ndarray:
    """The line of the coordinate that the rows spread over most."""
    out = np.zeros(low.shape[1])
    out[np.argmax(np.ptp(low, axis=0))] = 1
    return out


def principal(low: np.ndarray) -> np.ndarray:
    """The line of the rows' greatest variance, nearly."""
    x = low - low.mean(0)
    line = x[np.argmax((x**2).sum(1))]
    for _ in range(8):
        size = np.sqrt((line**2).sum())
        if not size:
            return line
        line = x.T @ (x @ (line / size))
    return line / (np.sqrt((line**2).sum()) or 1)


def grow(low: np.ndarray, depth: int, axis: Callable[[np.ndarray], np.ndarray] = widest) -> Tree:
    """Halve each node's rows at their median along the line that ``axis`` finds, ``depth`` times."""
    lines, cut = np.zeros((2**depth - 1, low.shape[1])), np.zeros(2**depth - 1)
    held = [np.arange(len(low))]
    for node in range(2**depth - 1):
        rows = held[node]
        on = np.zeros(len(rows), bool)
        if len(rows) and low.shape[1]:
            lines[node] = axis(low[rows])
            along = low[rows] @ lines[node]
            cut[node] = np.median(along)
            on = along > cut[node]
        held += [rows[~on], rows[on]]
    return Tree(lines, cut, depth)


def principal_blocks(low: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the bounds of blocks of ``most`` at most, cut at the mean along the principal line again and again."""
    order, first, todo = [], [0], [np.arange(len(low))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            order.append(rows)
            first.append(first[-1] + len(rows))
            continue
        along = low[rows] @ principal(low[rows]) if low.shape[1] else np.zeros(len(rows))
        on = along > along.mean()
        if not on.any() or on.all():
            on = np.arange(len(rows)) >= len(rows) // 2
        todo += [rows[on], rows[~on]]
    return np.concatenate(order), np.array(first, np.int64)


def edges(n: int, leaf: int = BLOCK) -> list[np.ndarray]:
    """Bounds of the nodes of each level of a kd-tree over n ordered rows: every node is halved until leaves hold ``leaf`` at most."""
    out = [np.array([0, n])]
    while (np.diff(out[-1]) > leaf).any():
        e = out[-1]
        out.append(np.unique(np.concatenate([e, e[:-1] + np.diff(e) // 2])))
    return out


def kd_blocks(low: np.ndarray, leaf: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which the nodes of ``edges`` are those of a kd-tree that halves the widest coordinate, and the leaves' bounds."""
    order = np.arange(len(low))
    for e in edges(len(low), leaf)[:-1]:
        for a, b in zip(e[:-1], e[1:]):
            half = (b - a) // 2
            if half:
                own = low[order[a:b]]
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], half)]
    return order, edges(len(low), leaf)[-1]


def merge_best(hits: list[Hits], ids: np.ndarray, n: int, k: int) -> tuple[Hits, np.ndarray, np.ndarray]:
    """Each of n queries' k best of some (query, row, score) hits, ties to the smaller id; and which queries have k, and their k-th."""
    at, row, s = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((row, ids[row], -s, at))
    at, row, s = at[order], row[order], s[order]
    start = np.searchsorted(at, np.arange(n))
    on = np.arange(len(at)) - start[at] < k
    at, row, s = at[on], row[on], s[on]
    count = np.bincount(at, minlength=n)
    full = np.flatnonzero(count == k)
    return (at, row, s), full, s[np.cumsum(count)[full] - 1]


def none() -> Hits:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


def pruned(bounds: np.ndarray, score: Callable[[np.ndarray, int], np.ndarray], first: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, kth: np.ndarray) -> tuple[Hits, int]:
    """Score blocks in each query's own order until bounds fall below its k-th score: its k best hits, and the pairs scored.

    ``bounds[q, b]`` are upper bounds of the scores in a block, ``score(queries, b)`` scores a
    block's rows, which start at ``first[b]``. ``own`` marks (query, row) pairs to leave out, ``kth``
    holds k-th scores known before. Blocks go in rounds of 1, 2, 4 ... of each query; a bound equal
    to the k-th score is still scored, for ties.
    """
    n, blocks = bounds.shape
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, 1)
    kth, best, scored = kth.astype(float), none(), 0
    done, step = 0, 1
    while done < blocks:
        q, j = np.nonzero(ranked[:, done : done + step] >= kth[:, None])
        if not len(q):
            break
        b = order[q, done + j]
        by = np.argsort(b, kind="stable")
        hits = [best]
        for group in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            some, block = q[group], int(b[group[0]])
            s = score(some, block)
            scored += s.size
            s[own[some, first[block] : first[block + 1]]] = -np.inf
            i, j = np.nonzero((s >= kth[some, None]) & (s > -np.inf))
            hits.append((some[i], first[block] + j, s[i, j]))
        best, full, least = merge_best(hits, ids, n, k)
        kth[full] = np.maximum(kth[full], least)
        done, step = done + step, 2 * step
    return best, scored


class Space:
    """What a search knows of the vectors of one length and class; made by ``Method.space``."""

    axis: Callable[[np.ndarray], np.ndarray] = staticmethod(widest)
    blocks: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = staticmethod(kd_blocks)

    def low(self, vecs: np.ndarray) -> np.ndarray:
        """Coordinates that trees cut."""
        raise NotImplementedError

    def summary(self, vecs: np.ndarray) -> np.ndarray:
        """Values of each row, whose greatest and least describe a shard and a region."""
        raise NotImplementedError

    def promise(self, queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of each (query, region), greater where the region should be visited earlier."""
        raise NotImplementedError

    def useful(self, queries: np.ndarray, kth: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether a region may hold a row that the query needs, whose k-th score is known (-inf: none)."""
        raise NotImplementedError

    def search(self, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, first: np.ndarray, k: int, kth: np.ndarray) -> tuple[Hits, int]:
        """The queries' k best hits (query, row, score) among a shard's rows, in blocks that start at ``first``, and the pairs scored."""
        raise NotImplementedError


@dataclass(frozen=True)
class Method:
    """A search: its class of each vector, its space of vectors of a length and class, and its type of score."""

    space: Callable[[int, int, float], Space]
    classes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    nonzero: bool
    score_type: str


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, vec array<double>) of the rows that take part: a vector of finite components, all present."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    big = F.lit(float("inf"))
    rows = rows.where(F.col("vec").isNotNull() & F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < big) & ~F.isnan(x)))
    return rows.where(F.exists("vec", lambda x: x != 0)) if nonzero else rows


def unpack(vecs: pa.Array | list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs if isinstance(vecs, list) else vecs.to_pylist()), "<f8").reshape(len(vecs), dim)


def _packed(method: Method) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as the bytes of their little-endian doubles, with their length, class and size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            dims, kind, size = np.diff(at).astype(np.int32), np.zeros(len(lists), np.int32), np.zeros(len(lists))
            for dim in np.unique(dims):
                on = np.flatnonzero(dims == dim)
                kind[on], size[on] = method.classes(flat[at[on][:, None] + np.arange(dim)])
            vecs = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), vecs, pa.array(dims), pa.array(kind), pa.array(size)], names=["id", "vec", "dim", "kind", "size"])

    return pack


def _spaces(rows: DataFrame, method: Method, shard: int) -> dict[tuple[int, int], tuple[Space, Tree, int]]:
    """The space, the tree and the first region of the vectors of each length and class, from a bounded sample."""
    groups = rows.groupBy("dim", "kind").agg(F.count("*").alias("n"), F.max("size").alias("top")).collect()  # a row a length and class
    total, volume = sum(r["n"] for r in groups), sum(8 * r["n"] * r["dim"] for r in groups)
    every = max(1, buckets_for(total, SAMPLE), buckets_for(volume, SAMPLE_BYTES))
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("dim", "kind", "vec").collect()
    out, base = {}, 0
    for r in sorted(groups, key=lambda r: (r["dim"], r["kind"])):
        key = r["dim"], r["kind"]
        vecs = unpack([bytes(x["vec"]) for x in some if (x["dim"], x["kind"]) == key], r["dim"])
        space = method.space(*key, r["top"])
        leaves = min(buckets_for(r["n"], shard), MOST_LEAVES, max(1, len(vecs) // 8))
        tree = grow(space.low(vecs), max(0, (leaves - 1).bit_length()), space.axis)
        out[key] = space, tree, base
        base += 2**tree.depth
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Rows of each length and class in a batch."""
    dim, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "kind"))
    for d, c in sorted(set(zip(dim.tolist(), kind.tolist()))):
        yield (d, c), np.flatnonzero((dim == d) & (kind == c))


def routed_search(vectors: DataFrame, method: Method, k: int, is_query: Column, id_col: str, vec_col: str, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Each query's k best by ``method``: (query_id, rank from 1, id, score), higher scores first, ties to the smaller id.

    ``is_query`` reads the column ``id``. A query meets rows of its own length only, none of its own
    id. Repeated ids are rows and queries of their own, and are dealt to shards one by one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, method.nonzero).mapInArrow(_packed(method), "id long, vec binary, dim int, kind int, size double")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    spaces = _spaces(rows, method, shard)
    plan = spark.sparkContext.broadcast(spaces)  # bounded: a few matrices and at most MOST_LEAVES cuts for each length and class

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            for key, on in _pieces(batch):
                space, tree, base = plan.value[key]
                region[on] = base + tree.leaf(space.low(unpack(batch.column("vec").take(pa.array(on)), key[0])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "vec", "dim", "kind")), pa.array(region)], names=["row", "id", "vec", "dim", "kind", "region"])

    placed = materialize(rows.mapInArrow(place, "row long, id long, vec binary, dim int, kind int, region int"), "placed")
    sizes = {r["region"]: r["n"] for r in placed.groupBy("region").agg(F.count("*").alias("n")).collect()}  # at most MOST_LEAVES for each length and class
    subs = {r: buckets_for(n, shard) for r, n in sizes.items()}
    split = spark.createDataFrame(sorted(subs.items()), "region int, subs int")
    dealt = placed.join(F.broadcast(split), "region").withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    dealt = dealt.groupBy("dim", "kind", "region", "sub").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("dim")[i].as_py(), batch.column("kind")[i].as_py()
                space = plan.value[key][0]
                own = batch.column("rows")[i].values
                ids, vecs = own.field("id").to_numpy(zero_copy_only=False), unpack(own.field("vec"), key[0])
                order, first = space.blocks(space.low(vecs))
                seen = space.summary(vecs)
                held = [ids[order].astype("<i8"), vecs[order], first.astype("<i8"), seen.max(0), seen.min(0)]
                columns = [batch.column(c).slice(i, 1) for c in ("dim", "kind", "region", "sub")] + [pa.array([np.ascontiguousarray(x, x.dtype).tobytes()], pa.binary()) for x in held]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "kind", "region", "sub", "ids", "vecs", "first", "high", "least"])

    shards = materialize(dealt.mapInArrow(build, "dim int, kind int, region int, sub int, ids binary, vecs binary, first binary, high binary, least binary"), "shards")

    def extremes(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        high, least = (np.stack([np.frombuffer(x) for x in b[c]]) for c in ("high", "least"))
        return pd.DataFrame({"dim": b["dim"].iloc[:1], "kind": b["kind"].iloc[:1], "region": [key[0]], "high": [high.max(0).tobytes()], "least": [least.min(0).tobytes()]})

    seen = shards.select("dim", "kind", "region", "high", "least").groupBy("region").applyInPandas(extremes, "dim int, kind int, region int, high binary, least binary").collect()
    maps: dict[int, list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]] = {}
    for key in sorted(spaces):
        own = sorted((r["region"], bytes(r["high"]), bytes(r["least"])) for r in seen if (r["dim"], r["kind"]) == key)
        if own:
            maps.setdefault(key[0], []).append((key, np.array([r for r, _, _ in own], np.int32), *(np.stack([np.frombuffer(x[j]) for x in own]) for j in (1, 2))))
    routes = spark.sparkContext.broadcast((maps, subs))  # bounded as the plan is

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                on = np.flatnonzero(dims == dim)
                for a in range(0, len(on), _STEP):
                    some = batch.take(pa.array(on[a : a + _STEP]))
                    yield int(dim), some, unpack(some.column("vec"), int(dim))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shard of each query: one of its most promising region."""
        maps, subs = routes.value
        for dim, some, q in steps(batches):
            regions = np.concatenate([r for _, r, _, _ in maps[dim]])
            best = regions[np.hstack([plan.value[key][0].promise(q, high, low) for key, _, high, low in maps[dim]]).argmax(1)]
            sub = some.column("row").to_numpy() % np.array([subs[r] for r in best.tolist()])
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("row", "id", "vec", "dim")), pa.array(best), pa.array(sub.astype(np.int32))], names=["row", "id", "vec", "dim", "region", "sub"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other shards of the regions that a query may need."""
        maps, subs = routes.value
        for dim, some, q in steps(batches):
            kth = some.column("kth").to_numpy(zero_copy_only=False)
            for key, regions, high, low in maps[dim]:
                at, j = np.nonzero(plan.value[key][0].useful(q, kth, high, low))
                region = regions[j]
                times = np.array([subs[r] for r in region.tolist()], np.int64)
                at, region = np.repeat(at, times), np.repeat(region, times)
                sub = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                been = (region == some.column("region").to_numpy()[at]) & (sub == some.column("sub").to_numpy()[at])
                at, region, sub = at[~been], region[~been], sub[~been]
                for a in range(0, len(at), _STEP):
                    part = some.take(pa.array(at[a : a + _STEP]))
                    columns = [*(part.column(c) for c in ("row", "id", "vec", "dim")), pa.array(region[a : a + _STEP]), pa.array(sub[a : a + _STEP]), part.column("kth")]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "vec", "dim", "region", "sub", "kth"])

    kind = pa.int64() if method.score_type == "long" else pa.float64()
    names = ["query", "query_id", "id", "score"]

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        """One cell: a part of the queries with one shard."""
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), kind)], names=names)
        if not asked.num_rows or not held.num_rows:
            return empty
        key = held.column("dim")[0].as_py(), held.column("kind")[0].as_py()
        ids = np.frombuffer(held.column("ids")[0].as_py(), "<i8")
        vecs = np.frombuffer(held.column("vecs")[0].as_py(), "<f8").reshape(len(ids), key[0])
        first = np.frombuffer(held.column("first")[0].as_py(), "<i8")
        space, out = plan.value[key][0], []
        for a in range(0, asked.num_rows, CHUNK):  # parts are dealt by hash, so one may be larger
            some = asked.slice(a, CHUNK)
            query, q_ids, kth = (some.column(c).to_numpy() for c in ("row", "id", "kth"))
            (at, row, s), _ = space.search(q_ids, unpack(some.column("vec").to_pylist(), key[0]), ids, vecs, first, k, kth)
            out.append(pa.table([pa.array(query[at]), pa.array(q_ids[at]), pa.array(ids[row]), pa.array(s, kind)], names=names))
        return pa.concat_tables(out)

    asked = placed.where(is_query).select("row", "id", "vec", "dim")
    entered = materialize(asked.mapInArrow(enter, "row long, id long, vec binary, dim int, region int, sub int"), "entered")
    parts = buckets_for(entered.agg(F.count("*")).first()[0], chunk)
    cells = sum(subs.values()) * parts
    at = ["region", "sub", "part"]

    def visit(some: DataFrame, n: int) -> DataFrame:
        some = materialize(some.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "visits")
        wanted = some.select(*[F.col(c).alias(f"w_{c}") for c in at]).distinct()
        held = shards.select("dim", "kind", "region", "sub", "ids", "vecs", "first").join(wanted, (F.col("region") == F.col("w_region")) & (F.col("sub") == F.col("w_sub")))
        held = held.select("dim", "kind", "region", "sub", F.col("w_part").alias("part"), "ids", "vecs", "first")
        n = max(1, min(n, MOST_TASKS))
        both = some.select("row", "id", "vec", "kth", *at).repartition(n, *at).groupBy(*at).cogroup(held.repartition(n, *at).groupBy(*at))
        return both.applyInArrow(meet, f"query long, query_id long, id long, score {method.score_type}")

    first = materialize(visit(entered.withColumn("kth", F.lit(float("-inf"))), cells), "first")
    known = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k).drop("n")
    rest = entered.join(known, F.col("row") == F.col("query"), "left").drop("query").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    second = visit(rest.mapInArrow(follow, "row long, id long, vec binary, dim int, region int, sub int, kth double"), cells)
    found = first.unionByName(second)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def shares(vecs: np.ndarray, method: Method, k: int, every: int, shard: int = SHARD) -> dict[str, Any]:
    """Share of (query, row) pairs that a search of some rows scores, and the ids found, without Spark; ids are row numbers."""
    kinds, size = method.classes(vecs)
    out: list[list[tuple[float, int]]] = [[] for _ in range(0, len(vecs), every)]
    asked, q_ids = vecs[::every], np.arange(0, len(vecs), every)
    regions, scored = [], 0
    for c in np.unique(kinds):
        on = np.flatnonzero(kinds == c)
        space = method.space(vecs.shape[1], int(c), float(size[on].max()))
        leaf = grow(space.low(vecs[on]), max(0, (buckets_for(len(on), shard) - 1).bit_length()), space.axis).leaf(space.low(vecs[on]))
        for r in np.unique(leaf):
            own = on[leaf == r]
            seen = space.summary(vecs[own])
            order, first = space.blocks(space.low(vecs[own]))
            regions.append((space, own[order], first, seen.max(0)[None], seen.min(0)[None]))
    best = np.hstack([s.promise(asked, h, w) for s, _, _, h, w in regions]).argmax(1)
    kth = np.full(len(asked), -np.inf)
    for later in (False, True):
        for i, (space, own, first, high, low) in enumerate(regions):
            here = (best != i) & space.useful(asked, kth, high, low)[:, 0] if later else best == i
            if (at := np.flatnonzero(here)).size:
                (q, row, s), n = space.search(q_ids[at], asked[at], own, vecs[own], first, k, kth[at])
                scored += n
                for a, b, x in zip(at[q].tolist(), own[row].tolist(), s.tolist()):
                    out[a].append((-x, b))
        kth = np.array([-sorted(x)[k - 1][0] if len(x) >= k else -np.inf for x in out])
    return {"scored": scored / max(1, len(asked) * len(vecs)), "found": [[b for _, b in sorted(x)[:k]] for x in out]}
