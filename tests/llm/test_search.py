import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import ann, exact_topk, linear_blocks


def _frame(spark, vectors, ids=None, kind="array<float>"):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, score int, rank string")


def _clusters(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((20, dim))[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, dim))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)


def _brute(v, ids, k, score, every=20):
    out = set()
    for i, q in zip(ids, v):
        if i % every == 0:
            best = sorted((-score(q, x), j) for j, x in zip(ids, v) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def _rows(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def _int(q, x):
    return sum(math.floor(64 * float(a)) * math.floor(64 * float(b)) for a, b in zip(q, x))


@pytest.mark.parametrize("shard", [64, 4096])
def test_topk_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(linear_blocks.routed_search, "__defaults__", (shard, 3))
    v = _clusters(150)
    assert _rows(exact_topk.top_k(_frame(spark, v))) == _brute(v, range(150), 20, _int)


def test_topk_ties_copies_and_few_rows(spark):
    v = [[0.5, -0.5]] * 30 + [[0.1, 0.2]]
    got = _rows(exact_topk.top_k(_frame(spark, v)))
    assert {(0, r + 1, r + 1, 2048) for r in range(20)} <= got and got == _brute(v, range(31), 20, _int)
    few = _frame(spark, [[1.0], [2.0], [-3.0]])
    assert _rows(exact_topk.top_k(few)) == {(0, 1, 1, 64 * 128), (0, 2, 2, -64 * 192)}


def test_topk_leaves_out_unusable_rows(spark):
    v = [[1.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.5, 0.5], [0.0, 0.0]]
    assert _rows(exact_topk.top_k(_frame(spark, v))) == {(0, 1, 5, 2048), (0, 2, 6, 0)}
    assert exact_topk.top_k(_frame(spark, [])).count() == 0
    mixed = _frame(spark, [[1.0], [1.0, 2.0], [2.0]])
    assert _rows(exact_topk.top_k(mixed)) == {(0, 1, 2, 64 * 128)}


def test_topk_of_huge_components_is_exact_and_clamped(spark):
    v = [[1e9, 1.0], [1e9, -1.0], [1e300, 0.0]]
    got = _rows(exact_topk.top_k(_frame(spark, v, kind="array<double>")))
    assert got == {(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)}
    w = [[3e7, 1.0], [3e7, 2.0]]
    assert _rows(exact_topk.top_k(_frame(spark, w, kind="array<double>"))) == _brute(w, [0, 1], 20, _int)


def test_topk_repeated_and_empty_rows(spark):
    v, ids = [[1.0], [1.0], [2.0], []], [0, 0, 7, 20]
    got = exact_topk.top_k(_frame(spark, v, ids)).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, 7), (0, 7)]
    two = exact_topk.top_k(_frame(spark, [[], []], [0, 1]), is_query=F.col("id") == 1).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in two] == [(1, 0, 0)]


def test_nearest_recall_and_scores(spark):
    v = _clusters(1500, 24, 3)
    got, want = _rows(ann.nearest(_frame(spark, v))), _brute(v, range(1500), 20, lambda q, x: float((q.astype(float) * x.astype(float)).sum()))
    hits = {(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}
    assert len(hits) >= 0.9 * len(want)
    for i, _, j, s in got:
        assert s == pytest.approx(float(v[i].astype(float) @ v[j].astype(float)), abs=1e-12)


def test_nearest_recall_on_uniform_vectors_of_uneven_norms(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((1200, 48)) * rng.uniform(0.2, 3, (1200, 1))).astype(np.float32)
    got, want = _rows(ann.nearest(_frame(spark, v))), _brute(v, range(1200), 20, lambda q, x: float((q.astype(float) * x.astype(float)).sum()))
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)


def test_nearest_ties_edges_and_empty(spark):
    v = [[0.6, 0.8]] * 40 + [None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None]]
    got = _rows(ann.nearest(_frame(spark, v)))
    assert {(r, j) for q, r, j, _ in got if q == 0} == {(r, r) for r in range(1, 21)}
    assert {(r, j) for q, r, j, _ in got if q == 20} == {(r + 1, r) for r in range(20)} and len({s for *_, s in got}) == 1
    assert ann.nearest(_frame(spark, [])).count() == 0
    assert _rows(ann.nearest(_frame(spark, [[1e200, 0.0], [1e200, 0.0], [1e-200, 1.0]], kind="array<double>")))


def test_topk_of_overflowing_components(spark):
    v = [[1e307, 1.0], [1e307, 0.0], [-1e307, 2.0], [0.5, 0.5], [1.7e308, -1.7e308]]
    got = exact_topk.top_k(_frame(spark, v, kind="array<double>"), is_query=F.col("id") >= 0)
    whole = [[math.floor(64 * Fraction(x)) for x in r] for r in v]
    want = set()
    for i in range(5):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], r)))), j) for j, r in enumerate(whole) if j != i)
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert _rows(got) == want


def test_topk_one_vector_on_all_rows_is_dealt_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linear_blocks.routed_search, "__defaults__", (32, 16))
    sizes = []
    kept = linear_blocks.materialize
    monkeypatch.setattr(linear_blocks, "materialize", lambda df, tag: (sizes.append(kept(df, tag)), sizes[-1])[1] if tag == "shards" else kept(df, tag))
    got = exact_topk.top_k(_frame(spark, [[0.5, 0.25]] * 600, [7] * 300 + list(range(300)))).collect()
    assert {r["score"] for r in got} == {32 * 32 + 16 * 16} and len(got) == 20 * 15
    assert max(len(r["ids"]) // 8 for r in sizes[0].collect()) < 70


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [float(i % 7), 1.0], "a", 1, 2, [3.0]) for i in range(60)]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int, region int, vec array<double>")
    plain = odd.select("vec_id", "embedding")
    for search in (exact_topk.top_k, ann.nearest):
        assert _rows(search(odd)) == _rows(search(plain))


def test_nearest_repeated_ids(spark):
    v, ids = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], [0, 0, 3, 3]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(_frame(spark, v, ids)).collect())
    assert got == [(0, 1, 3, 0.5)] * 2 + [(0, 2, 3, 0.0)] * 2


def test_nearest_of_the_widest_range_of_sizes(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 12)) * 10.0 ** rng.integers(-150, 151, 300)[:, None]
    got = _rows(ann.nearest(_frame(spark, v.tolist(), kind="array<double>")))
    want = _brute(v, range(300), 20, lambda q, x: float((q * x).sum()))
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    assert all(math.isfinite(s) for *_, s in got)


def test_nearest_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = np.array([r[0] for r in table.orderBy("vec_id").select("embedding").collect()], float)
    got = {(a, c) for a, _, c, _ in _rows(ann.nearest(table))}
    want = {(a, c) for a, _, c, _ in _brute(v, range(len(v)), 20, lambda q, x: float((q * x).sum()))}
    assert len(got & want) >= 0.9 * len(want)


def test_searches_prune_clustered_vectors():
    v = _clusters(4096, 64, 1).astype(float)
    assert linear_blocks.shares(v, exact_topk.METHOD, 20, 20)["scored"] < 0.3
    assert linear_blocks.shares(v, ann.METHOD, 20, 20)["scored"] < 0.3


def test_trees_and_chi_square():
    points = np.random.default_rng(0).standard_normal((500, 6))
    for blocks in (linear_blocks.kd_blocks, linear_blocks.principal_blocks):
        for rows in (points, np.ones((200, 4)), np.zeros((130, 0)), points[:1]):
            if rows.shape[1] or blocks is linear_blocks.principal_blocks:
                order, first = blocks(rows)
                assert sorted(order.tolist()) == list(range(len(rows))) and first[-1] == len(rows) and np.diff(first).max() <= linear_blocks.BLOCK
    tree = linear_blocks.grow(points, 3)
    assert np.bincount(tree.leaf(points), minlength=8).min() >= 60
    assert float(ann.chi_square(np.array(15.507313), 8)) == pytest.approx(0.95, abs=1e-6) and ann.quantile(0.95, 8) == pytest.approx(15.507313, abs=1e-5)
    sample = (np.random.default_rng(1).standard_normal((20000, 8)) ** 2).sum(1)
    assert abs((sample < 10).mean() - float(ann.chi_square(np.array(10.0), 8))) < 0.02
