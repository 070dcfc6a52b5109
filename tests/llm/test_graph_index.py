"""Graph search against brute force: recall, ties, copies, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlake.llm import graph_index


def slow_nearest(rows, queries, k):
    """rows: (id, vector) pairs that take part, one per id."""
    out = {}
    for q in queries:
        scored = [(-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(rows[q], v)), i)
                  for i, v in rows.items() if i != q and len(v) == len(rows[q])]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_robust_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.2], [-3, 0]], np.float32)
    graph = graph_index.Graph(points)
    kept = graph.pruned(np.array([0]), np.arange(6)[None, :])[0]
    assert kept[kept >= 0].tolist() == [1, 3, 5]


def test_directions_and_lengths_of_any_size(spark):
    vectors = np.random.default_rng(0).normal(size=(50, 8)) * 10.0 ** np.linspace(-30, 30, 50)[:, None]
    assert np.allclose((graph_index.directions(vectors) ** 2).sum(axis=1), 1, atol=1e-5)
    table = spark.createDataFrame([(v.tolist(),) for v in vectors * 1e200], "v array<double>")
    found = [r[0] for r in table.select(graph_index.length(F.col("v"))).collect()]
    assert found == pytest.approx([float(n) * 1e200 for n in np.linalg.norm(vectors, axis=1)])


def test_graph_search_finds_the_nearest_points():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 24)).astype(np.float32)
    graph = graph_index.Graph(points).build()
    assert ((graph.edges >= 0).sum(axis=1) > 0).all()
    queries = rng.normal(size=(100, 24)).astype(np.float32)
    found, _, _ = graph.search(queries, 64)
    hits = 0
    for q, ids in zip(queries, found):
        want = np.argsort(((points - q) ** 2).sum(axis=1))[:10]
        hits += len(set(want.tolist()) & set(ids[:10].tolist()))
    assert hits / 1000 > 0.9


@pytest.mark.parametrize("spread", [0, 2])
def test_recall_over_several_shards(spark, spread):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16)) * np.exp(rng.normal(size=(1500, 1)) * spread / 2)
    rows = {i: [float(np.float32(x)) for x in v] for i, v in enumerate(vectors)}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    found = graph_index.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_points=400, block_queries=30).collect()
    want = slow_nearest(rows, range(0, 1500, 20), 20)
    scores = {(q, i): s for q, rows_ in want.items() for i, s in rows_}
    hits = [r for r in found if (r.query_id, r.vec_id) in scores]
    assert all(r.score == pytest.approx(scores[r.query_id, r.vec_id], rel=1e-12) for r in hits)
    assert len(found) == 20 * len(want) and len(hits) / len(found) > 0.9


def test_copies_ties_and_odd_rows(spark):
    nan = float("nan")
    good = {i: [1.0, 0.0] for i in range(200, 300)} | {0: [1.0, 0.5], 20: [0.0, 1.0], 21: [2.0, 0.0], 22: [0.0, -1.0],
                                                       40: [1.0, 2.0, 3.0], 41: [0.0, 1.0, 0.0]}
    bad = [(60, None), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (140, [float("inf"), 1.0]), (160, []), (None, [1.0, 1.0])]
    rows = list(good.items()) + bad + [(21, [2.0, 0.0]), (22, [3.0, 0.0])]  # the smallest vector of an id counts
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, shard int, score int")
    found = graph_index.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_points=50).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    queries = [i for i in good if i % 20 == 0]
    assert got == {q: rows for q, rows in slow_nearest(good, queries, 20).items() if rows}
    assert [v for v, _ in got[200]][:4] == [21, 0, 201, 202]
    assert graph_index.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert graph_index.nearest(table, F.col("vec_id") < 0).count() == 0


def of_unit_length(vectors):
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


SETS = {
    "unit 64": lambda rng: of_unit_length(rng.normal(size=(8192, 64))),
    "normal 64": lambda rng: rng.normal(size=(8192, 64)),
    "normal 128": lambda rng: rng.normal(size=(8192, 128)),
    "log-normal 0.5": lambda rng: of_unit_length(rng.normal(size=(8192, 64))) * rng.lognormal(0, 0.5, (8192, 1)),
    "log-normal 1": lambda rng: of_unit_length(rng.normal(size=(8192, 64))) * rng.lognormal(0, 1, (8192, 1)),
    "one of a million": lambda rng: rng.normal(size=(8192, 64)) * np.where(np.arange(8192) == 17, 1e6, 1)[:, None],
}


@pytest.mark.parametrize("name", SETS)
def test_recall_on_full_shards(spark, name):
    vectors = SETS[name](np.random.default_rng(12)).astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = graph_index.nearest(table, F.col("vec_id") % 40 == 0, k=20).collect()
    products = vectors[::40] @ vectors.T
    products[np.arange(len(products)), np.arange(0, 8192, 40)] = -np.inf
    want = np.argsort(-products, axis=1)[:, :20]
    hits = sum(r.vec_id in set(want[r.query_id // 40].tolist()) for r in found)
    print(name, hits / want.size)
    assert len(found) == want.size and hits / want.size >= 0.95
