"""Nearest neighbours by inner product with robust-pruned directed graphs, one per shard of the vectors.

A shard's graph is built by inserting its points in batches: a greedy search from the entry point
proposes neighbours (all points that it expands), and relaxed distance pruning keeps a few of them that
lie in different directions: a candidate goes when a kept neighbour is ``alpha`` times closer to it than
the point itself. Edges are made in both directions; a list that overflows is pruned the same way.
Queries run a beam search in the shards of their dimension, and the best of all shards are merged.

Among vectors of one length the largest inner product is the smallest distance. So shards hold vectors of
nearly one length, a layer: lengths of a layer differ by LAYER_RATIO at most. The graph is built on their
directions, and what a beam holds at its end is compared by exact products. The layers of the longest
vectors are searched first; of the others only those are searched for a query whose longest vector could
reach the k-th product found.

Equal vectors are one point of the index with its smallest ids, so groups of copies of any size cost one
point. Vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, nor do rows
without an id. Rows that repeat an id count once, with the smallest of its vectors. Vectors meet only
vectors of their own dimension. An empty table gives an empty result; extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.operators.staging import staged

DEGREE = 28
#: A list may grow to this length before it is pruned to DEGREE.
WIDEST = 40
BUILD_BEAM = 72
SEARCH_BEAM = 128
ALPHA = 1.2
#: Points inserted together see the same graph; the batch grows with the graph up to this.
BATCH = 256
EXPANDED_AT_ONCE = 4
#: Lengths of the vectors of a shard differ by this factor at most.
LAYER_RATIO = 1.05
#: Distinct vectors per shard, and queries per block, on average: both bound what one task holds.
SHARD_POINTS = 8192
BLOCK_QUERIES = 8192
PRUNE_CELLS = 1 << 23


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; components of any size are brought to one scale first."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


class Graph:
    """Points with directed edges: ``edges`` has one row per point, filled up with -1."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None):
        self.points = points
        self.squares = np.einsum("ij,ij->i", points, points)
        self.edges = np.full((len(points), WIDEST), -1, np.int32) if edges is None else edges
        self.entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to the points in its row of ids."""
        inner = np.matmul(self.points[ids], queries[:, :, None])[:, :, 0]
        return self.squares[ids] - 2 * inner + np.einsum("ij,ij->i", queries, queries)[:, None]

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nearest points found per query (ids and distances, nearest first, -1 where none), and all expanded ones."""
        n, rows = len(queries), np.arange(len(queries))[:, None]
        ids = np.full((n, beam), -1, np.int64)
        near = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.points)), bool)
        ids[:, 0] = self.entry
        near[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        done[:, 0] = False
        seen[:, self.entry] = True
        expanded = []
        while not done.all():
            # The lists are sorted, so the first open entries are the nearest.
            turn = np.cumsum(~done, axis=1)
            chosen = ~done & (turn <= EXPANDED_AT_ONCE)
            done |= chosen
            at, slot = np.nonzero(chosen)
            now = np.full((n, EXPANDED_AT_ONCE), -1, np.int64)
            now[at, turn[at, slot] - 1] = ids[at, slot]
            expanded.append(now)
            found = np.where(now[:, :, None] >= 0, self.edges[now], -1).reshape(n, -1)
            live = np.unique((rows * len(self.points) + found)[found >= 0])
            live = live[~seen.ravel()[live]]
            seen.ravel()[live] = True
            owner = live // len(self.points)
            counts = np.bincount(owner, minlength=n)
            width = int(counts.max()) if len(live) else 0
            if not width:
                continue
            fresh = np.full((n, width), -1, np.int64)
            fresh[owner, np.arange(len(live)) - np.repeat(np.cumsum(counts) - counts, counts)] = live % len(self.points)
            away = np.where(fresh >= 0, self._distances(queries, fresh), np.inf).astype(np.float32)
            all_near = np.concatenate((near, away), axis=1)
            order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            near = np.take_along_axis(all_near, order, axis=1)
            ids = np.take_along_axis(np.concatenate((ids, fresh), axis=1), order, axis=1)
            done = np.take_along_axis(np.concatenate((done, fresh < 0), axis=1), order, axis=1)
        return ids, near, expanded

    def pruned(self, centres: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """[centre, DEGREE]: neighbours that relaxed distance pruning keeps of each row of candidates (-1: none)."""
        out = np.full((len(centres), DEGREE), -1, np.int32)
        step = max(1, PRUNE_CELLS // max(1, candidates.shape[1] ** 2))
        for at in range(0, len(centres), step):
            out[at:at + step] = self._pruned(centres[at:at + step], candidates[at:at + step])
        return out

    def _pruned(self, centres: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        rows = np.arange(len(centres))
        usable = (candidates >= 0) & (candidates != centres[:, None])
        near = np.where(usable, self._distances(self.points[centres], candidates), np.inf)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        sorted_ids = np.take_along_axis(candidates, order, axis=1)
        spots = self.points[sorted_ids]
        between = self.squares[sorted_ids][:, :, None] + self.squares[sorted_ids][:, None, :] - 2 * np.matmul(
            spots, spots.transpose(0, 2, 1))
        open_ = np.isfinite(near)
        out = np.full((len(centres), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            first = open_.argmax(axis=1)
            live = open_[rows, first]
            if not live.any():
                break
            out[live, k] = sorted_ids[rows, first][live]
            open_[rows, first] = False
            covered = ALPHA ** 2 * np.maximum(between[rows, first], 0) <= near
            open_ &= ~(covered & live[:, None])
        return out

    def _link_back(self, sources: np.ndarray, kept: np.ndarray) -> None:
        """Adds the reverse of the new edges; lists that would overflow are pruned."""
        owner, target = np.nonzero(kept >= 0)
        to, by = kept[owner, target].astype(np.int64), sources[owner]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        have = (self.edges[nodes] >= 0).sum(axis=1)
        new = np.full((len(nodes), int(counts.max())), -1, np.int64)
        new[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(first, counts)] = by
        fits = have + counts <= WIDEST
        rows = np.flatnonzero(fits)
        spread = np.repeat(rows, counts[rows])
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
        self.edges[nodes[spread], have[spread] + inner] = new[spread, inner]
        full = np.flatnonzero(~fits)
        if len(full):
            lists = np.concatenate((self.edges[nodes[full]].astype(np.int64), new[full]), axis=1)
            self.edges[nodes[full]] = -1
            self.edges[nodes[full], :DEGREE] = self.pruned(nodes[full], lists)

    def build(self) -> Graph:
        n = len(self.points)
        order = np.random.default_rng(5).permutation(n)
        order = np.concatenate(([self.entry], order[order != self.entry]))
        done = 1
        while done < n:
            batch = order[done:done + max(1, min(BATCH, done))]
            _, _, expanded = self.search(self.points[batch], BUILD_BEAM)
            kept = self.pruned(batch, np.concatenate(expanded, axis=1))
            self.edges[batch, :DEGREE] = kept
            self._link_back(batch, kept)
            done += len(batch)
        return self


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added up from the first component to the last."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d].astype(np.float64) * vectors[:, d].astype(np.float64)
    return total


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


KEYS = ["dimension", "layer", "shard"]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class_id").reset_index(drop=True)
    edges = Graph(directions(_stacked(rows["vector"]))).build().edges
    rows["node"] = np.arange(len(rows), dtype=np.int32)
    rows["edges"] = [row[row >= 0] for row in edges]
    return rows[[*KEYS, "node", "class_id", "vector", "edges"]]


def best_of_beams(near: np.ndarray, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                  found: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the points in each query's beam those with the largest exact products: query row, class id and product."""
    row, slot = np.nonzero(near >= 0)
    point = near[row, slot]
    score = exact_scores(asked[row], vectors[point])
    order = np.lexsort((ids[point], -score, row))
    row, point, score = row[order], point[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < found
    return row[kept], ids[point[kept]], score[kept]


def _search_shard(found: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "class_id": [], "score": []}
        if len(index) and len(queries):
            index = index.sort_values("node")
            vectors, ids = _stacked(index["vector"]), index["class_id"].to_numpy()
            edges = np.full((len(index), WIDEST), -1, np.int32)
            for i, row in enumerate(index["edges"]):
                edges[i, :len(row)] = row
            graph = Graph(directions(vectors), edges)
            asked = _stacked(queries["vector"])
            # The length of a query does not change which products are largest.
            flat, names = directions(asked), queries["query_id"].to_numpy()
            for at in range(0, len(flat), BATCH):
                near, _, _ = graph.search(flat[at:at + BATCH], max(SEARCH_BEAM, found))
                row, classes, score = best_of_beams(near, asked[at:at + BATCH], vectors, ids, found)
                out["query_id"].append(names[at + row])
                out["class_id"].append(classes)
                out["score"].append(score)
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})

    return run


def length(vector: Column) -> Column:
    """The length in double precision, without overflow on the way."""
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    # The largest component is bound to a name by a list of one, or it would be looked for again for each component.
    return F.element_at(F.transform(F.array(F.array_max(sizes)), lambda most: most * F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + (x.cast("double") / most) * (x.cast("double") / most)))), 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            shard_points: int = SHARD_POINTS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for every row for which ``is_query`` holds.

    ``is_query`` is a condition on vec_id. Candidates are all rows but the query's own; ties go to the smaller id.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = staged(rows, "vectors")
    # No result needs more than k + 1 members of a class of equal vectors: those with the smallest ids.
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    classes = staged(rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).groupBy("vector").agg(
        F.min("vec_id").alias("class_id"), F.collect_list("vec_id").alias("members"))
        .withColumn("dimension", F.size("vector")).withColumn("length", length(F.col("vector"))), "vector-classes")
    layer = F.floor(F.log("length") / np.log(LAYER_RATIO) + 0.5).cast("int")
    classes = classes.withColumn("layer", layer)
    # One row per layer; layers of the longest vectors, a shard's worth or more, are searched first.
    longer = Window.partitionBy("dimension").orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, -1)
    spans = staged(classes.groupBy("dimension", "layer").agg(
        F.count("*").alias("points"), F.max("length").alias("longest")).withColumn(
        "first", F.coalesce(F.sum("points").over(longer), F.lit(0)) < shard_points).withColumn(
        "shards", F.ceil(F.col("points") / shard_points).cast("int")), "vector-layers")
    sharded = classes.join(spans, ["dimension", "layer"]).withColumn("shard", F.expr("CAST(pmod(xxhash64(vector), shards) AS INT)"))
    element = dict(table.dtypes)[vector]
    index = staged(sharded.select(*KEYS, "class_id", "vector").groupBy(*KEYS).applyInPandas(
        _build_shard, f"dimension int, layer int, shard int, node int, class_id long, vector {element}, edges array<int>"),
        "vector-graphs")
    queries = rows.where(is_query).withColumn("dimension", F.size("vector"))
    blocks = queries.groupBy("dimension").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    queries = staged(queries.join(blocks, "dimension").select(
        F.col("vec_id").alias("query_id"), "vector", "dimension", length(F.col("vector")).alias("size"), "blocks",
        F.expr("CAST(pmod(xxhash64(vec_id), blocks) AS INT)").alias("block")), "vector-queries")

    def searched(pairs: DataFrame, layers: DataFrame) -> DataFrame:
        """The best of all shards of the layers that each query is paired with."""
        asked = pairs.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
        held = index.join(layers.join(blocks, "dimension").select("dimension", "layer", "blocks"), ["dimension", "layer"]).withColumn(
            "block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        keys = [*KEYS, "block"]
        return held.groupBy(*keys).cogroup(asked.select("query_id", "vector", *keys).groupBy(*keys)).applyInPandas(
            _search_shard(k + 1), "query_id long, class_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    found = searched(queries.join(spans.where("first"), "dimension"), spans.where("first"))
    rest = spans.where(~F.col("first"))
    if not rest.isEmpty():
        found = staged(found, "nearest-in-long-layers")
        reached = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k + 1).select(
            "query_id", F.col("score").alias("reached"))
        # A product is at most the product of the lengths; the margin covers rounding.
        open_ = F.col("reached").isNull() | (F.col("size") * F.col("longest") * (1 + 1e-9) >= F.col("reached"))
        found = found.unionByName(searched(queries.join(reached, "query_id", "left").join(rest, "dimension").where(open_), rest))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    members = found.join(classes.select("class_id", "members"), "class_id").withColumn(
        "vec_id", F.explode("members")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
