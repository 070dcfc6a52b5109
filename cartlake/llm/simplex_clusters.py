"""Centroid clustering on integers, with centroids filtered by n-simplex projection.

A few pivots span a simplex. The distances of a vector to the pivots, measured once, give its apex: the
coordinates in the span of the pivots and the height above it. The Euclidean distance of two apexes is
at most the distance of the vectors, and with the second height mirrored it is at least that. So only
centroids whose lower bound does not exceed the least upper bound are compared in exact integers.

Vectors count if they have exactly ``dimensions`` components, all of them present, finite and of at most
2^19 in size (beyond that squared distances leave 64 bits). Rows without an id are clustered too, but are
the last choice for a first centroid. Rows that repeat are vectors of their own. With fewer vectors than
clusters there are as many clusters as vectors; an empty table gives an empty result. Sums of distances
beyond a long are given as the largest long. Extra columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.llm.shipping import shipped
from cartlake.operators.staging import staged

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
#: A component x becomes the integer floor(SCALE * x).
SCALE = 256
LARGEST = float(1 << 19)
PIVOTS = 24
#: A pivot must stand this high above the others, as a share of its distance, squared: flat simplices blur the bounds.
LEAST_HEIGHT = 0.01
#: Rounding allowed for in the bounds, as a share of the squared sizes.
SLACK = 1e-6
#: Vectors compared at once, and pairs compared in integers at once.
ROWS_AT_ONCE = 4096
PAIRS_AT_ONCE = 1 << 15
MOST = (1 << 63) - 1


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """Pivots and the simplex that they span; ``base`` is lower triangular, one row per pivot but the first."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        self.pivots, self.base = candidates[:1], np.zeros((0, 0))
        for row in candidates[1:]:
            if len(self.pivots) == most:
                break
            apex = self.apexes(row[None, :])[0]
            size = float((apex ** 2).sum())
            if apex[-1] ** 2 > LEAST_HEIGHT * size:
                n = len(self.base)
                grown = np.zeros((n + 1, n + 1))
                grown[:n, :n], grown[n] = self.base, apex
                self.pivots, self.base = np.vstack([self.pivots, row]), grown

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates in the span of the pivots, and last the height above it."""
        away = squared_distances(vectors, self.pivots).astype(np.float64)
        flat = np.zeros((len(vectors), len(self.base)))
        lengths = (self.base ** 2).sum(axis=1)
        for i, row in enumerate(self.base):
            inner = (away[:, 0] + lengths[i] - away[:, i + 1]) / 2
            flat[:, i] = (inner - flat[:, :i] @ row[:i]) / row[i]
        height = np.sqrt(np.maximum(away[:, 0] - (flat ** 2).sum(axis=1), 0))
        return np.column_stack([flat, height])


def possible(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[vector, centroid]: whether the bounds allow it to be the nearest one."""
    flat, height = apexes[:, :-1], apexes[:, -1:]
    c_flat, c_height = centroids[:, :-1], centroids[:, -1]
    sizes = (apexes ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1)
    planar = (flat ** 2).sum(axis=1)[:, None] + (c_flat ** 2).sum(axis=1) - 2 * flat @ c_flat.T
    lower = planar + (height - c_height) ** 2 - SLACK * sizes
    upper = planar + (height + c_height) ** 2 + SLACK * sizes
    return lower <= upper.min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray,
            centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equally near ones the smallest number."""
    clusters, distances = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), ROWS_AT_ONCE):
        here = slice(at, at + ROWS_AT_ONCE)
        row, number = np.nonzero(possible(apexes[here], centroid_apexes))
        exact = np.concatenate([
            ((vectors[here][row[i:i + PAIRS_AT_ONCE]] - centroids[number[i:i + PAIRS_AT_ONCE]]) ** 2).sum(axis=1)
            for i in range(0, len(row), PAIRS_AT_ONCE)])
        # Pairs stand in the order of rows and numbers, and every row has one.
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(exact, first)
        best = np.flatnonzero(exact == least[row])
        best = best[np.append(True, row[best][1:] != row[best][:-1])]
        clusters[here], distances[here] = number[best], least
    return clusters, distances


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of equally long lists as one row per list."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _lists(values: np.ndarray) -> pa.ListArray:
    bounds = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))


def integers(table: DataFrame, dimensions: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id and the integer components (``cells``) of the vectors that count."""
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"),
                        F.col(vector).cast("array<double>").alias("vector")).where(
        F.coalesce((F.size("vector") == dimensions) & fits, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(SCALE * _rows(batch["vector"], np.float64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], _lists(cells)], ["vec_id", "cells"])

    return rows.mapInArrow(run, "vec_id long, cells array<int>")


def first_centroids(cells: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``2:<vec_id>``; the driver gets only these."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = cells.orderBy(F.asc_nulls_last(digest), "cells").limit(clusters).collect()
    return np.array([r["cells"] for r in rows], np.int64)


def clustered(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
              vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts.

    Each round assigns all vectors and moves each centroid to the rounded-down mean of its vectors; a
    centroid without vectors stays. Tasks send one sum per cluster and dimension; the driver holds the
    centroids only.
    """
    spark = table.sparkSession
    cells = staged(integers(table, dimensions, vec_id, vector), "vector-integers")
    centroids = first_centroids(cells, clusters)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    simplex = Simplex(centroids)
    of_pivots = shipped(spark, simplex)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                apexes = of_pivots().apexes(_rows(part["cells"], np.int64))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["cells"], _lists(apexes)],
                                                 ["vec_id", "cells", "apex"])

    vectors = staged(cells.mapInArrow(project, "vec_id long, cells array<int>, apex array<double>"), "vector-apexes")

    def assigned(batch: pa.RecordBatch, to: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        rows = _rows(batch["cells"], np.int64)
        return rows, *nearest(rows, _rows(batch["apex"], np.float64), *to)

    for _ in range(rounds):
        current = shipped(spark, (centroids, simplex.apexes(centroids)))

        def sums(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            to = current()
            total, n = np.zeros(to[0].shape, np.int64), np.zeros(len(to[0]), np.int64)
            for batch in batches:
                rows, cluster, _ = assigned(batch, to)
                order = np.argsort(cluster, kind="stable")
                some, start = np.unique(cluster[order], return_index=True)
                if len(some):
                    total[some] += np.add.reduceat(rows[order], start, axis=0)
                    n += np.bincount(cluster, minlength=len(n))
            held = np.flatnonzero(n)
            dims = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(held, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(held))),
                 pa.array(total[held].ravel()), pa.array(np.repeat(n[held], dims))], ["cluster", "dim", "total", "n"])

        # One row per cluster and dimension: a fixed number, whatever the table's size.
        moved = vectors.select("cells", "apex").mapInArrow(sums, "cluster int, dim int, total long, n long").groupBy(
            "cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for row in moved:
            centroids[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]

    final = shipped(spark, (centroids, simplex.apexes(centroids)))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assigned(batch, final())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    result = staged(vectors.mapInArrow(ended, "vec_id long, cluster int, distance long"), "vector-clusters")
    inertia = {r["cluster"]: int(r["inertia"]) for r in result.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    labels = [(number, min(of, MOST), min(sum(inertia.values()), MOST),
               hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest())
              for number, of in inertia.items()]
    of_cluster = spark.createDataFrame(labels, T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
        T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]))
    # At most one row per cluster.
    return result.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The same in SQL, every vector compared with every centroid."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM kept
  ORDER BY sha256('2:' || vec_id) LIMIT {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT row_id, vec_id, v, cluster, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d
  FROM kept, c{r}),
a{r} AS MATERIALIZED (
  SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, i, floor(sum(x) / count(*)) AS x
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(n.c, c{r}.c) AS c
  FROM c{r} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS c FROM m{r} GROUP BY cluster) n USING (cluster))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = oracle()
