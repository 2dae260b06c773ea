"""Exact centroid clustering with heap-ordered bounds.

Each cluster keeps a heap of its vectors by the gap between the distance to the
second nearest centroid (lower bound) and to their own (upper bound).  A round
that moves centroids can shrink the gaps of a cluster by at most its own
movement plus the largest movement of another centroid; instead of touching
every vector this drift is added up once for each cluster, and a vector is
stored under ``gap + drift so far`` at its insertion.  It is safe while that key
is not below the cluster's drift.  Only vectors whose key the drift has passed
are popped, measured against all centroids exactly and pushed again.

On Spark the heaps are an append-only log of Parquet files, each ordered by
(cluster, key).  Drift only grows, so a row is on a heap as long as its key is
not below its cluster's drift, and a round pops the rows with keys between the
drift before and after it: a range of every ordered run, found by row group and
page statistics.  The popped vectors' new places are one more run; when rows
that left their heap outnumber the others, the log is written anew.  The driver
holds the centroids and their sums (clusters times dimensions); sums change by
the popped vectors that moved.  Nothing is shuffled but those sums, and vectors
are dealt by where they are stored, so a cluster or a repeated vector of any
share of the rows stays spread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import discard, kept_at, map_batches, staged

# Components must stay below this in size, so that squared distances fit 64 bits.
LARGEST = 1 << 27
# Distances are widened by this share, and stored drifts lowered by the other: far above the rounding of a square
# root, and of the sum of a few rounds' drifts.
SLACK, ROUNDING = 1e-9, 1e-13
# The log is written anew when it holds more than so many times the vectors.
LOG_ROWS = 2

_RUN = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("x", T.ArrayType(T.LongType())),
                     T.StructField("was", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                     T.StructField("key", T.DoubleType())])


@dataclass(frozen=True)
class Clusters:
    """``points`` (vec_id, x, cluster), the final ``centroids``, and how many vectors each round measured."""
    points: DataFrame
    centroids: list[list[int]]
    measured: list[int]


def kept_vectors(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dim`` components, none null or non-finite; x = floor(1024 * component).

    A component of ``LARGEST`` or more in size after scaling stops the job: its distances need more than 64 bits.
    """
    v = vectors[vector_col]
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    bound = F.lit(float(LARGEST))

    def scaled(c: Column) -> Column:
        y = F.floor(c.cast("double") * 1024)
        too_far = F.raise_error(F.lit("a vector's component is too large")).cast("long")
        return F.when(F.abs(c.cast("double") * 1024) < bound, y).otherwise(too_far)

    whole = (F.size(v) == dim) & finite
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(
        vectors[id_col].cast("long").alias("vec_id"), F.transform(v, scaled).alias("x"))


def first_centroids(points: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 (hex) of ``salt`` followed by their id, in that order.

    Of equal ids the smaller vector comes first; a null id comes last.
    """
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    return [list(r["x"]) for r in rows]


def _measure(points: DataFrame, centroids: np.ndarray, drift: np.ndarray, dim: int) -> DataFrame:
    """``points`` (vec_id, x, was) with their nearest centroid (ties: smaller number) and their key on its heap."""
    def run(batch: pa.RecordBatch) -> dict:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, dim)
        squared = np.empty((len(x), len(centroids)), np.int64)
        for j, c in enumerate(centroids):
            gap = x - c
            np.einsum("ij,ij->i", gap, gap, out=squared[:, j])
        nearest = squared.argmin(axis=1)
        away = np.sqrt(np.sort(squared, axis=1)[:, :2].astype(np.float64))
        if len(centroids) == 1:
            key = np.full(len(x), np.inf)
        else:
            key = away[:, 1] * (1 - SLACK) - away[:, 0] * (1 + SLACK)
            key = np.maximum(key, 0.0) + drift[nearest] * (1 - ROUNDING)
        return {"vec_id": batch.column("vec_id"), "x": batch.column("x"), "was": batch.column("was"),
                "cluster": pa.array(nearest.astype(np.int32)),
                "key": pa.array(np.maximum(key, drift[nearest]))}

    return map_batches(points, run, _RUN)


def _moved(run: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Changes of the clusters' sums and counts by a run's vectors, and how many vectors it holds."""
    totals = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim)]
    rows = run.groupBy("was", "cluster").agg(F.count(F.lit(1)).alias("n"), *totals).collect()
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    for r in rows:  # at most k * (k + 1)
        if r["was"] == r["cluster"]:
            continue
        change = np.array([int(r[f"s{i}"]) for i in range(dim)], object)
        sums[r["cluster"]] += change
        counts[r["cluster"]] += r["n"]
        if r["was"] >= 0:
            sums[r["was"]] -= change
            counts[r["was"]] -= r["n"]
    return sums, counts, sum(r["n"] for r in rows)


def _between(low: np.ndarray, high: np.ndarray | None) -> Column:
    """Rows whose key is not below ``low`` and, where ``high`` is given, below ``high`` of their cluster."""
    def one(c: int) -> Column:
        hit = (F.col("cluster") == c) & (F.col("key") >= float(low[c]))
        return hit if high is None else hit & (F.col("key") < float(high[c]))
    return reduce(lambda a, b: a | b, [one(c) for c in range(len(low))])


def _rows(runs: list[tuple[DataFrame, str]], which: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [run.filter(which) for run, _ in runs])


def heap_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3:",
                  id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters | None:
    """Lloyd rounds over the integer vectors of ``kept_vectors``, measuring only those whose gap expired.

    Every round assigns each vector to the nearest centroid (squared Euclidean
    distance; the smaller number in a tie) and replaces each non-empty centroid by
    its vectors' componentwise floor(sum / count); an empty one stays.  Vectors are
    assigned once more at the end.  Repeated rows and null ids are vectors like
    any other; with fewer than ``k`` vectors there are as many centroids.  None
    if there is no vector.  Other columns are not read.
    """
    points = kept_vectors(vectors, dim, id_col, vector_col)
    centroids = np.array(first_centroids(points, k, salt), np.int64).reshape(-1, dim)
    k = len(centroids)
    if not k:
        return None
    before = drift = np.zeros(k)
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    runs: list[tuple[DataFrame, str]] = []
    measured: list[int] = []
    logged = 0
    for step in range(rounds + 1):
        if not runs:
            popped = points.withColumn("was", F.lit(-1))
        else:
            popped = _rows(runs, _between(before, drift)).select("vec_id", "x", F.col("cluster").alias("was"))
        run, path = kept_at(_measure(popped, centroids, drift, dim).sortWithinPartitions("cluster", "key"), "heap-run")
        more, fewer, n = _moved(run, k, dim)
        runs.append((run, path))
        measured.append(n)
        logged += n
        if logged > LOG_ROWS * measured[0]:
            whole = kept_at(_rows(runs, _between(drift, None)).sortWithinPartitions("cluster", "key"), "heap-run")
            for _, old in runs:
                discard(points.sparkSession, old)
            runs, logged = [whole], measured[0]
        if step == rounds:
            break
        sums, counts = sums + more, counts + fewer
        update = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist()
                           for c in range(k)], np.int64)
        moves = np.sqrt(((update - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        others = np.array([max((m for j, m in enumerate(moves) if j != c), default=0.0) for c in range(k)])
        centroids, before, drift = update, drift, drift + moves + others
    # A run's rows that an earlier round popped lie below the drift of that round.
    live = _rows(runs, _between(drift, None))
    return Clusters(live.select("vec_id", "x", "cluster"), centroids.tolist(), measured)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3:",
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that ``kept_vectors`` keeps.

    ``distance`` is squared; the inertias are its sums over the cluster and over
    all; ``centroid`` the cluster's components.  See ``heap_clusters`` for ties,
    nulls and repeated rows; without vectors the result is empty.
    """
    found = heap_clusters(vectors, k, rounds, dim, salt, id_col, vector_col)
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid array<long>")
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    spark = vectors.sparkSession
    centres = F.broadcast(spark.createDataFrame(  # k rows
        [(c, x) for c, x in enumerate(found.centroids)], "cluster int, centroid array<long>"))
    gap = F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b))
    away = staged(found.points.join(centres, "cluster").select(
        "vec_id", "cluster", F.aggregate(gap, F.lit(0).cast("long"), lambda s, d: s + d).alias("distance")),
        "distances")
    sums = {r["cluster"]: int(r["s"]) for r in away.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = sum(sums.values())
    known = F.broadcast(spark.createDataFrame(
        [(c, sums.get(c, 0), inertia, x) for c, x in enumerate(found.centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    return away.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                              "centroid")
