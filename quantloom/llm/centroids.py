"""Centroid clustering of integer vectors by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import drop_stage, map_arrow, stage

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
REACH = 1 << 27  # of a component: squared distances of 64 such fit a long
TOGETHER = 4  # dimensions added up before centroids are abandoned
ROWS = 1 << 14  # of a batch that are compared at a time


def scaled(vectors: DataFrame, vector: str, key: str, dimensions: int, scale: int) -> DataFrame:
    """id, v: the rows that take part, as integers floor(scale * x) within REACH."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))
    # held within reach before the floor, which would leave the range of a long
    whole = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(float(-REACH)), F.least(F.lit(float(REACH)), x * float(scale)))).cast("int"))
    return vectors.where(able).select(F.col(key).alias("id"), whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, guess: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and its
    squared distance.

    The dimensions are added up in the order given. A row drops a centroid as
    soon as its sum so far is strictly above the row's best; only rows that
    still may win or tie go on to the last dimension.
    """
    v = v[:, order].astype(np.int64)
    c = centroids[:, order]
    best = ((v - c[guess]) ** 2).sum(1)
    number = np.full(len(v), guess, np.int32)
    for k in (k for k in range(len(c)) if k != guess):
        alive = np.arange(len(v))
        total = np.zeros(len(v), np.int64)
        for a in range(0, len(order), TOGETHER):
            step = v[alive, a : a + TOGETHER] - c[k, a : a + TOGETHER]
            total = total + np.einsum("ij,ij->i", step, step)
            still = total <= best[alive]
            if not still.all():
                alive, total = alive[still], total[still]
            if not len(alive):
                break
        won = (total < best[alive]) | (total == best[alive]) & (k < number[alive])
        best[alive[won]], number[alive[won]] = total[won], k
    return number, best


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def sums(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Count and componentwise sum of the rows nearest to each centroid. A task
    gives one row a centroid, and Spark adds those up."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            v = matrix(batch.column(0), d)
            for a in range(0, len(v), ROWS):
                number, _ = nearest(v[a : a + ROWS], centroids, order)
                n += np.bincount(number, minlength=k)
                for c in range(k):
                    total[c] += v[a : a + ROWS][number == c].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = map_arrow(rows.select("v"), run, "cluster int, n long, total array<long>")
    found = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts, total = [0] * k, [[0] * d for _ in range(k)]
    for r in found:  # a number for each centroid and dimension
        counts[r["cluster"]], total[r["cluster"]][r["at"]] = r["n"], int(r["x"])
    return counts, total


def spread_order(rows: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions, those of the highest variance over all rows first. Only the
    speed hangs on it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            v = matrix(batch.column(0), dimensions).astype(np.float64)
            n, total, square = n + len(v), total + v.sum(0), square + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(np.full(dimensions, float(n))), pa.array(total), pa.array(square)], ["at", "n", "total", "square"])

    parts = map_arrow(rows.select("v"), run, "at long, n double, total double, square double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"))
    spread = {r["at"]: r["square"] / r["n"] - (r["total"] / r["n"]) ** 2 for r in parts.collect() if r["n"]}
    return np.array(sorted(range(dimensions), key=lambda j: (-spread.get(j, 0.0), j)), np.int64)


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row a
    vector that takes part.

    Vectors of exactly `dimensions` components, none null or non-finite, take
    part as integers floor(scale * x). Those with the smallest SHA-256 of
    `seed:key` are the first centroids; each round assigns every vector to the
    nearest (squared distance, ties to the smaller number) and replaces each
    centroid that has vectors by the floor of their mean. All arithmetic is of
    integers, so no order of tasks or rows changes a result. A round is one pass
    over the staged integers; a task hands on `centroids` rows.

    Rows that repeat, or share an id, count each; of those with one hash the
    smaller components come first. A null id is hashed as `seed:null`. With fewer
    vectors than centroids each is a centroid. Components whose integer is beyond
    2**27 either way count as 2**27, so that a distance fits a long; an inertia
    that doesn't is null. An empty table, or one without a vector that takes part,
    gives no rows; other columns are ignored.
    """
    rows = stage(scaled(vectors, vector, key, dimensions, scale), "scaled")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    start = [r["v"] for r in rows.select(name.alias("name"), "v").orderBy("name", "v").limit(centroids).collect()]
    now = np.array(start, np.int64).reshape(-1, dimensions)
    order = spread_order(rows, dimensions)
    for _ in range(rounds if len(now) else 0):
        counts, total = sums(rows, now, order)
        now = np.array([[x // n for x in t] if n else old.tolist() for n, t, old in zip(counts, total, now)], np.int64)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dimensions)
            for a in range(0, len(v), ROWS):
                number, best = nearest(v[a : a + ROWS], now, order)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + ROWS], pa.array(number), pa.array(best)], ["id", "cluster", "distance"])

    assigned = stage(map_arrow(rows.select("id", "v"), run, f"id {kind}, cluster int, distance long"), "assigned")
    drop_stage(rows)
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: r["x"] for r in assigned.groupBy("cluster").agg(whole.alias("x")).collect()}
    fits = lambda x: int(x) if x < 2**63 else None
    everything = sum(inertia.values())
    facts = [(c, fits(x), fits(everything), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, x in sorted(inertia.items())]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # as many rows as there are centroids
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
