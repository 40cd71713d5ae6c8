"""Rows of a bucket compared in tiles, so that no task holds a large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_pairs(rows: DataFrame, bucket: str, grade: Column, radius: int, salt: Column, tile_rows: int) -> DataFrame:
    """rows, once for each pair of tiles that has to be compared, with pair
    (long) and side (0: first tile of the pair, 1: second, 2: the pair is one
    tile with itself).

    bucket is a long column, rows in different buckets never meet; buckets with
    one row are left out. A bucket of up to tile_rows is one tile. A larger one
    is cut by grade (an int) and salt into tiles of about tile_rows; tile pairs
    whose grades differ by more than radius are skipped. Both the tiles and
    their rows are dealt out by pair, so a bucket that holds most rows is
    compared by many tasks. No row is dropped.
    """
    graded = rows.withColumn("_grade", grade)
    sizes = graded.groupBy(bucket, "_grade").agg(F.count("*").alias("_n"))
    whole = sizes.groupBy(bucket).agg(F.sum("_n").alias("_all")).where("_all > 1")
    cut = sizes.join(whole, bucket).select(bucket, "_grade", F.when(F.col("_all") <= tile_rows, 1).otherwise(F.ceil(F.col("_n") / tile_rows)).cast("int").alias("_cuts"), (F.col("_all") > tile_rows).alias("_large"))
    # small buckets: all grades in tile 0; large ones: a tile for each grade and cut
    small = graded.join(whole.where(F.col("_all") <= tile_rows), bucket).drop("_all").select("*", F.xxhash64(bucket).alias("pair"), F.lit(2).alias("side"))
    tiles = cut.where("_large").select(bucket, "_grade", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_cut"))
    a, b = tiles.alias("a"), tiles.alias("b")
    first = F.struct("a._grade", "a._cut")
    second = F.struct("b._grade", "b._cut")
    pairs = a.join(b, (F.col(f"a.{bucket}") == F.col(f"b.{bucket}")) & (F.col("b._grade") - F.col("a._grade")).between(0, radius) & (first <= second))
    pairs = pairs.select(F.col(f"a.{bucket}").alias(bucket), F.xxhash64(F.col(f"a.{bucket}"), first, second).alias("pair"), first.alias("x"), second.alias("y"))
    ends = pairs.where("x = y").select(bucket, "pair", F.col("x").alias("t"), F.lit(2).alias("side")).unionByName(
        pairs.where("x != y").select(bucket, "pair", F.explode(F.array(F.struct(F.col("x").alias("t"), F.lit(0).alias("side")), F.struct(F.col("y").alias("t"), F.lit(1).alias("side")))).alias("e")).select(bucket, "pair", "e.t", "e.side"))
    ends = ends.select(bucket, F.col("t._grade").alias("_grade"), F.col("t._cut").alias("_cut"), "pair", "side")
    large = graded.join(cut.where("_large"), [bucket, "_grade"]).withColumn("_cut", F.pmod(salt, F.col("_cuts")).cast("int"))
    large = large.join(ends, [bucket, "_grade", "_cut"])
    return small.select(*rows.columns, "pair", "side").unionByName(large.select(*rows.columns, "pair", "side"))


def by_pair(rows: DataFrame) -> DataFrame:
    """Tile pairs together and in order, for `runs`."""
    return rows.repartition("pair").sortWithinPartitions("pair", "side")


def runs(batches: Iterable[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The arrays of each run of rows with the same value in the first array.
    Holds one run and one batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        cuts = [0, *(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield [x[a:b] for x in now]
        held = [x[cuts[-1] :] for x in now]
    if held is not None:
        yield held


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the smallest node reachable over the links i - j.

    Each round hangs the larger root of a link's two ends under the smaller one
    and brings every node straight to its root.
    """
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
