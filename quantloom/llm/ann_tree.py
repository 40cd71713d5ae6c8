"""Approximate nearest neighbours by a hierarchical k-means tree with
best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import map_arrow, stage
from quantloom.llm.tiles import runs
from quantloom.llm.vectors import dimension, matrix, usable

SAMPLE_ROWS = 20_000
BRANCHES = 16
LEAF_ROWS = 24  # of the sample
PROBES, GOAL = 256, 0.93  # calibration queries, and the share of their neighbours in the whole table that they must reach
NEIGHBOURS = 10
TILE = 4_096
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes by number; node 0 is the root."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # a leaf's number, -1 for inner nodes
    leaves: int = 0
    visits: int = 1

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = squared(x[rows], np.stack([self.centres[c] for c in self.children[node]])).argmin(1)
            todo += [(c, rows[nearest == k]) for k, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves for one query: always the open node whose centre is
        nearest. More than `visits`, if those hold fewer than `least` of `rows`."""
        queue = [(0.0, 0)]
        found: list[int] = []
        held = 0
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                held += 0 if rows is None else int(rows[self.leaf[node]])
                continue
            near = squared(q[None], np.stack([self.centres[c] for c in self.children[node]]))[0]
            for d, c in zip(near.tolist(), self.children[node]):
                heapq.heappush(queue, (d, c))
        return found


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T), 0.0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        nearest = squared(x, centres).argmin(1)
        n = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def build(x: np.ndarray, branches: int, leaf_rows: int, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree()
    todo = [(tree.add(x.mean(0) if len(x) else np.zeros(x.shape[1])), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        centres = kmeans(x[rows], branches, rng) if len(rows) > leaf_rows else np.zeros((1, 1))
        nearest = squared(x[rows], centres).argmin(1) if len(centres) > 1 else np.zeros(len(rows), np.int64)
        parts = [(c, rows[nearest == k]) for k, c in enumerate(centres)]
        if len(centres) < 2 or max(len(p) for _, p in parts) == len(rows):
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for centre, part in parts:
            if len(part):
                child = tree.add(centre)
                tree.children[node].append(child)
                todo.append((child, part))
    return tree


def calibrate(tree: Tree, probes: np.ndarray, leaves: list[list[int]], goal: float) -> int:
    """How many leaves a query visits: widened until the probes reach their share
    of the leaves that hold their true neighbours."""
    needed = []
    for q, own in zip(probes, leaves):
        rank = {n: r for r, n in enumerate(tree.visit(q, tree.leaves))}
        needed += [rank[n] + 1 for n in own]
    return int(np.quantile(needed, goal, method="higher")) if needed else tree.leaves


def probe_leaves(index: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int, d: int) -> list[list[int]]:
    """The leaves of each probe's k nearest rows of the whole index (leaf, id, v):
    a few hundred probes against all rows, each task keeping the k nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int, int]]] = {}
        for batch in batches:
            leaf, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = matrix(batch.column(2), d)
            for i in range(0, len(own), 8192):
                cut = slice(i, i + 8192)
                place = dict(zip(own[cut].tolist(), leaf[cut].tolist()))
                for q, r, score in zip(*(c.tolist() for c in nearest(probes, ids, v[cut], own[cut], k))):
                    held.setdefault(q, []).append((score, r, place[r]))
                held = {q: sorted(x)[:k] for q, x in held.items()}
        rows = [(q, *x) for q, found in held.items() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["probe", "score", "id", "leaf"])

    found = map_arrow(index.select("leaf", "id", "v"), run, "probe long, score double, id long, leaf long")
    place = F.row_number().over(W.partitionBy("probe").orderBy("score", "id"))
    by: dict[int, list[int]] = {}
    for r in found.withColumn("place", place).where(F.col("place") <= k).select("probe", "leaf").collect():
        by.setdefault(r["probe"], []).append(r["leaf"])
    return [by.get(int(i), []) for i in ids]


def fit(rows: DataFrame, key: str, vector: str, d: int, sample_rows: int = SAMPLE_ROWS, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree from at most sample_rows vectors, by a hash of id and vector, and
    the first of those as probes, with their ids."""
    sample = rows.orderBy(F.xxhash64(key, vector), key).limit(sample_rows).select(key, vector).collect()
    x = np.array([r[1] for r in sample], np.float64).reshape(-1, d)
    first: dict[int, np.ndarray] = {}
    for r, v in zip(sample, x):
        if len(first) < PROBES:
            first.setdefault(r[0], v)
    return build(x, branches, leaf_rows), np.array(list(first.values())).reshape(-1, d), np.array(list(first), np.int64)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row and distance of each query's k nearest rows but itself, ties to
    the smaller id. A product finds the contenders; their distances are then
    taken from the differences."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(queries), 256):
        q, ids = queries[i : i + 256], query_ids[i : i + 256]
        d = squared(q, rows)
        d[ids[:, None] == row_ids[None]] = np.inf
        if len(rows) > k:
            edge = np.partition(d, k - 1, axis=1)[:, k - 1]
            a, b = np.nonzero(d <= (edge + SLACK * (1.0 + edge))[:, None])
        else:
            a, b = np.nonzero(np.isfinite(d))
        for s in range(0, len(a), 65_536):
            x, y = a[s : s + 65_536], b[s : s + 65_536]
            exact = np.sqrt(((q[x] - rows[y]) ** 2).sum(1))
            keep = np.isfinite(d[x, y])
            out.append((ids[x[keep]], row_ids[y[keep]], exact[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return first_of(*(np.concatenate(c) for c in zip(*out)), k)


def first_of(q: np.ndarray, r: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query; a row once, at its nearest."""
    order = np.lexsort((d, r, q))
    q, r, d = q[order], r[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    q, r, d = q[new], r[new], d[new]
    order = np.lexsort((r, d, q))
    q, r, d = q[order], r[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], r[rank < k], d[rank < k]


def search(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, **tree_parameters) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets is_query, its k
    nearest found rows but itself by Euclidean distance, ties to the smaller id.

    The tree is fitted on a bounded sample; every row is put in its leaf. How many
    leaves a query visits is calibrated on a few hundred probes and their true
    neighbours in the whole table. Each query goes to the leaves that best-bin-first traversal reaches, as many as
    calibrated and until they hold enough rows, and meets their rows there, in
    tiles of rows and of queries, so a leaf with most rows is searched by many
    tasks. A query that still has fewer than k is put to all leaves, so there are
    fewer only if there are fewer candidates. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part,
    nor do rows without an id. Rows that repeat an id are candidates once, at
    their nearest, and a query that stands at rows with different vectors is asked
    with the least of them, component by component. Very long vectors are taken
    whole. No usable vector gives no rows. Other columns, of any names,
    are ignored.
    """
    table = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("is_query"))
    d = dimension(table.where(usable(F.col("v"))), "v")
    if not d:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = table.where(usable(F.col("v")) & (F.size("v") == d) & F.col("id").isNotNull()).withColumn("v", F.transform("v", lambda x: x.cast("double")))
    tree, probes, ids = fit(rows, "id", "v", d, **tree_parameters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(matrix(batch.column(1), d))), *batch.columns], ["leaf", "id", "v", "is_query"])

    index = stage(map_arrow(rows, place, "leaf long, id long, v array<double>, is_query boolean"), "leaves")
    tree.visits = calibrate(tree, probes, probe_leaves(index, probes, ids, k, d), GOAL)
    held = np.zeros(tree.leaves, np.int64)
    for r in index.select("leaf", "id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r["leaf"]] = r["n"]
    queries = stage(index.where("is_query").groupBy("id").agg(F.min("v").alias("v")), "queries")
    found = stage(met(index, queries, tree, tree.visits, held, k, d), "found")
    most = min(k, index.select("id").distinct().count() - 1)
    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= most)
    short = stage(queries.join(enough, "id", "left_anti"), "short")
    if most > 0 and not short.isEmpty():
        again = met(index, short, tree, tree.leaves, held, k, d)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found


def shards(held: np.ndarray, most: int) -> np.ndarray:
    """The shard of each leaf: neighbouring leaves together, up to `most` rows."""
    out, shard, rows = np.zeros(len(held), np.int64), 0, 0
    for leaf, n in enumerate(held.tolist()):
        if rows and rows + n > most:
            shard, rows = shard + 1, 0
        out[leaf] = shard
        rows += n
    return out


def held_rows(index: DataFrame, leaves: int) -> np.ndarray:
    """How many rows each leaf holds."""
    out = np.zeros(leaves)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        out[r["leaf"]] = r["n"]
    return out


def met(index: DataFrame, queries: DataFrame, tree: Tree, visits: int, held: np.ndarray, k: int, d: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of index (leaf, id, v) in
    the leaves that each of queries (id, v) visits. Neighbouring leaves share a
    tile, so that a query is sent, and answered, once for all that it visits there."""
    of = shards(held, TILE)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                owner, shard, leaves = [], [], []
                for i, q in enumerate(matrix(part.column(1), d)):
                    visited = np.sort(np.array(tree.visit(q, visits, held, k + 1), np.int64))  # shards rise with the leaves
                    cuts = np.flatnonzero(np.diff(of[visited])) + 1
                    for own in np.split(visited, cuts):
                        owner.append(i)
                        shard.append(int(of[own[0]]))
                        leaves.append(own.tolist())
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column(0).take(take), part.column(1).take(take), pa.array(leaves, pa.list_(pa.int64()))], ["shard", "id", "v", "leaves"])

    spark = index.sparkSession
    dealt = queries.repartition(F.xxhash64("id"))
    probes = stage(map_arrow(dealt.select("id", "v"), route, "shard long, id long, v array<double>, leaves array<long>"), "probes")
    # a row a leaf of the tree, and one a shard: both bounded by the sample
    asking = {r["shard"]: r["q"] for r in probes.groupBy("shard").agg(F.count("*").alias("q")).collect()}
    rows_in = np.bincount(of, weights=held_rows(index, tree.leaves)).astype(np.int64).tolist() if len(of) else []
    cut = lambda n: -(-int(n) // TILE)
    dealt_out = [(shard, cut(n), cut(asking[shard])) for shard, n in enumerate(rows_in) if n and asking.get(shard)]
    sizes = spark.createDataFrame(dealt_out, "shard long, cuts int, turns int")
    places = spark.createDataFrame(list(enumerate(of.tolist())), "leaf long, shard long").join(F.broadcast(sizes), "shard")
    tile = F.xxhash64("shard", "cut", "turn").alias("tile")
    own = index.join(F.broadcast(places), "leaf").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asked = probes.join(F.broadcast(sizes), "shard").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    both = own.select(tile, F.lit(0).alias("asks"), "id", "v", F.array("leaf").alias("leaves")).unionByName(asked.select(tile, F.lit(1).alias("asks"), "id", "v", "leaves"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda b: [b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)] + [matrix(b.column(3), d), b.column(4).to_numpy(zero_copy_only=False)]
        for _, asks, ids, v, leaves in runs(batches, arrays):
            a = asks == 1
            wanted: dict[int, list[int]] = {}
            for i in np.flatnonzero(a).tolist():
                for leaf in leaves[i].tolist():
                    wanted.setdefault(leaf, []).append(i)
            there = np.array([x[0] for x in leaves[~a]], np.int64)
            row = np.flatnonzero(~a)
            order = np.argsort(there, kind="stable")
            there, row = there[order], row[order]
            found = []
            for own_rows in np.split(row, np.flatnonzero(np.diff(there)) + 1) if len(row) else []:
                asking = wanted.get(int(leaves[own_rows[0]][0]))
                if asking:
                    found.append(nearest(v[asking], ids[asking], v[own_rows], ids[own_rows], k))
            if found:
                q, r, score = first_of(*(np.concatenate(x) for x in zip(*found)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(score)], ["query_id", "vec_id", "score"])

    pairs = map_arrow(both.repartition("tile").sortWithinPartitions("tile"), meet, "query_id long, vec_id long, score double")
    # a row that repeats an id counts once
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
