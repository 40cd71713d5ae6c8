"""Near-duplicate embeddings by E8 lattice hashing with neighbour probes and
verified cosines."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import components, map_arrow, mix, stage
from quantloom.llm.tiles import by_pair, forest, runs, tile_pairs
from quantloom.llm.vectors import dimension, matrix, usable

COSINE = 0.93
TABLES, PROBES = 5, 4
REACH = 0.53  # of a pair at the threshold, in lattice units; the lattice's points are 1.41 apart
TILE = 1_024
PAIRS = 1 << 15  # verified together, so that a tile of near copies takes little memory
SEED = 11
MOST_A_LABEL, MANY = 1 << 18, 1 << 7  # different vectors of a label from which cells are of two blocks, and of three
PLANS = {1: (TABLES, PROBES), 2: (10, 2), 3: (16, 2)}  # tables and probes, by blocks, that find 0.999 of the pairs at the threshold


def cell_scale(d: int, least: float) -> float:
    """The lattice's unit, from how far two unit vectors at cosine `least` are
    apart, by the mean, in 8 of d orthonormal directions."""
    return float(np.sqrt(max(2.0 * (1.0 - least), 1e-12) * min(8, max(d, 1)) / max(d, 1))) / REACH


def even_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(1) % 2 != 0
    worst = np.abs(off).argmax(1)
    row = np.arange(len(x))
    near[row, worst] += np.where(odd, np.where(off[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the even integer points
    and the same moved by a half everywhere."""
    a, b = even_nearest(x), even_nearest(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [np.array(signs) / 2 for signs in itertools.product((1.0, -1.0), repeat=8) if np.prod(signs) > 0]
    return np.array(whole + half)


def planes(d: int, tables: int, blocks: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By table, for each block of it, 8 orthonormal directions of the space (fewer,
    if it has fewer) and a shift. Blocks of a table are orthogonal to each other."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        whole = np.linalg.qr(rng.standard_normal((d, min(8 * blocks, d))))[0]
        out.append([(whole[:, 8 * b : 8 * b + 8], rng.random(8) * 2) for b in range(blocks)])
    return out


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int, blocks: int = 1) -> np.ndarray:
    """(rows, tables, (1 + probes) ** blocks): numbers of each row's home cell in each
    table and of the neighbouring cells nearest to it. A cell is a lattice point in
    each of a table's blocks; the home cell is home in all of them."""
    around = neighbours()
    width = 1 + probes
    out = np.zeros((len(unit), tables, width**blocks), np.int32)
    weights = mix(np.arange(1, 9, dtype=np.uint64))
    for t, parts in enumerate(planes(unit.shape[1], tables, blocks, seed)):
        number = np.full((len(unit), 1), t, np.uint64)
        for plane, shift in parts:
            y = np.zeros((len(unit), 8))
            y[:, : plane.shape[1]] = unit @ plane / scale
            y += shift
            home = decode(y)
            off = y - home
            # distance to home + n is least where off . n is greatest
            order = np.argpartition(-(off @ around.T), probes, axis=1)[:, :probes] if probes else np.zeros((len(unit), 0), np.int64)
            points = np.concatenate([home[:, None], home[:, None] + around[order]], axis=1)
            own = ((points * 2).astype(np.int64).view(np.uint64) * weights).sum(2)
            number = mix((number[:, :, None] + own[:, None]).reshape(len(unit), -1))
        out[:, t] = (number >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def blocks_for(most: int, d: int) -> int:
    """How many lattice points make a cell where a label has `most` different
    vectors. Each more block divides what meets by chance by a hundred or so, and
    multiplies the cells by four: worth it once a cell holds far more than a tile."""
    blocks = 1
    while blocks < d // 8 and most > MOST_A_LABEL * MANY ** (blocks - 1) and blocks < 3:
        blocks += 1
    return blocks


def met_before(codes_a: np.ndarray, codes_b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a pair meets in a table before the given one."""
    either = (codes_a == codes_b[:, :, :1]).any(2) | (codes_b == codes_a[:, :, :1]).any(2)
    return (either & (np.arange(either.shape[1]) < table[:, None])).any(1)


def first_met(p: np.ndarray, q: np.ndarray, node: np.ndarray, v: np.ndarray, codes: np.ndarray, t: np.ndarray, probe: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs p - q of a cell's rows, those that link and count here: the
    cosine is verified, and the pair meets in no table before this one."""
    keep = (node[p] != node[q]) & ((probe[p] == 0) | (probe[q] == 0))
    p, q = p[keep], q[keep]
    cosine = (v[p] * v[q]).sum(1) / (np.linalg.norm(v[p], axis=1) * np.linalg.norm(v[q], axis=1))
    p, q = p[cosine >= least], q[cosine >= least]
    table = t[p]
    home_p, home_q = codes[p, table, 0], codes[q, table, 0]
    together = home_p == home_q
    both = (probe[p] == 0) & (probe[q] == 0)
    # a pair that each end probes for counts in the cell of the smaller id
    at_p = probe[p] == 0
    owner, other = np.where(at_p, p, q), np.where(at_p, q, p)
    mutual = (codes[owner, table, 1:] == codes[other, table, :1]).any(1)
    here = np.where(together, both, ~mutual | (node[owner] < node[other]))
    here &= ~met_before(codes[p], codes[q], table)
    return p[here], q[here]


def links(distinct: DataFrame, d: int, least: float, tables: int, probes: int, scale: float, blocks: int = 1, tile_rows: int = TILE) -> DataFrame:
    """a, b, n: for each node of (node, copies, label, v) in each compared tile
    pair, a root that it is connected with there and how many vectors it links to
    for the first time. Over all rows, n counts each link once for either end."""
    width = (1 + probes) ** blocks

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(3), d)
            codes = cells(v / np.linalg.norm(v, axis=1)[:, None], tables, probes, scale, SEED, blocks).reshape(len(v), tables * width)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(tables * width)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], ["node", "copies", "label", "v", "codes"])

    kind = dict(distinct.dtypes)
    coded = stage(map_arrow(distinct.select("node", "copies", "label", "v"), hashed, f"node long, copies long, label {kind['label']}, v {kind['v']}, codes array<int>"), "codes")
    # cells are dealt by node number; the vectors join once it is known which tiles meet
    rows = coded.select("node", "label", F.posexplode("codes").alias("at", "cell")).select("node", F.floor(F.col("at") / width).cast("int").alias("t"), F.when(F.col("at") % width > 0, 1).otherwise(0).alias("probe"), "label", "cell")
    rows = rows.select("node", "t", "probe", F.xxhash64("t", "cell", "label").alias("bucket"))
    # a cell without a home row compares nothing
    homes = rows.where("probe = 0").select("bucket").distinct()
    rows = stage(rows.join(homes, "bucket", "left_semi"), "cells")
    paired = tile_pairs(rows, "bucket", F.lit(0), 0, F.xxhash64("node"), tile_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
            codes = b.column(5).flatten().to_numpy().reshape(b.num_rows, tables, width)
            return [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3)] + [matrix(b.column(4), d), codes, b.column(6).to_numpy(), b.column(7).to_numpy()]

        for _, side, node, copies, v, codes, t, probe in runs(batches, arrays):
            unit = v / np.linalg.norm(v, axis=1)[:, None]
            if side[0] == 2:
                p, q = np.nonzero(np.triu(unit @ unit.T >= least - 1e-9, 1))
            else:
                half = int(np.searchsorted(side, 1))
                p, q = np.nonzero(unit[:half] @ unit[half:].T >= least - 1e-9)
                q = q + half
            parts = [first_met(p[k : k + PAIRS], q[k : k + PAIRS], node, v, codes, t, probe, least) for k in range(0, len(p), PAIRS)]
            p, q = (np.concatenate([x[k] for x in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            n = np.zeros(len(node), np.int64)
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            label = forest(len(node), p, q)
            out = np.flatnonzero(n > 0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[label[out]]), pa.array(n[out])], ["a", "b", "n"])

    whole = paired.select("pair", "side", "node", "t", "probe").join(coded.select("node", "copies", "v", "codes"), "node")
    return map_arrow(by_pair(whole.select("pair", "side", "node", "copies", "v", "codes", "t", "probe")), run, "a long, b long, n long")


def near_duplicates(table: DataFrame, least: float = COSINE, blocks: int | None = None, scale: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row a vector.

    Vectors with equal labels link at a cosine of `least` or more. Equal vectors
    of a label are one class, so copies are never paired; each class is hashed
    to its home cell and the nearest neighbouring cells in each table, and what
    meets in a cell is verified. A pair counts in the first table in which it
    meets. blocks: lattice points to a cell, from how many different vectors a label
    has, if not given; scale: the lattice's unit, from dimension and cosine. Both
    change the work and not what counts as a link.
    Rows with a null label, and vectors that are null, zero, of another length
    than most, or hold null or non-finite components, link with nothing. Rows
    that repeat a vec_id are vectors of their own, since classes, not ids, are the
    nodes; a null vec_id links with nothing. Other columns, of any names, are
    ignored; an empty table gives no rows.
    """
    named = table.select("vec_id", "label", F.col("embedding").alias("v"))
    able = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    d = dimension(named.where(able), "v")
    able = able & (F.size("v") == d)
    rows = named.where(able)
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written, so a node keeps its number
    if blocks is None:
        most = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        blocks = blocks_for(most, d)
    tables, probes = PLANS[blocks]
    found = stage(links(distinct, d, least, tables, probes, cell_scale(d, least) if scale is None else scale, blocks), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = distinct.join(counts, "node", "left").join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = stage(of.select("label", "v", "first", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = rows.join(of.join(ids, "component").select("label", "v", "n_links", "component_id"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = named.where(~F.coalesce(able, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
