"""SimHash fingerprints of word shingles and near duplicates by exact tiled
comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import components, map_arrow, stage, text_bytes
from quantloom.llm.tiles import by_pair, forest, runs, tile_pairs

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 1024
BLOCK = 256
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        digests = np.array([h(line[a:b], seed) for a, b in zip(start[at : at + CHUNK], end[at : at + CHUNK])], np.uint64)
        bits = np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp (the 64 bits as a long): a row a document, one pass, no shuffle.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z in lower
    case; a text with fewer words than a shingle is one shingle; null and texts
    without a word have fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            whole = data.tobytes()
            out = [fingerprint(whole[a:b], shingle, seed) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], [key, "fp"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, fp long")


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j with a[i] and b[j] at most radius bits apart. Both are in
    order of bit count; blocks too far apart in it are skipped."""
    ca, cb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    found = []
    for i in range(0, len(a), BLOCK):
        x = a[i : i + BLOCK]
        low = np.searchsorted(cb, ca[i] - radius, "left")
        high = np.searchsorted(cb, ca[min(i + BLOCK, len(a)) - 1] + radius, "right")
        for j in range(int(low), int(high), 4 * BLOCK):
            y = b[j : min(j + 4 * BLOCK, int(high))]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            found.append((p + i, q + j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def agreeing(n: int, radius: int, tile_rows: int) -> int:
    """In how many blocks at least two fingerprints of a bucket agree: enough for
    n spread fingerprints to leave a bucket a quarter of a tile."""
    m = 1
    while m < 4 and n > (tile_rows // 4) << (64 * m // (radius + m)):
        m += 1
    return m


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE, agree: int = 1) -> DataFrame:
    """a, b: links that connect the rows (node, fp) of distinct fingerprints
    exactly as all pairs at most radius bits apart do.

    Fingerprints are cut into radius + agree blocks of bits; two within the
    radius agree in `agree` at least, so the values of each choice of so many
    blocks are a bucket, compared in full by tiles. A tile pair gives a spanning
    forest of its links.
    """
    edge = [64 * k // (radius + agree) for k in range(radius + agree + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edge, edge[1:])]
    buckets = [F.xxhash64(F.lit(k), *[block[i] for i in chosen]) for k, chosen in enumerate(itertools.combinations(range(radius + agree), agree))]
    rows = distinct.select("node", "fp", F.explode(F.array(*buckets)).alias("bucket"))
    paired = tile_pairs(rows, "bucket", F.bit_count("fp").cast("int"), radius, F.xxhash64("fp"), tile_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns]
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for _, side, node, fp in runs(batches, arrays):
            fp = fp.view(np.uint64)
            order = np.lexsort((np.bitwise_count(fp), side))
            node, fp, side = node[order], fp[order], side[order]
            half = int(np.searchsorted(side, 1))
            if side[0] == 2:
                i, j = linked(fp, fp, radius)
            else:
                i, j = linked(fp[:half], fp[half:], radius)
                j = j + half
            keep = i != j
            label = forest(len(fp), i[keep], j[keep])
            out = np.flatnonzero(label != np.arange(len(fp)))
            left.append(node[out])
            right.append(node[label[out]])
            if len(left) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return map_arrow(by_pair(paired.select("pair", "side", "node", "fp")), run, "a long, b long")


def members(prints: DataFrame, key: str, radius: int, tile_rows: int = TILE) -> DataFrame:
    """fp, component, least: a row a distinct fingerprint, with the smallest
    fingerprint reachable over steps of at most radius bits and the least key of
    its rows. Fingerprints are the nodes, so rows without an id, or that repeat
    one, tie no groups together."""
    distinct = stage(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    agree = agreeing(distinct.count(), radius, tile_rows)
    found = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius, tile_rows, agree)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints
    at most radius bits apart.

    Fingerprints are the nodes: equal ones are one node, so copies are never
    paired, and an id that is null or stands at several texts ties no groups
    together. Null and wordless texts share fingerprint 0 and link like any
    other. Rows with a null doc_id get the component of the rest of their group,
    null if there is none with an id. Repeated rows are returned each. Very long
    texts are hashed whole, in chunks. An empty table gives no rows; columns
    other than doc_id and text are ignored.
    """
    prints = stage(fingerprints(docs, shingle, seed), "fingerprints")
    of = members(prints, "doc_id", radius)
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One document of each group, with all its columns: the smallest doc_id, or
    any if nobody in the group has an id; of rows that repeat that doc_id one stays.
    Null and wordless texts are one group. Columns of any names stay. An empty
    table gives none.

    Rows are told apart by two hashes of all their columns, and the least of a
    group comes from an aggregate, so neither a large group nor rows without an
    id meet in one task.
    """
    cells = [f(F.col(f"`{c}`")) for c in docs.columns for f in (F.isnull, lambda x: x)]
    # the caller's columns are one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b")).alias("hashes"), F.col("doc_id").alias("id"), F.col("text").alias("words"))
    row = F.struct(F.isnull("id").alias("no_id"), "id", "hashes").alias("row")
    prints = stage(fingerprints(rows.select(row, "words"), shingle, seed, "words", "row"), "fingerprints")
    kept = members(prints, "row", radius).groupBy("component").agg(F.min("least").alias("row")).select("row.hashes")
    alike = prints.groupBy(F.col("row.hashes").alias("hashes")).agg(F.count("*").alias("alike"))
    kept = stage(kept.join(alike, "hashes"), "kept")
    joined = rows.join(kept.hint("merge"), "hashes")
    out = joined.where("alike = 1").select("whole.*")
    if kept.where("alike > 1").isEmpty():
        return out
    # of rows equal in all columns one: grouped by a column that the join isn't dealt by, so that each task leaves one before the shuffle
    one = joined.where("alike > 1").withColumn("one", F.xxhash64("hashes")).dropDuplicates(["one", "hashes"])
    return out.unionByName(one.select("whole.*"))
