"""Stretches of documents that recur, found by winnowed anchors.

Both dedup operators on repeated passages share this: anchors whose gram recurs,
classes of anchors with equal surroundings, and, where surroundings differ, the
surroundings themselves, compared group by group by the operator's own method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import LEAST_LONG, drop_stage, map_arrow, stage, text_bytes
from quantloom.llm.tiles import runs
from quantloom.llm.winnow import Units, grams, scan

ROW = ["doc", "text_hash", "tail"]
CLASS = ["key", "span", "span2"]
ANCHOR = "doc long, text_hash long, tail int, key long, span long, span2 long, at int, lo int, hi int"
CONTEXT = "bucket binary, first_start int, last_start int, key long, span long, span2 long, doc long, lo int, hi int, units binary"
FOUND = "key long, span long, span2 long, doc long, first_start int, last_start int"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def row_key(text: str) -> list[Column]:
    """doc, text_hash, tail: what tells rows apart, also where doc_id is null or
    repeats. Rows alike in all of them have the same text (96 bits of hashes),
    so what is found in one holds for each."""
    return [F.coalesce("doc_id", F.lit(LEAST_LONG)).alias("doc"), F.xxhash64(text).alias("text_hash"), F.hash(text).alias("tail")]


def recurring(docs: DataFrame, units: Callable[[np.ndarray, np.ndarray], Units], window: int, gram: int, seed: Column) -> DataFrame:
    """The anchors whose gram meets `seed`, an aggregate condition on (doc).

    Two passes over the texts: one for the grams alone, and one for the anchors
    of those that recur, so the second shuffle's output is as small as the
    repeats are. The first is summed up before its shuffle; in the second, a sort
    merge join, Spark splits the partitions of hot grams.
    """
    texts = docs.where(F.col("text").isNotNull())
    every = map_arrow(texts.select(row_key("text")[0], "text"), lambda batches: grams(batches, units, window, gram), "key long, doc long")
    seeds = stage(every.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most")).where(seed).select("key"), "seeds")
    anchors = map_arrow(texts.select(*row_key("text"), "text"), lambda batches: scan(batches, units, window, gram), ANCHOR)
    out = stage(anchors.join(seeds.hint("merge"), "key", "left_semi"), "anchors")
    drop_stage(seeds)
    return out


def contexts(docs: DataFrame, members: DataFrame, units: Callable[[np.ndarray, np.ndarray], Units], window: int) -> DataFrame:
    """The bytes of the units around each member (ROW, CLASS, at, lo, hi), from
    its first window's start to its last window's end."""
    wanted = members.groupBy(*ROW).agg(F.collect_list(F.struct(*CLASS, "at", "lo", "hi")).alias("list"))
    texts = docs.where(F.col("text").isNotNull()).select(*row_key("text"), "text")
    joined = texts.join(wanted.hint("merge"), ROW).select(*ROW, "list", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            data, at = text_bytes(batch.column(4))
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for row, name in enumerate(names):
                if name == seen:  # rows that repeat come one after the other: one speaks for all
                    continue
                seen = name
                cells = batch.column(3)[row].values
                key, span, span2, spot, lo, hi = (cells.field(k).to_numpy() for k in range(6))
                part = units(data[at[row] : at[row + 1]], np.array([0, at[row + 1] - at[row]]), False)
                for k in range(0, len(key), 8192):
                    s = slice(k, k + 8192)
                    whole = np.zeros(len(key[s]), np.int32)
                    cut = list(part.between((spot - lo)[s], (spot - hi + window)[s]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x.tobytes() for x in key[s]], pa.binary()), pa.array(whole - np.int32(2**30)), pa.array(whole), pa.array(key[s]), pa.array(span[s]), pa.array(span2[s]),
                        pa.array(np.full(len(whole), name[0], np.int64)), pa.array(lo[s]), pa.array(hi[s]), pa.array(cut, pa.binary()),
                    ], CONTEXT_NAMES)

    return map_arrow(joined, run, CONTEXT)


def byte_part(units: bytes, start: int, end: int) -> bytes:
    return units[start:end]


def word_part(units: bytes, start: int, end: int) -> bytes:
    return b" ".join(units.split(b" ")[start:end])


def halves(window: int, gram: int, part: Callable[[bytes, int, int], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Splits the rows of large buckets: each bucket's range of window starts is
    halved, and a row goes to the halves that it has starts in, under 128 bits of
    the units that all windows of the half share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bucket, low, high = [], [], [], []
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(CONTEXT_NAMES))]
            for r, (_, a, b, key, _, _, _, lo, hi, units) in enumerate(zip(*columns)):
                a = max(int(a), gram - window)
                mid = (a + int(b)) // 2
                for x, y in ((a, mid), (mid + 1, int(b))):
                    if -lo <= y and x <= -hi:
                        rows.append(r)
                        bucket.append(xxhash.xxh3_128_digest(part(units, lo + y, lo + x + window), (int(key) * 31 + x * 1031 + y) & (2**64 - 1)))
                        low.append(x)
                        high.append(y)
            take = pa.array(rows, pa.int64())
            fixed = [pa.array(bucket, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
            yield pa.RecordBatch.from_arrays([*fixed, *[batch.column(k).take(take) for k in range(3, len(CONTEXT_NAMES))]], CONTEXT_NAMES)

    return run


def resolve(rows: DataFrame, compare: Callable, window: int, gram: int, part: Callable[[bytes, int, int], bytes], most: int, every: bool) -> DataFrame:
    """What `compare` finds in each bucket of contexts, staged; buckets with more
    than `most` rows are halved until they fit, so that no task holds a large one.
    In a bucket of one window start all rows are the same window: found at once,
    for all rows if `every`, else for those not of the least doc."""
    found, read = [], []
    while True:
        level = stage(rows, "contexts")
        sizes = stage(level.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc").alias("least")).where("n > 1"), "buckets")
        read += [level, sizes]
        sized = level.join(sizes.hint("merge"), "bucket")
        ready = sized.where(F.col("n") <= most).select(*CONTEXT_NAMES)
        found.append(map_arrow(ready.repartition("bucket").sortWithinPartitions("bucket"), compare, FOUND))
        if sizes.where(F.col("n") > most).isEmpty():
            break
        large = sized.where(F.col("n") > most)
        single = large.where("first_start = last_start")
        if not every:
            single = single.where("doc > least")
        found.append(single.select(*FOUND_NAMES))
        rows = map_arrow(large.where("first_start < last_start").select(*CONTEXT_NAMES), halves(window, gram, part), CONTEXT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = stage(out.distinct(), "found")
    for table in read:
        drop_stage(table)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole buckets, some `rows` at a time, from batches sorted by bucket."""
    held, n = [], 0
    for group in runs(batches, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns]):
        held.append(group)
        n += len(group[0])
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def found_rows(columns: list[np.ndarray], found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """(row, from, to) as FOUND; columns are key, span, span2 and doc."""
    row = np.array([r for r, _, _ in found], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[row]) for x in columns] + [pa.array([x[k] for x in found], pa.int32()) for k in (1, 2)], FOUND_NAMES)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges joined, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end


def ranges_of(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray]:
    cell = column[row].values
    if cell is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(cell.field(0).to_numpy().astype(np.int64), cell.field(1).to_numpy().astype(np.int64))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs, under the names c0, c1 and so on, so that none can clash, and last
    `ranges`: (ROW, start, stop) gathered by document."""
    lists = ranges.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.select(*row_key("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    return own.join(lists.hint("merge"), ROW, "left").select(*names, "ranges")
