"""Repeated byte strings removed, compared by column-wise construction of a
multi-document suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_arrow, stage, text_bytes, word_bounds
from quantloom.llm.repeats import CLASS, ROW, byte_part, contexts, found_rows, ranges_of, recurring, resolve, whole_groups, with_ranges
from quantloom.llm.winnow import TABLE, Hashes, Units, byte_units

LENGTH = 400
MOST_ROWS = 16_384
BATCH_ROWS = 4_096
OUTSIDE = 256


class Columns:
    """The suffix order of aligned documents, built a symbol a round.

    Round by round, from the last column to the first, one symbol of each
    document goes in front of its suffix. The new order is the old one sorted
    stably by the inserted symbol, within each group of documents; read in the
    old order, those symbols are the round's part of the Burrows-Wheeler
    transform. A suffix's common prefix with its new predecessor is one more
    than the least common prefix between their old places. Each round reads one
    column and the last round's order and prefixes, front to back. `transform`
    holds the transform's parts, the last round's first.
    """

    def __init__(self, group: np.ndarray):
        self.transform: list[np.ndarray] = []
        self.group = group.astype(np.int64)
        self.order = np.argsort(self.group, kind="stable")
        self.common = np.zeros(len(group), np.int64)

    def insert(self, symbol: np.ndarray) -> None:
        transform = symbol[self.order]
        self.transform.insert(0, transform)
        key = self.group[self.order] * (OUTSIDE + 1) + transform
        place = np.argsort(key, kind="stable")
        a, b = place[:-1], place[1:]
        same = (key[a] == key[b]) & (transform[b] != OUTSIDE)
        common = np.zeros(len(place), np.int64)
        near = np.flatnonzero(same & (b == a + 1))
        common[near + 1] = self.common[b[near]] + 1
        far = np.flatnonzero(same & (b != a + 1))
        if len(far):
            between = np.stack([a[far] + 1, b[far] + 1], axis=1).ravel()
            common[far + 1] = np.minimum.reduceat(np.append(self.common, 0), between)[::2] + 1
        self.order, self.common = self.order[place], common


def repeated_starts(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, units: np.ndarray, window: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, from, to): runs of window starts, relative to the anchor, whose
    window is also in another row of the same group."""
    left = window - gram
    n = len(group)
    table = np.full((n, left + window), OUTSIDE, np.int16)
    for r in range(n):
        piece = np.frombuffer(units[r], np.uint8)
        table[r, left - lo[r] : left - lo[r] + len(piece)] = piece
    columns = np.ascontiguousarray(table.T)
    del table
    low, high = np.maximum(-lo, first), np.minimum(-hi, last)
    used = np.flatnonzero((columns != OUTSIDE).any(1))
    build = Columns(group)
    hit = np.zeros((left + 1, n), bool)
    for c in range(int(used[-1]), int(used[0]) - 1, -1):
        build.insert(columns[c])
        if c <= left:
            long = np.flatnonzero(build.common >= window)
            hit[c, build.order[long]] = True
            hit[c, build.order[long - 1]] = True
    start = np.arange(-left, 1)[:, None]
    hit &= (start >= low) & (start <= high)
    flat = np.zeros((n, left + 3), np.int8)
    flat[:, 1 : left + 2] = hit.T
    edge = np.diff(flat, axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return list(zip(row.tolist(), (begin - left).tolist(), (end - 1 - left).tolist()))


def compare(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, first, last, key, span, span2, doc, lo, hi, units in whole_groups(batches, BATCH_ROWS):
            _, group = np.unique(bucket, return_inverse=True)
            yield found_rows([key, span, span2, doc], repeated_starts(group, lo, hi, first, last, units, window, gram))

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int | None = None, most_rows: int = MOST_ROWS, units: Callable[..., Units] = byte_units) -> DataFrame:
    """ROW, start, stop: byte ranges that together cover every string of
    `length` bytes that also starts anywhere else. units: what a text's bytes are,
    its own or others that stand for it.

    Anchors with equal surroundings are one class. Two members of each class of
    two or more, and the member of each other class, are compared with all
    classes of their gram by the column-wise construction, and what it finds for
    them holds for all of their class. gram: a quarter of the length, if not given.
    """
    gram = gram or max(1, length // 4)
    if not 0 < gram <= length < 1 << 20:
        raise ValueError("0 < gram <= length < 2^20")
    anchors = recurring(docs, units, length, gram, F.col("n") > 1)
    place = F.struct(*ROW, "at", "lo", "hi")
    classes = stage(anchors.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "classes")
    ends = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))
    # a gram recurs, so a class of one is not the only class of its gram
    members = classes.select(*CLASS, F.explode(ends).alias("one")).select(*CLASS, "one.*")
    found = resolve(contexts(docs, members, units, length), compare(length, gram), length, gram, byte_part, most_rows, every=True)
    all_of = anchors.join(found.drop("doc").distinct().hint("merge"), CLASS)
    return all_of.select(*ROW, (F.col("at") + F.col("first_start")).alias("start"), (F.col("at") + F.col("last_start") + length).alias("stop"))


def kept(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, stop, -1)
    return data[np.cumsum(inside[:-1]) == 0]


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row a document, of its
    whole text as UTF-8 bytes without every byte that a repeated string covers.

    Null and empty texts have 0 bytes. Rows that repeat are documents of their
    own, so their long strings are all repeated. Overlapping repeats count;
    matches never cross rows. Very long texts are taken whole, in blocks. An
    empty table gives no rows; columns other than doc_id and text are ignored.
    """
    joined = with_ranges(docs.select("doc_id", "text"), repeated_ranges(docs, **parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            rows = []
            for r in range(batch.num_rows):
                part = data[at[r] : at[r + 1]]
                start, stop = ranges_of(batch.column(2), r)
                rest = kept(part, start, stop)
                rows.append((len(part), len(part) - len(rest), len(start), hashlib.sha256(rest.tobytes()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, **parameters) -> DataFrame:
    """docs with text and n_chars rewritten: repeated strings cut out, all their
    occurrences, the first too.

    A character of which some bytes go, goes; null texts stay null and empty ones
    empty. Rows that repeat are documents of their own and lose their long
    strings. Other columns, of any names, stay. An empty table gives none.
    """
    joined = with_ranges(docs, repeated_ranges(docs.select("doc_id", "text"), **parameters))
    place = docs.columns.index("text")
    kinds = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(place))
            null = batch.column(place).is_null().to_pylist()
            texts = []
            for r in range(batch.num_rows):
                rest = kept(data[at[r] : at[r + 1]], *ranges_of(batch.column(batch.num_columns - 1), r))
                texts.append(None if null[r] else rest.tobytes().decode("utf-8", "ignore"))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = map_arrow(joined, run, kinds).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


CODE = 8  # bytes that stand for a word
LONG_WORD = 64


def word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word of rows laid end to end, and the rows' offsets into them."""
    start, end, bounds = word_bounds(data, at)
    codes = Hashes(TABLE[data]).of(start, end) ^ (end - start).astype(np.uint64)
    # a running product modulo 2^64 can be led astray by long words made for it
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        codes[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return codes.astype("<u8"), bounds


def code_units(data: np.ndarray, at: np.ndarray, values: bool = True) -> Units:
    """The words of the rows as CODE bytes each."""
    codes, bounds = word_codes(data, at)
    return byte_units(codes.view(np.uint8), bounds * CODE, values)


def remove_passages(docs: DataFrame, words: int, **parameters) -> DataFrame:
    """docs with text and n_chars rewritten: every word that a sequence of `words`
    words covers which also starts anywhere else, all its occurrences, the first
    too, is cut out together with the space behind it.

    The suffix order is built over texts whose words are CODE bytes each, so a
    passage counts by its words, however short they are and however they are
    spaced. Null texts stay null and empty ones empty; a text without a repeat
    stays as it is. Rows that repeat are documents of their own and lose their long
    passages. Very long texts are taken whole. Other columns, of any names, stay.
    An empty table gives none.
    """
    ranges = repeated_ranges(docs.select("doc_id", "text"), length=words * CODE, units=code_units, **parameters)
    joined = with_ranges(docs, ranges)
    place = docs.columns.index("text")
    kinds = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(place))
            found, texts = batch.column(batch.num_columns - 1), batch.column(place).to_pylist()
            for r in (r for r in range(batch.num_rows) if found[r].values is not None):
                part = data[at[r] : at[r + 1]]
                start, _, _ = word_bounds(part, np.array([0, len(part)]))
                first, last = ranges_of(found, r)
                first, last = -(-first // CODE), last // CODE
                whole = last > first
                edge = np.append(start, len(part))
                texts[r] = kept(part, edge[first[whole]], edge[last[whole]]).tobytes().decode("utf-8", "ignore")
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = map_arrow(joined, run, kinds).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
