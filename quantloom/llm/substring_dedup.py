"""Repeated word passages removed by seed and extend."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_arrow, stage, text_bytes
from quantloom.llm.repeats import CLASS, ROW, contexts, found_rows, ranges_of, recurring, resolve, whole_groups, with_ranges, word_part
from quantloom.llm.winnow import word_units

LENGTH = 13
GRAM = 4
MOST_ROWS = 4_096
BATCH_ROWS = 16_384


def numbered(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns have equal numbers."""
    out = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return out


def extended(bucket: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, units: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, from, to): runs of window starts, relative to the seed, whose window
    a row of the same bucket with a smaller doc has too.

    All seeds of the buckets are extended together, a word at a time to the left
    and to the right. Words and extensions are numbered, so that two have one
    number only if they are equal; a window is as many words left as its start
    says and the rest to the right.
    """
    left = length - gram
    n = len(bucket)
    table = np.zeros((n, left + length), np.int64)
    number: dict[bytes, int] = {}
    for r in range(n):
        piece = [number.setdefault(w, len(number) + 1) for w in units[r].split(b" ")]
        table[r, left - lo[r] : left - lo[r] + len(piece)] = piece
    to_left = [numbered(bucket)]
    for k in range(1, left + 1):
        to_left.append(numbered(to_left[-1], table[:, left - k]))
    to_right = [np.zeros(n, np.int64)]
    for k in range(length):
        to_right.append(numbered(to_right[-1], table[:, left + k]))
    hit = np.zeros((n, left + 3), np.int8)
    low, high = np.maximum(-lo, first), np.minimum(-hi, last)
    for k in range(left + 1):
        # a context also serves as a partner at starts that are not its own, as far as it reaches
        reach = np.flatnonzero((lo >= k) & (length - hi >= length - k))
        if not len(reach):
            continue
        same = numbered(to_left[k][reach], to_right[length - k][reach])
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[reach])
        own = (low[reach] <= -k) & (high[reach] >= -k)
        hit[reach, left - k + 1] = (least[same] < doc[reach]) & own
    edge = np.diff(hit, axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return list(zip(row.tolist(), (begin - left).tolist(), (end - 1 - left).tolist()))


def compare(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, first, last, key, span, span2, doc, lo, hi, units in whole_groups(batches, BATCH_ROWS):
            yield found_rows([key, span, span2, doc], extended(bucket, doc, lo, hi, first, last, units, length, gram))

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_rows: int = MOST_ROWS) -> DataFrame:
    """ROW, start, stop: word ranges that together cover every window of
    `length` words whose sequence also starts in a smaller document.

    Documents are joined on the hashes of winnowed anchors of `gram` words.
    Anchors with equal surroundings (128 bits of their bytes) are one class, all
    of which but the smallest document's are repeats. One anchor of each class is
    the seed that is extended both ways, word by word, against the other classes
    of its gram.
    """
    if not 0 < gram <= length < 1 << 20:
        raise ValueError("0 < gram <= length < 2^20")
    anchors = recurring(docs, word_units, length, gram, F.col("least") < F.col("most"))
    place = F.struct(*ROW, "at", "lo", "hi")
    classes = stage(anchors.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(place).alias("one")).select("*", F.col("one.doc").alias("first")), "classes")
    several = stage(classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("first").alias("least"), F.max("first").alias("most")).where("kinds > 1 and least < most").select("key"), "several")
    mixed = classes.join(several.hint("merge"), "key", "left_semi").select(*CLASS, "one.*")
    found = resolve(contexts(docs, mixed, word_units, length), compare(length, gram), length, gram, word_part, most_rows, every=False)
    later = anchors.join(classes.where("n > 1").select(*CLASS, "first").hint("merge"), CLASS).where("doc > first")
    # the smallest document may hold its class's surroundings more than once
    own = anchors.join(found.hint("merge"), [*CLASS, "doc"])
    return later.select(*ROW, (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("hi") + length).alias("stop")).unionByName(
        own.select(*ROW, (F.col("at") + F.col("first_start")).alias("start"), (F.col("at") + F.col("last_start") + length).alias("stop")))


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row a document, of its words
    without those that a repeated window covers, joined by one space.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r. Null and wordless
    texts have 0 words. Rows that share a doc_id are one document's: they are no
    repeats of each other. A null doc_id counts as the smallest. Very long texts are
    taken whole, in blocks. An empty table gives no rows; columns other than doc_id
    and text are ignored.
    """
    joined = with_ranges(docs.select("doc_id", "text"), repeated_ranges(docs, **parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            whole = data.tobytes()
            rows = []
            for r in range(batch.num_rows):
                words = whole[at[r] : at[r + 1]].split()
                rest: list[bytes] = []
                done = 0
                for a, b in zip(*(x.tolist() for x in ranges_of(batch.column(2), r))):
                    rest += words[done:a]
                    done = b
                rest += words[done:]
                rows.append((len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:2]], pa.array(columns[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(joined, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")
