"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_arrow, mix, one_by_one, slices, stage, text_bytes
from quantloom.llm.toxicity import tokens

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
SMOOTHING = 0.5
BINS, FEW = 1_024, 4_096
SEED = 5


def features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the single tokens and token pairs of rows end to end, and len +
    1 offsets of the rows into them."""
    levels, bounds = tokens(data, at)
    word = levels[-1]
    row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    inner = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:] * np.uint64(5))[inner]
    h = np.concatenate([word, pair])
    owner = np.concatenate([row, row[1:][inner]])
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(at)))


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: a table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for a, b in slices(at):
                total += np.bincount(features(data[at[a] : at[b]], at[a : b + 1] - at[a], buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets)
    for r in map_arrow(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of each bucket's probability in the target over that in the raw text."""
    a, b = target + SMOOTHING, raw + SMOOTHING
    return np.log(a / a.sum()) - np.log(b / b.sum())


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, draw, tie: the log importance of each whole text, and
    that plus Gumbel noise of the row's own: from a hash of its id and text and of
    its turn among rows alike in both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            out = []
            for a, b in slices(at):
                bucket, bounds = features(data[at[a] : at[b]], at[a : b + 1] - at[a], len(ratio))
                # each row by itself: what stands in front of it in a batch leaves no trace
                total = np.zeros(len(bounds) - 1)
                some = np.diff(bounds) > 0
                if some.any():
                    total[some] = np.add.reduceat(ratio[bucket], bounds[:-1][some])
                out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0)), batch.column(2)], ["doc_id", "log_weight", "row"])

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = map_arrow(hashed, run, f"doc_id {dict(docs.dtypes)['doc_id']}, log_weight double, row long")
    each = one_by_one(found.withColumn("log_weight", F.round("log_weight", 9)), ["doc_id", "log_weight", "row"])
    uniform = (F.pmod(F.xxhash64("row", "turn", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = -F.log(-F.log(uniform))
    return each.select("doc_id", "log_weight", (F.col("log_weight") + noise).alias("draw"), F.xxhash64("row", "turn").alias("tie"))


def top(drawn: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest (draw, tie) for k of 1 or more: bins are counted and the
    one that holds it is divided again, until few rows are left to order. None:
    all are within k."""
    ends = drawn.agg(F.count("*").alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high")).first()
    if k >= ends["n"]:
        return None
    low, high, left = ends["low"], ends["high"], k
    rows, n = drawn, ends["n"]
    while n > FEW and high > low:
        width = (high - low) / BINS
        if low + width == low:
            break
        place = F.least(F.floor((F.col("draw") - low) / width), F.lit(BINS - 1))
        counted = {r["bin"]: r["n"] for r in rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).collect()}
        if len(counted) == 1:
            break
        for at in sorted(counted, reverse=True):
            if counted[at] >= left:
                break
            left -= counted[at]
        rows = rows.where(place == at)
        ends = rows.agg(F.min("draw").alias("low"), F.max("draw").alias("high")).first()
        low, high, n = ends["low"], ends["high"], counted[at]
    last = rows.orderBy(F.desc("draw"), F.desc("tie")).limit(left).agg(F.min(F.struct("draw", "tie")).alias("e")).first()["e"]
    return last["draw"], last["tie"]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, log_weight, draw, kept: every document, and whether it is drawn.

    The target model is fitted on at most sample_docs documents labelled quality
    1, by a hash of doc_id; the raw model on all documents. A document's weight
    is the ratio of the models over its single tokens and pairs, and the share of
    documents with the greatest weight plus Gumbel noise is kept, which draws
    without replacement in proportion to the weights. share: that of quality 1
    among the labels, if not given; a share of 0 keeps none. Ties fall to a hash
    of the row. Null and empty texts have log weight 0. No label: all ratios are 1
    and all documents are kept. Rows that repeat, also those without an id, are
    drawn each, with noise of their own. Very long texts are read whole, in
    slices. An empty table gives no rows. Other columns are ignored.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if share is None:
        share = own.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    share = 1.0 if share is None else share
    good = own.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("doc_id")
    target = bucket_counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi"), buckets)
    raw = bucket_counts(docs, buckets)
    ratio = log_ratio(target, raw) if target.any() else np.zeros(buckets)
    drawn = stage(weights(docs, ratio), "draws")
    most = int(round(share * drawn.count()))
    if most < 1:
        return drawn.select("doc_id", "log_weight", "draw", F.lit(False).alias("kept"))
    last = top(drawn, most)
    kept = F.lit(True) if last is None else (F.col("draw") > F.lit(last[0])) | ((F.col("draw") == F.lit(last[0])) & (F.col("tie") >= F.lit(last[1])))
    return drawn.select("doc_id", "log_weight", "draw", kept.alias("kept"))
