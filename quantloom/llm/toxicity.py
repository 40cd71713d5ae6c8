"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_arrow, mix, slices, stage, text_bytes
from quantloom.llm.winnow import TABLE, Hashes

SAMPLE_DOCS = 24_000
FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 6)  # bytes; a word's prior is its longer prefix's posterior, and so on
PRIOR_DOCS = 5.0
LEAST_DOCS = 4
LEAST_Z = 3.5
GAP = 0.05  # what a token without evidence takes off a passage
KARLIN_K = 0.1
SIGNIFICANT = 0.05
THRESHOLD = 0.7

PART = np.zeros(256, bool)
PART[0x80:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    PART[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the tokens (runs of letters and digits, A-Z in lower case) of
    rows end to end, by prefix and whole, 0 where a token is no longer than the
    prefix; and len + 1 offsets of the rows into them."""
    inside = np.concatenate([[False], PART[data], [False]])
    first = np.zeros(len(data) + 2, bool)
    first[at + 1] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[1:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[2:])) + 1
    hashes = Hashes(TABLE[LOWER[data]])
    out = []
    for k, prefix in enumerate(PREFIXES):
        long = end - start > prefix
        h = hashes.of(start, np.where(long, start + prefix, end))
        out.append(np.where(long, mix(h + np.uint64(k + 1)), np.uint64(0)))
    out.append(hashes.of(start, end))
    return out, np.searchsorted(start, at)


@dataclass
class Model:
    """Scores by token hash, one sorted table a level, and the calibration."""

    keys: list[np.ndarray]
    scores: list[np.ndarray]
    decay: float
    intercept: float
    slope: float

    def score(self, levels: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(levels[-1]), -GAP)
        for h, keys, scores in zip(levels, self.keys, self.scores):  # from the shortest prefix to the word
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out = np.where(keys[at] == h, scores[at], out)
        return out


def passages(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one row, in linear
    time: each is a segment that no extension or part of beats.

    Candidates are kept with their left and right cumulative sums and with the
    place of the nearest candidate before them that has a smaller left sum, so
    that a search passes over no candidate twice.
    """
    total = np.concatenate([[0.0], np.cumsum(score)]).tolist()
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lower: list[int] = []
    for i in np.flatnonzero(score > 0).tolist():
        s, l, r = i, total[i], total[i + 1]
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            s, l, above = start[j], left[j], lower[j]
            for x in (start, end, left, right, lower):
                del x[j:]
            j = above
        for x, v in ((start, s), (end, i + 1), (left, l), (right, r), (lower, j)):
            x.append(v)
    return [(a, b, r - l) for a, b, l, r in zip(start, end, left, right)]


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
    """The significant passages (start, end, score, nats): by the extreme-value
    law, chance gives one of this score in K n exp(-decay score) texts of n tokens."""
    base = math.log(KARLIN_K * max(n, 1))
    worth = ((a, b, s, model.decay * s - base) for a, b, s in found)
    return [(a, b, s, w) for a, b, s, w in worth if w > -math.log(SIGNIFICANT)]


def probability(model: Model, total: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, model.intercept + model.slope * math.log1p(total)))))


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, text, toxic, fit of at most size labelled documents outside the
    held-out fold, by a hash of doc_id; of near copies (equal least 4-token hash)
    one for each label. fit: half learn the tokens, half the calibration."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            least = []
            for a, b in zip(at, at[1:]):
                h = tokens(data[a:b], np.array([0, b - a]))[0][-1]
                grams = mix(h[:-3] + np.uint64(3) * h[1:-2] + np.uint64(5) * h[2:-1] + np.uint64(7) * h[3:]) if len(h) > 3 else h
                least.append(int(grams.min().view(np.int64)) if len(grams) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "sketch"])

    sketched = stage(map_arrow(texts.select("doc_id", "text", F.col("toxic").cast("int")), sketch, f"doc_id {dict(texts.dtypes)['doc_id']}, text string, toxic int, sketch long"), "labelled")
    one = sketched.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    half = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("fit")
    return stage(sketched.join(F.broadcast(one), ["sketch", "toxic", "doc_id"]).select("doc_id", "text", "toxic", half), "sample")


def token_scores(rows: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log-odds of each level's tokens under a Dirichlet prior centred on the
    level above, for those with LEAST_Z standard deviations of evidence."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            levels, bounds = tokens(data, at)
            row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
            up = [np.zeros(len(row), np.uint64), *levels[:-1]]
            # the nearest level above that exists
            for k in range(1, len(up)):
                up[k] = np.where(up[k] == 0, up[k - 1], up[k])
            for level, (h, parent) in enumerate(zip(levels, up)):
                some = h != 0
                order = np.lexsort((row[some], h[some]))
                hh, rr, pp = h[some][order], row[some][order], parent[some][order]
                new = np.ones(len(hh), bool)
                new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
                hh, rr, pp = hh[new], rr[new], pp[new]
                edge = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]])) if len(hh) else np.zeros(0, np.int64)
                if len(edge):
                    bad = np.add.reduceat(toxic[rr].astype(np.int64), edge)
                    every = np.diff(np.append(edge, len(hh)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), level, np.int32)), pa.array(hh[edge].view(np.int64)), pa.array(pp[edge].view(np.int64)), pa.array(bad), pa.array(every - bad)], ["level", "token", "parent", "toxic", "clean"])

    counted = map_arrow(rows.select("text", "toxic"), count, "level int, token long, parent long, toxic long, clean long")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, clean = totals.get(1, 0), totals.get(0, 0)
    base = math.log((bad + 0.5) / (clean + 0.5))
    kept = counted.groupBy("level", "token").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCS).collect()
    odds: dict[int, float] = {}
    keys, scores = [], []
    for level in range(len(PREFIXES) + 1):
        table = []
        for r in (r for r in kept if r["level"] == level):
            rate = 1.0 / (1.0 + math.exp(-(base + odds.get(r["parent"], 0.0))))
            a, b = r["toxic"] + PRIOR_DOCS * rate, r["clean"] + PRIOR_DOCS * (1.0 - rate)
            own = math.log(a / b) - base
            odds[r["token"]] = own
            if own > 0 and own / math.sqrt(1.0 / a + 1.0 / b) >= LEAST_Z:
                table.append((np.int64(r["token"]).view(np.uint64), own))
            elif odds.get(r["parent"], 0.0) > 0:
                table.append((np.int64(r["token"]).view(np.uint64), min(own, odds[r["parent"]]) if own > 0 else -GAP))
        table.sort()
        keys.append(np.array([k for k, _ in table], np.uint64))
        scores.append(np.array([s for _, s in table], float))
    return keys, scores


def decay_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight exp(decay value)) = 1: the rate at which
    the chance of a segment falls with its score in texts that aren't toxic."""
    share = weights / weights.sum()
    if not (values > 0).any() or share @ values >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    excess = lambda x: float(share @ np.exp(np.minimum(x * values, 700.0))) - 1.0
    while excess(high) < 0 and high < 8.0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return min(high, 8.0)


def fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression, by Newton steps with a small ridge."""
    design = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.1 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model:
    """Learns from at most size labelled documents outside the held-out fold.

    Without a label, or with one kind only, scores are all the base rate.
    """
    rows = sample(docs, labels, size)
    keys, scores = token_scores(rows.where("fit"))
    model = Model(keys, scores, 1.0, 0.0, 0.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            value, n = np.unique(model_scores(model, data, at)[0].round(6), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["value", "n"])

    rest = rows.where("not fit")
    spread_rows = map_arrow(rest.where("toxic = 0").select("text"), spread, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    if spread_rows:
        model.decay = decay_of(np.array([r["value"] for r in spread_rows]), np.array([r["n"] for r in spread_rows], float))
    found = scored(rest, model, ["toxic"]).select("toxic", "evidence").collect()
    y = np.array([r["toxic"] for r in found], float)
    model.intercept, model.slope = fit_line(np.log1p([r["evidence"] for r in found]), y) if len(y) else (-2.0, 0.0)
    return model


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """carry, evidence, score: a row a document, one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(len(carry)))
            total = []
            for a, b in slices(at):
                values, bounds = model_scores(model, data[at[a] : at[b]], at[a : b + 1] - at[a])
                hot = np.add.reduceat(np.append(values > 0, False), np.minimum(bounds[:-1], len(values))) if len(bounds) > 1 else np.zeros(0)
                for r, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    total.append(sum(w for *_, w in evidence(model, y - x, passages(values[x:y]))) if y > x and hot[r] else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(total, pa.float64()), pa.array([probability(model, t) for t in total], pa.float64())], [*carry, "evidence", "score"])

    kinds = dict(docs.dtypes)
    return map_arrow(docs.select(*carry, "text"), run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", evidence double, score double")


def model_scores(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token scores of rows end to end. A token's k-th occurrence in a row brings
    a k-th of its score, so that a text can't be toxic by saying one word often."""
    levels, bounds = tokens(data, at)
    score = model.score(levels)
    hot = np.flatnonzero(score > 0)
    row = np.searchsorted(bounds, hot, "right")
    order = np.lexsort((hot, levels[-1][hot], row))
    row, word = row[order], levels[-1][hot][order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    place = np.arange(len(order))
    turn = place - np.maximum.accumulate(np.where(new, place, 0)) + 1 if len(order) else place
    score[hot[order]] /= turn
    return score, bounds


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_token, last_token, score, nats: every significant toxic
    passage, by token numbers from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            rows = []
            for a, b in slices(at):
                values, bounds = model_scores(model, data[at[a] : at[b]], at[a : b + 1] - at[a])
                for r, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    rows += [(a + r, p, q - 1, s, w) for p, q, s, w in evidence(model, y - x, passages(values[x:y]))]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]], ["doc_id", "first_token", "last_token", "score", "nats"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, first_token long, last_token long, score double, nats double")


def held_out():
    """True for rows that no fit learns from; also where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every whole text.

    Null and empty texts have no evidence and get the score of that. Repeated
    rows are returned each. Very long texts are scored whole, in linear time. An
    empty table gives no rows; without usable labels all scores are the base
    rate. Other columns are ignored.
    """
    found = scored(docs.select("doc_id", "text"), fit(docs, labels, size), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
