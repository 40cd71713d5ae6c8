"""Document fingerprints of improbable features: rare byte windows in chained
Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import drop_stage, map_arrow, mix, stage, text_bytes

WINDOW = 32  # bytes of a feature
REACH = 32  # features in a row of which the rarest gets a vote
VOTES = 8  # that select a feature
LEVELS = 1000  # of entropy, from 0 to the most that a window can have
LEAST_LEVEL = 100  # windows of nearly one byte over and over say nothing
BITS, PROBES, FULL = 2048, 5, 160  # of a Bloom filter; features that it takes
BLOCK = 1 << 18  # bytes that are looked at together
NOISE = 3.0  # standard deviations of chance overlap that count as none
FAR = np.int64(1) << 62
ROWS_PER_PART = 1 << 16  # at most, on average, of the sorted documents

#: c log2 c for the counts of a byte in a window, in whole units: exact sums
UNIT = 1 << 20
_N = np.arange(WINDOW + 1)
PART = np.round(_N * np.log2(np.maximum(_N, 1)) * UNIT).astype(np.int64)


def same_near(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte stands among the WINDOW bytes that end with it, and
    among those that begin with it."""
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, min(WINDOW, len(data))):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    return before, after


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of the bytes, as a level from 0 to LEVELS.

    From one window to the next one byte goes and one comes, so the sum of
    c log c changes by two known steps: no window is counted anew.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    comes, goes = same_near(data)
    step = PART[1:] - PART[:-1]
    total = np.empty(n, np.int64)
    total[0] = PART[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = step[comes[WINDOW:] - 1] - step[goes[: n - 1] - 1]
    np.cumsum(total, out=total)
    # entropy is log2 W - total / W, its most log2 W
    return LEVELS - total * LEVELS // PART[WINDOW]


def rows_of(at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the row of each byte from low to high."""
    row = np.searchsorted(at, np.arange(low, high), "right") - 1
    return at[row], at[row + 1]


def level_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of each level, within the rows."""
    counts = np.zeros(LEVELS + 1, np.int64)
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK + WINDOW - 1, len(data))
        found = levels(data[a:b])
        _, end = rows_of(at, a, a + len(found))
        counts += np.bincount(found[np.arange(a, a + len(found)) + WINDOW <= end], minlength=LEVELS + 1)
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: the fewer windows have it, the smaller; none (-1)
    under LEAST_LEVEL."""
    order = np.lexsort((np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    out[:LEAST_LEVEL] = -1
    return out


def selected(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the selected features of rows laid end to end start.

    Each run of REACH features in a row votes for its rarest, the leftmost of
    equals; VOTES of them select it, or a quarter of the runs where a row has
    few. Blocks overlap by what a vote can see, so a row of any length takes the
    memory of a block.
    """
    found = []
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        low, high = max(0, a - REACH + 1), min(len(data), b + REACH + WINDOW - 2)
        level = levels(data[low:high])
        if not len(level):
            continue
        spot = np.arange(low, low + len(level))
        begin, end = rows_of(at, low, low + len(level))
        rarity = rank[level]
        fit = (spot + WINDOW <= end) & (rarity >= 0)
        key = np.where(fit, (rarity << 40) + np.arange(len(level)), FAR)
        reach = 1
        # fewer features than a run: each sees as far as there are some
        while reach < min(REACH, len(key)):
            key[: len(key) - reach] = np.minimum(key[: len(key) - reach], key[reach:])
            reach *= 2
        # a run lies in one row; a row of fewer features has one run, from its start
        runs = np.maximum(end - begin - WINDOW - REACH + 2, 1)
        starts = spot < begin + runs
        # in the key of a short row's run are features of later rows: counted out
        short = (spot == begin) & (spot < b) & (end - begin < WINDOW + REACH - 1)
        for s in np.flatnonzero(short).tolist():
            own = slice(s, max(s, int(end[s]) - WINDOW + 1 - low))
            best = np.where(fit[own], (rarity[own] << 40) + np.arange(own.start, own.stop), FAR)
            key[s] = best.min() if len(best) else FAR
        votes = np.bincount(key[starts & (key < FAR)] & ((1 << 40) - 1), minlength=len(level))
        enough = np.minimum(VOTES, (runs + 3) // 4)
        take = (votes >= enough) & (votes > 0) & (spot >= a) & (spot < b)
        found.append(spot[take])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def feature_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each feature's bytes."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), BLOCK):
        some = starts[a : a + BLOCK]
        words = data[some[:, None] + np.arange(WINDOW)].view("<u8")
        h = np.zeros(len(some), np.uint64)
        for j in range(words.shape[1]):
            h = mix(h ^ words[:, j]) + np.uint64(j + 1)
        out[a : a + BLOCK] = h
    return out


@dataclass
class Digest:
    """A chain of Bloom filters, FULL features each but for the last."""

    features: int
    filters: np.ndarray  # (filters, BITS / 64) unsigned

    def text(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def read(cls, text: str) -> "Digest":
        n, rest = text.split(":")
        return cls(int(n), np.frombuffer(base64.b64decode(rest), "<u8").reshape(-1, BITS // 64))


def digest(hashes: np.ndarray) -> Digest:
    """Filters over features in their order in the text."""
    n = -(-len(hashes) // FULL)
    bits = np.zeros((n, BITS), bool)
    which = np.arange(len(hashes)) // FULL
    for k in range(PROBES):
        bits[which, ((hashes >> np.uint64(k * 11)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return Digest(len(hashes), np.packbits(bits, axis=1, bitorder="little").view("<u8"))


def digests(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> list[Digest]:
    """The digest of each row of bytes laid end to end. A row that isn't empty and
    has no feature is one feature as a whole."""
    starts = selected(data, at, rank)
    hashes = feature_hashes(data, starts)
    cut = np.searchsorted(starts, at)
    out = []
    for r, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
        own = hashes[a:b]
        if a == b and at[r + 1] > at[r]:
            own = np.frombuffer(hashlib.blake2b(data[at[r] : at[r + 1]].tobytes(), digest_size=8).digest(), "<u8")
        out.append(digest(own))
    return out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each filter of a, the most of its normalised overlap with one of b: the
    bits in common, less those that chance has in common, over the most that could be."""
    best = np.zeros(len(a))
    of_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    for x in range(len(a)):
        for y in range(0, len(b), 4096):
            common = np.bitwise_count(a[x] & b[y : y + 4096]).sum(1, dtype=np.int64)
            own, other = int(np.bitwise_count(a[x]).sum()), of_b[y : y + 4096]
            most, chance = np.minimum(own, other), own * other / BITS
            share = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), common == most)
            best[x] = max(best[x], float(np.where((common > chance + NOISE * np.sqrt(chance)) | (common == most), share, 0.0).max()))
    return best


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: how much of the one with fewer features is in the other. The mean
    over its filters, by their features, of their best overlap; of two with as
    many features the larger of both ways. Two empty ones are alike."""
    if a.features > b.features:
        a, b = b, a
    if not a.features:
        return float(not b.features)
    weight = np.full(len(a.filters), FULL)
    weight[-1] = a.features - FULL * (len(a.filters) - 1)
    one = float((overlaps(a.filters, b.filters) * weight).sum() / weight.sum())
    if a.features == b.features and one < 1:
        one = max(one, float((overlaps(b.filters, a.filters) * weight).sum() / weight.sum()))
    return min(1.0, max(0.0, one))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy level, from the windows of all texts. A task gives
    one row a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            counts += level_counts(*text_bytes(batch.column(0)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in map_arrow(docs.select(text), run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return ranks(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of each whole text, under ranks that `rarity` gave. Rows
    that repeat are returned each; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digests(*text_bytes(batch.column(1)), rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.text() for d in found], pa.string())], [key, "fingerprint"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, fingerprint string")


def head(text: bytes, points: int) -> int:
    """Bytes of the first code points of a text, all if it has fewer."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(text) if points >= len(starts) else int(starts[points])


def points(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def edited(text: bytes, following: bytes) -> bytes:
    """The text with its last half, rounded down, replaced by as many first code
    points of the one that follows."""
    n = points(text)
    return text[: head(text, n - n // 2)] + following[: head(following, n // 2)]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(pairs: list[tuple[object, bytes, Digest, bytes, Digest]], rank: np.ndarray) -> list[tuple]:
    """A row of COLUMNS for each (doc_id, text, digest, next text, next digest)."""
    texts = [edited(text, following) for _, text, _, following, _ in pairs]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    own = digests(np.frombuffer(b"".join(texts), np.uint8), at, rank)
    return [
        (doc, points(text), hashlib.sha256(new).hexdigest(), d.text(), e.text(), likeness(d, e), likeness(d, next_d))
        for (doc, text, d, _, next_d), new, e in zip(pairs, texts, own)
    ]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def compare_next(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next: the fingerprint of each whole text, of the same text edited with the
    next document, and its likeness to that and to the next document's own.

    Features are windows of WINDOW bytes; those whose entropy is rarest among all
    windows of all texts are selected and inserted into a chain of Bloom filters;
    likeness is the normalised overlap of bits. One pass counts entropies. The
    documents are then sorted by ranges of doc_id, as many as the session has
    shuffle partitions or more, of about rows_per_part at most, and each task walks its part with one document held back; the last of each part
    meets the first of the next by a join of one row a part.

    Null texts count as empty. A null doc_id comes last; rows that share a doc_id
    follow each other by a hash of their texts, and equal rows in any order. A single document is its own next. Very long texts are read whole,
    a block at a time. Equal texts have equal fingerprints. An empty table gives no
    rows; other columns are ignored.
    """
    rank = rarity(docs)
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.monotonically_increasing_id().alias("turn"))
    order = ["last", "id", "hash", "turn"]
    keyed = own.select("id", "body", F.col("id").isNull().alias("last"), F.xxhash64("body").alias("hash"), "turn")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_per_part + 1)
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = ranged.select("id", "body", F.spark_partition_id().alias("part"))
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    edge = f"{result}, part int, first binary, last binary"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, whose next is still to come
        part, schema = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                schema = pa.schema([pa.field("doc_id", batch.column(0).type), *[pa.field(c, t) for c, t in zip(COLUMNS[1:], TYPES)], pa.field("part", pa.int32()), pa.field("first", pa.binary()), pa.field("last", pa.binary())])
                part = batch.column(2)[0].as_py()
            data, at = text_bytes(batch.column(1))
            prints = digests(data, at, rank)
            whole, ends = data.tobytes(), at.tolist()
            rows = [(i, whole[a:b], d) for i, a, b, d in zip(batch.column(0).to_pylist(), ends, ends[1:], prints)]
            if held is None:  # the first row of the part, for the part before
                yield batch_of([(rows[0][0], None, None, rows[0][2].text(), None, None, None, part, rows[0][1], None)], schema)
            else:
                rows = [held, *rows]
            held = rows[-1]
            pairs = [(*x, *y[1:]) for x, y in zip(rows, rows[1:])]
            if pairs:
                yield batch_of([(*r, part, None, None) for r in compared(pairs, rank)], schema)
        if held is not None:
            yield batch_of([(held[0], None, None, held[2].text(), None, None, None, part, None, held[1])], schema)

    walked = stage(map_arrow(dealt, walk, edge), "walked")
    ends = sorted(r["part"] for r in walked.where("last is not null").select("part").collect())  # a number a part
    follows = docs.sparkSession.createDataFrame(list(zip(ends, ends[1:] + ends[:1])), "part int, following int")
    tails = walked.where("last is not null").join(F.broadcast(follows), "part").select("doc_id", F.col("last").alias("body"), "fingerprint", "following")
    heads = walked.where("first is not null").select(F.col("part").alias("following"), F.col("first").alias("next_body"), F.col("fingerprint").alias("next_fingerprint"))
    seams = tails.join(heads, "following").select("doc_id", "body", "fingerprint", "next_body", "next_fingerprint")

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field("doc_id", batch.column(0).type), *[pa.field(c, t) for c, t in zip(COLUMNS[1:], TYPES)]])
            for r in range(batch.num_rows):
                doc, text, d, following, next_d = (c[r].as_py() for c in batch.columns)
                yield batch_of(compared([(doc, text, Digest.read(d), following, Digest.read(next_d))], rank), schema)

    return walked.where("first is null and last is null").select(COLUMNS).unionByName(map_arrow(seams, seam, result))


TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
