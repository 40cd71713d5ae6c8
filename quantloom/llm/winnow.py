"""Winnowed anchors of texts taken as sequences of units (bytes or words).

Every window of `window` units is represented by one anchor: of the grams of
`gram` units that it holds, the one with the least hash, the first of equals.
The choice depends on the window's content alone, so equal windows have equal
anchors at the same place. An anchor stands for a range of window starts.

Running hashes choose the anchors and no more: which strings are equal is told
by 128 bits of their bytes, or by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from quantloom.llm.common import keep, mix, slices, text_bytes, word_bounds

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)
STEP = 1 << 18
PLACE = np.uint64((1 << 21) - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    forward, inverse = keep(f"winnow:{size}", lambda: [power_table(b, size) for b in (BASE, INVERSE)])
    return forward[:n], inverse[:n]


def power_table(base: int, size: int) -> np.ndarray:
    table = np.full(size, base, np.uint64)
    table[0] = 1
    return np.cumprod(table)


class Hashes:
    """Hashes of any stretch of units, from running sums."""

    def __init__(self, units: np.ndarray):
        power, self.inverse = powers(len(units) + 1)
        self.total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Units:
    """The units of rows laid end to end: a value to choose anchors by, len + 1
    offsets of the rows, and where each unit starts in the bytes of all."""

    value: np.ndarray
    bounds: np.ndarray
    line: bytes
    place: np.ndarray  # of each unit and of the end
    gap: int  # bytes between units

    def between(self, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """The bytes of stretches of units."""
        line, gap = self.line, self.gap
        return (line[a : b - gap] for a, b in zip(self.place[start].tolist(), self.place[end].tolist()))


def byte_units(data: np.ndarray, at: np.ndarray, values: bool = True) -> Units:
    return Units(TABLE[data] if values else data, at, data.tobytes(), np.arange(len(data) + 1), 0)


def word_units(data: np.ndarray, at: np.ndarray, values: bool = True) -> Units:
    """Words joined by one space."""
    start, end, bounds = word_bounds(data, at)
    whole = data.tobytes()
    rows = [b" ".join(whole[a:b].split()) for a, b in zip(at.tolist(), at[1:].tolist())]
    place = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start + 1)])
    return Units(Hashes(TABLE[data]).of(start, end) if values else start, bounds, b" ".join(r for r in rows if r), place, 1)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(units: Units, window: int, gram: int, spans: bool) -> Iterator[dict[str, np.ndarray]]:
    """doc (row), key (of the gram), at (the anchor, in units from the row's
    start), lo, hi (first and last window start, from the anchor backwards) and,
    if asked for, span: 128 bits of the bytes of all the anchor's windows and of
    their place."""
    value, at = units.value, units.bounds
    if len(value) < window:
        return
    hashes = Hashes(value)
    width = window - gram + 1
    room = np.repeat(at[1:], np.diff(at)) - window  # the last window start in the row
    first = np.repeat(at[:-1], np.diff(at))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a in range(0, len(value) - window + 1, STEP):
        b = min(a + STEP, len(value) - window + 1)  # window starts
        grams = np.arange(a, b + width - 1)
        core = hashes.of(grams, grams + gram)
        packed = (core & ~PLACE) | (grams - a).astype(np.uint64)
        chosen = (least(packed, width) & PLACE).astype(np.int64) + a
        start = np.arange(a, b)
        valid = start <= room[a:b]
        start, chosen = start[valid], chosen[valid]
        if not len(start):
            continue
        turn = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[start[1:]] != row[start[:-1]])]))
        last = np.append(turn[1:], len(start)) - 1
        low, high, x = start[turn], start[last], chosen[turn]
        found = {"doc": row[x], "key": core[x - a], "at": x - first[x], "lo": x - low, "hi": x - high}
        if spans:
            shape = ((x - low) << 20 | (high - low)).tolist()
            digest = xxhash.xxh3_128_digest
            raw = b"".join([digest(part, s) for part, s in zip(units.between(low, high + window), shape)])
            found["span"] = np.frombuffer(raw, np.int64).reshape(-1, 2)
        yield found


def scan(batches: Iterator[pa.RecordBatch], units, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """doc, text_hash, tail, key, span, span2, at, lo, hi of batches of (doc, text_hash, tail, text)."""
    for batch in batches:
        data, at = text_bytes(batch.column(3))
        for a, b in slices(at, 1 << 20):
            for x in anchors(units(data[at[a] : at[b]], at[a : b + 1] - at[a]), window, gram, True):
                rows = pa.array(x["doc"] + a)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).take(rows) for k in range(3)], pa.array(x["key"].view(np.int64)), pa.array(x["span"][:, 0].copy()), pa.array(x["span"][:, 1].copy()),
                    *[pa.array(x[c].astype(np.int32)) for c in ("at", "lo", "hi")],
                ], ["doc", "text_hash", "tail", "key", "span", "span2", "at", "lo", "hi"])


def grams(batches: Iterator[pa.RecordBatch], units, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """key, doc: the grams of the anchors of batches of (doc, text)."""
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        for a, b in slices(at, 1 << 20):
            for x in anchors(units(data[at[a] : at[b]], at[a : b + 1] - at[a]), window, gram, False):
                yield pa.RecordBatch.from_arrays([pa.array(x["key"].view(np.int64)), batch.column(0).take(pa.array(x["doc"] + a))], ["key", "doc"])
