"""Byte-level BPE by published ranks: encoding with a segment tree over byte
positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import keep, map_arrow, mix, slices, text_bytes

NONE = np.int64(1) << np.int64(62)
WIDE = 256
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3


class Ranks:
    """A rank file's tokens, and for each pair of tokens that joins to a token, its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.size = size
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (self.ranks[t[:i]] * size + self.ranks[t[i:]]): rank
            for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        }
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.pairs = pairs
        self.bytes_pool = Pool(tokens)
        self.text_pool = Pool([b"%d " % i for i in range(size)])
        self.seen = Seen()

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union, -1 where it is no token."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


class Seen:
    """Tokens of pieces that this worker has met, by the pieces' hash; emptied
    when it holds too many."""

    MOST = 1 << 18

    def __init__(self):
        self.hash = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def slots(self, h: np.ndarray, encode) -> np.ndarray:
        """The places of sorted distinct hashes; encode gives tokens and counts of those not yet met."""
        if len(self.hash) > self.MOST:
            self.__init__()
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == h[inside]
        out = np.empty(len(h), np.int64)
        out[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts = encode(new)
            out[new] = len(self.start) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.hash = np.insert(self.hash, at[new], h[new])
            self.slot = np.insert(self.slot, at[new], out[new])
        return out


class Pool:
    """Byte strings laid end to end, to be gathered by number."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of each row, laid end to end."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return data[np.repeat(start - (end - size), size) + np.arange(total)]


def load(path: str) -> Ranks:
    return keep(f"bpe:{path}", lambda: Ranks(path))


def char_classes() -> np.ndarray:
    return keep("bpe:classes", class_table)


def class_table() -> np.ndarray:
    """Of each code point: letter, number, other or blank, by the same tables as
    the pattern's own engine."""
    import regex

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte starts of the matches of the tokenizer's pattern in UTF-8 rows laid
    end to end.

    The pattern takes an ending such as 's first, then runs of letters, numbers
    or others with one space before them, then white space, of which the last
    character before a non-blank stands alone unless it is that one space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, at)] = True
    blank = kind == BLANK
    solid_next = np.zeros(n, bool)  # a non-blank follows in the same row
    solid_next[:-1] = ~blank[1:] & ~first[1:-1]
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start |= blank & solid_next
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1] & (points[:-1] == 0x20) & ~blank[1:] & ~first[1:-1]
    start &= ~joined
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        left = np.searchsorted(np.flatnonzero(first), quote, "right")
        room = np.flatnonzero(first)[left] - quote  # code points from the quote to the row's end
        p1 = points[np.minimum(quote + 1, n - 1)]
        p2 = points[np.minimum(quote + 2, n - 1)]
        short = (room >= 2) & np.isin(p1, [ord(c) for c in "stmd"])
        long = (room >= 3) & (((p1 == ord("r")) | (p1 == ord("v"))) & (p2 == ord("e")) | (p1 == ord("l")) & (p2 == ord("l")))
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[hit + 1] = False
            rest = hit + size
            start[rest[rest < n]] = True
    return lead[start]


def encode_narrow(ranks: Ranks, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many pieces of at most width bytes (a power of two): a matrix
    with -1 in dead places.

    Each piece has a segment tree over its byte positions whose leaves hold pair
    rank times width plus position, so the root is the leftmost pair of least
    rank. A merge rewrites three leaves: the merged one, its dead right
    neighbour and its live left neighbour.
    """
    m = len(start)
    place = np.arange(width)
    inside = place < size[:, None]
    token = np.where(inside, ranks.byte[data[np.minimum(start[:, None] + place, len(data) - 1)]], -1)
    after = np.where(place + 1 < size[:, None], place + 1, width)
    before = np.broadcast_to(place - 1, (m, width)).copy()
    tree = np.full((m, 2 * width), NONE)
    if width > 1:
        joined = np.where(after[:, :-1] < width, ranks.join(token[:, :-1], token[:, 1:]), -1)
        tree[:, width : 2 * width - 1] = np.where(joined >= 0, joined * width + place[:-1], NONE)
    level = width >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = value
        node = node >> 1
        while node.size and node[0]:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    def pair(row: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[row, i]
        joined = np.where(j < width, ranks.join(token[row, i], token[row, np.minimum(j, width - 1)]), -1)
        return np.where(joined >= 0, joined * width + i, NONE)

    row = np.flatnonzero(tree[:, 1] < NONE)
    while row.size:
        best = tree[row, 1]
        i = best % width
        j = after[row, i]
        token[row, i] = best // width
        token[row, j] = -1
        k = after[row, j]
        after[row, i] = k
        live = k < width
        before[row[live], k[live]] = i[live]
        put(row, j, np.full(len(row), NONE))
        put(row, i, pair(row, i))
        h = before[row, i]
        has = h >= 0
        put(row[has], h[has], pair(row[has], h[has]))
        row = row[tree[row, 1] < NONE]
    return token, (token >= 0).sum(1)


def encode_wide(ranks: Ranks, piece: bytes) -> list[int]:
    """The same for one long piece, on lists: a merge costs the tree's height."""
    n = len(piece)
    width = 1 << max(0, (n - 1).bit_length())
    token: list[int] = ranks.byte[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    none, size, pairs = int(NONE), ranks.size, ranks.pairs
    tree = [none] * (2 * width)

    def pair(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] * size + token[j]) if j >= 0 else None
        return none if rank is None else rank * width + i

    for i in range(n):
        tree[width + i] = pair(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    while width > 1 and tree[1] < none:
        i = tree[1] % width
        j = after[i]
        token[i] = tree[1] // width
        token[j] = -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [t for t in token if t >= 0]


def encode_pieces(ranks: Ranks, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all pieces end to end, and how many each has."""
    counts = np.zeros(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    width = 1
    done = size <= 0
    while width <= WIDE and not done.all():
        which = np.flatnonzero(~done & (size <= width))
        for part in np.array_split(which, max(1, len(which) * width >> 20)):
            if len(part):
                token, counts[part] = encode_narrow(ranks, data, start[part], size[part], width)
                parts.append((part, token[token >= 0]))
        done[which] = True
        width *= 2
    for p in np.flatnonzero(~done):
        ids = encode_wide(ranks, data[start[p] : start[p] + size[p]].tobytes())
        counts[p] = len(ids)
        parts.append((np.array([p]), np.array(ids, np.int64)))
    where = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for part, ids in parts:
        c = counts[part]
        out[np.repeat(where[part] - (np.cumsum(c) - c), c) + np.arange(len(ids))] = ids
    return out, counts


def encode_rows(ranks: Ranks, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of UTF-8 rows end to end, and len + 1 offsets of rows into them.

    Equal pieces are found by a 64-bit hash and encoded once a worker; decoding
    must give the input back, or the slice is encoded again with another hash.
    """
    start = piece_starts(data, at)
    size = np.diff(np.append(start, len(data)))
    for seed in range(1, 9):
        base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        power = np.cumprod(np.full(len(data) + 1, base, np.uint64)) if len(data) else np.ones(1, np.uint64)
        inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(base), -1, 2**64)), np.uint64))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        h = mix((total[start + size] - total[start]) * inverse[start]) if len(start) else np.zeros(0, np.uint64)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        seen = ranks.seen if seed == 1 else Seen()
        slot = seen.slots(distinct, lambda new: encode_pieces(ranks, data, start[first[new]], size[first[new]]))[which]
        out = gather(seen.ids, seen.start[slot], seen.count[slot]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(seen.count[slot])])[np.searchsorted(start, at)]
        if np.array_equal(decode_rows(ranks, out), data):
            return out, bounds
    raise ValueError("the ranks don't decode to what was encoded")


def decode_rows(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    pool = ranks.bytes_pool
    return gather(pool.data, pool.start[ids], pool.size[ids])


def encode(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids: the token ids of each whole text, without special tokens.

    Null and empty texts give an empty list. Rows stay as they are, repeated
    ones too; no shuffle. Other columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(ranks_path)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                ids, bounds = encode_rows(ranks, data[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], [key, "ids"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """key, content: the bytes that the ids stand for; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(ranks_path)
        for batch in batches:
            lists = [np.asarray(x.as_py() or [], np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_rows(ranks, x).tobytes() for x in lists], pa.binary())], [key, "content"])

    return map_arrow(encoded.select(key, "ids"), run, f"{key} {dict(encoded.dtypes)[key]}, content binary")


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, and
    its ids decoded, with hashes of both.

    The ids are hashed as decimals joined by one space. Null and empty texts
    have no tokens. Very long texts are encoded whole, piece by piece. Rows that
    repeat, or share a key, are returned each; an empty table gives no rows; other
    columns, of any names, are ignored. One pass over the rows, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(ranks_path)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                ids, bounds = encode_rows(ranks, data[at[a] : at[b]], at[a : b + 1] - at[a])
                listed = gather(ranks.text_pool.data, ranks.text_pool.start[ids], ranks.text_pool.size[ids])
                decoded = decode_rows(ranks, ids)
                as_text = np.concatenate([[0], np.cumsum(ranks.text_pool.size[ids])])[bounds]
                as_bytes = np.concatenate([[0], np.cumsum(ranks.bytes_pool.size[ids])])[bounds]
                spell = lambda part: hashlib.sha256(part).hexdigest()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], pa.array(np.diff(bounds), pa.int64()),
                    pa.array([spell(listed[x : max(x, y - 1)]) for x, y in zip(as_text, as_text[1:])]),
                    pa.array([spell(decoded[x:y]) for x, y in zip(as_bytes, as_bytes[1:])]),
                ], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
