"""Filter audit, centroid clusters and improbable-feature fingerprints against
brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from quantloom.llm import centroids, filter_audit, improbable

DOCS = "doc_id long, text string, lang string, source string, part int, mask int, n int, least int, step int, id int, body int, turn int"
LABELS = "doc_id long, quality int, toxic int, part int, n int"


def docs_of(spark, rows, parts=4):
    return spark.createDataFrame([(d, t, lang, "s", *range(8)) for d, t, lang in rows], DOCS).repartition(parts)


def plain_audit(rows, labels):
    mark = lambda d, k: any(x[k] == 1 for x in labels if x[0] == d and d is not None)
    masks = []
    for d, t, lang in rows:
        t = t or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in rows),
        }
        masks.append((lang or "", {k for k, v in fails.items() if v}, mark(d, 1), mark(d, 2)))
    out = {}
    for part in {m[0] for m in masks}:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                row = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
                for p, fails, good, toxic in masks:
                    if p == part:
                        earlier = bool(fails & set(order[:step]))
                        gone = f in fails and not earlier
                        row["kept"] += not fails & set(order[: step + 1])
                        row["removed"] += gone
                        row["redundant"] += f in fails and earlier
                        row["unique_fails"] += fails == {f}
                        row["good_lost"] += gone and good
                        row["toxic_lost"] += gone and toxic
                out[part, "".join(order), step + 1] = row
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row["removed"]
    return {k: (*v.values(), total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(3)
    text = lambda n, size: " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    pool = [text(250, 900), text(220, 40), text(30, 100), "A" * 30 + text(210, 900), text(230, 900) + " #", "x y " * 210, "😀A " * 3, "", "a\n b\t\tc", "hidden | " * 300]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(500, None, "en"), (None, pool[0], "fr"), (None, pool[0], "fr"), (500, pool[0], "en"), (500, pool[0], "en"), (-7, pool[1], "en"), (-7, pool[1], "de"), (900, "one " * 40_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(80)] + [(500, 0, 1), (500, 1, 0), (None, 1, 1), (7777, 1, 1)]
    got = filter_audit.audit(docs_of(spark, rows), spark.createDataFrame([(*x, 1, 2) for x in labels], LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(found) == 4 * 600 and found == plain_audit(rows, labels)
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs_of(spark, []), none).count() == 0
    assert filter_audit.audit(docs_of(spark, [(1, None, None)]), none).count() == 600


def test_audit_pairs_nothing_without_a_key(spark):
    plan = filter_audit.audit(docs_of(spark, [(1, "a", "en")], 1), spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def plain_clusters(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**27), min(2**27, x)) for x in v]) for i, v in kept]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    now = [v for _, _, v in sorted((name(i), k, v) for k, (i, v) in enumerate(sorted(kept, key=lambda r: r[1])))[:8]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now)) for _, v in kept]
    for _ in range(10):
        of = assign()
        for k in range(len(now)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == k]
            now[k] = [sum(x) // len(own) for x in zip(*own)] if own else now[k]
    of = assign()
    inertia = {k: sum(d for d, c in of if c == k) for k in range(len(now))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, of)), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, id int, v int, cluster int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VECTORS)


def found_clusters(spark, rows):
    got = centroids.centroid_clusters(vectors(spark, rows)).collect()
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in got), key=repr)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 64))
    rows = [(i, (centre[i % 12] + 0.3 * rng.standard_normal(64)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 64) for i in range(20)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    odd = [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [None] * 64), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [])]
    assert found_clusters(spark, rows + odd) == plain_clusters(rows + odd)


def test_clusters_of_few_large_and_tied_vectors(spark):
    line = lambda x: [x] + [0.0] * 63
    assert found_clusters(spark, []) == [] and found_clusters(spark, [(1, None)]) == []
    few = [(1, line(1.0)), (2, line(-1.0)), (3, line(0.0))]
    assert found_clusters(spark, few) == plain_clusters(few)
    same = [(7, line(0.25))] * 30 + [(8, line(0.25))] * 3 + [(9, line(0.75)), (10, line(0.5))]
    assert found_clusters(spark, same) == plain_clusters(same)
    large = [(i, [(-1) ** i * 1e300] * 64) for i in range(9)] + [(20, [3e5] * 64), (21, line(0.0))]
    assert found_clusters(spark, large) == plain_clusters(large)


def test_nearest_by_partial_distances():
    """Any order of dimensions and any first guess give the full search's result."""
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (500, 12)).astype(np.int32)
    c = rng.integers(-3, 4, (9, 12)).astype(np.int64)
    full = ((v[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
    for guess in (0, 4, 8):
        number, best = centroids.nearest(v, c, rng.permutation(12), guess)
        assert np.array_equal(number, full.argmin(1)) and np.array_equal(best, full.min(1))


def laid(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def plain_features(text, rank):
    """Starts of the selected features of one text, window by window."""
    w = improbable.WINDOW
    level = []
    for s in range(len(text) - w + 1):
        counts = np.unique(np.frombuffer(text[s : s + w], np.uint8), return_counts=True)[1]
        total = sum(int(improbable.PART[c]) for c in counts)
        level.append(improbable.LEVELS - total * improbable.LEVELS // int(improbable.PART[w]))
    m = len(level)
    if not m:
        return []
    runs = max(1, m - improbable.REACH + 1)
    votes = [0] * m
    for s in range(runs):
        able = [(rank[level[i]], i) for i in range(s, min(m, s + improbable.REACH)) if rank[level[i]] >= 0]
        if able:
            votes[min(able)[1]] += 1
    return [i for i in range(m) if votes[i] and votes[i] >= min(improbable.VOTES, (runs + 3) // 4)]


def sample_texts():
    rng = random.Random(9)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(n))
    return [say(n).encode() for n in (1, 5, 6, 7, 8, 12, 20, 40, 90, 400)] + [b"", b"a" * 500, b"short", bytes(32), "ünï☃😀 ".encode() * 20, say(30).encode()[:62], say(30).encode()[:63], say(30).encode()[:64]]


@pytest.mark.parametrize("block", [1 << 18, 97, 64])
def test_features_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(improbable, "BLOCK", block)
    texts = sample_texts()
    data, at = laid(texts)
    counts = improbable.level_counts(data, at)
    assert counts.sum() == sum(max(0, len(t) - improbable.WINDOW + 1) for t in texts)
    rank = improbable.ranks(counts)
    want = [int(a) + i for a, t in zip(at, texts) for i in plain_features(t, rank)]
    assert improbable.selected(data, at, rank).tolist() == want


@pytest.mark.parametrize("block", [1 << 18, 97])
def test_features_of_few_bytes_in_all(monkeypatch, block):
    monkeypatch.setattr(improbable, "BLOCK", block)
    rng = random.Random(4)
    for n in range(130):
        text = bytes(rng.choices(range(97, 115), k=n))
        data, at = laid([text[: n // 3], text[n // 3 :]])
        rank = improbable.ranks(improbable.level_counts(data, at))
        want = [int(a) + i for a, t in zip(at, (text[: n // 3], text[n // 3 :])) for i in plain_features(t, rank)]
        assert improbable.selected(data, at, rank).tolist() == want


def test_levels_are_entropies():
    data = np.frombuffer(random.Random(2).randbytes(300) + b"a" * 50, np.uint8)
    for s, level in enumerate(improbable.levels(data)):
        _, k = np.unique(data[s : s + improbable.WINDOW], return_counts=True)
        entropy = -(k / k.sum() * np.log2(k / k.sum())).sum() / math.log2(improbable.WINDOW)
        assert abs(level - improbable.LEVELS * entropy) <= 1.01


def plain_digest(text, rank):
    """Count and bits of the chained filters of one text, feature by feature."""
    starts = plain_features(text, rank)
    if starts:
        data = np.frombuffer(text, np.uint8)
        hashes = [int(h) for h in improbable.feature_hashes(data, np.array(starts))]
    else:
        hashes = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")] if text else []
    filters = []
    for k, h in enumerate(hashes):
        if k % improbable.FULL == 0:
            filters.append(set())
        filters[-1] |= {h >> 11 * p & improbable.BITS - 1 for p in range(improbable.PROBES)}
    return len(hashes), filters


def plain_likeness(a, b):
    if a[0] > b[0]:
        a, b = b, a
    if not a[0]:
        return float(not b[0])

    def one_way(a, b):
        total = 0.0
        for k, x in enumerate(a[1]):
            best = 0.0
            for y in b[1]:
                common, most, chance = len(x & y), min(len(x), len(y)), len(x) * len(y) / improbable.BITS
                if common == most or common > chance + improbable.NOISE * chance**0.5:
                    best = max(best, (common - chance) / (most - chance))
            total += best * min(improbable.FULL, a[0] - k * improbable.FULL)
        return total / a[0]

    return max(one_way(a, b), one_way(b, a) if a[0] == b[0] else 0.0)


def test_compare_next_by_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9999)}" for _ in range(n))
    rows = [(i * 3 % 101, say(rng.choice([0, 1, 8, 30, 200])), "en") for i in range(101)]
    rows += [(200, None, "en"), (201, "ünï☃😀" * 31, None), (202, rows[0][1], "en"), (203, rows[0][1], "en"), (204, say(3000), "en"), (205, say(2900), "en"), (-4, "", "en"), (None, "the last " * 12, "en")]
    got = {r.doc_id: r for r in improbable.compare_next(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    line = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    rank = improbable.rarity(docs_of(spark, rows))
    for (d, t, _), (_, following, _) in zip(line, line[1:] + line[:1]):
        t, following, r = t or "", following or "", got[d]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, other, after = (plain_digest(x.encode(), rank) for x in (t, new, following))
        for text, (n, filters) in ((r.fingerprint, own), (r.edited_fingerprint, other)):
            read = improbable.Digest.read(text)
            bits = np.unpackbits(read.filters.view(np.uint8), axis=1, bitorder="little")
            assert read.features == n and [set(np.flatnonzero(x).tolist()) for x in bits] == filters
        assert r.near_edited == pytest.approx(plain_likeness(own, other)) and r.near_next == pytest.approx(plain_likeness(own, after))
    assert got[202].near_next == 1.0 and got[202].fingerprint == got[203].fingerprint == got[rows[0][0]].fingerprint
    long = [got[d] for d, t, _ in rows if t and len(t) > 1000]
    assert long and all(r.near_edited > 0.3 and (r.near_next < 0.1 or r.doc_id == 202) for r in long)


def test_compare_next_of_few_and_repeated_rows(spark):
    assert improbable.compare_next(docs_of(spark, [])).count() == 0
    one = improbable.compare_next(docs_of(spark, [(5, "alone", "en")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(5, hashlib.sha256(b"aloal").hexdigest(), 1.0)]
    same = improbable.compare_next(docs_of(spark, [(1, "a b c d", "en")] * 40 + [(None, None, None)] * 40)).collect()
    assert len(same) == 80 and sum(r.near_next == 1.0 for r in same) == 78


def test_fingerprints_alone(spark):
    rows = [(1, "some text " * 30, "en"), (2, "some text " * 30, "en"), (3, None, "en")]
    rank = improbable.rarity(docs_of(spark, rows))
    got = {r.doc_id: r.fingerprint for r in improbable.fingerprints(docs_of(spark, rows), rank).collect()}
    assert got[1] == got[2] != got[3] == "0:"
