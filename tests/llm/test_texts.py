"""Text operators against brute force, the tokenizer library and held-out rows."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import bpe, importance, langid, mixing, simhash, substring_dedup, suffix_dedup, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, doc string, bucket int, _n int"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), 1, "x", 2, 3) for d, t, lang, s in rows], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=3):
    """Copies, shared passages, repeats within a text, odd texts, null ids."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 200), 5000) for _ in range(30)]
    passage, run = words(rng, 90, 9000), "ab " * 300
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(6)] + [(120, base[0]), (7, base[7])]
    rows += [(200 + i, f"{base[i]} {passage} {words(rng, 3)}") for i in range(8)]
    rows += [(300, run), (301, run + "é" * 500), (302, "é" * 700), (303, passage[:450] + "\n\t" + passage), (304, ""), (305, None), (306, " \n "), (307, "x" * 399), (308, "y" * 400), (309, "y" * 401)]
    rows += [(None, base[3] + " tail"), (None, None), (400, base[5].upper()), (401, words(rng, 3000, 6000))]
    return [(d, t, "en", ("a", "b", None)[k % 3]) for k, (d, t) in enumerate(rows)]


def test_suffix_dedup(spark):
    rows = corpus()
    texts = [(t or "").encode() for _, t, _, _ in rows]
    seen = {}
    for x in texts:
        for i in range(len(x) - 399):
            seen[x[i : i + 400]] = seen.get(x[i : i + 400], 0) + 1
    want = []
    for (d, *_), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for most in (suffix_dedup.MOST_ROWS, 2):  # 2: large groups are halved until they fit
        got = [tuple(r) for r in suffix_dedup.report(frame(spark, rows), most_rows=most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_order_is_a_suffix_order():
    import numpy as np

    rng = np.random.default_rng(0)
    table = rng.integers(0, 3, (40, 12))
    group = rng.integers(0, 3, 40)
    build = suffix_dedup.Columns(group)
    for c in range(11, -1, -1):
        build.insert(table[:, c].astype(np.int16))
        keys = [(group[r], *table[r, c:]) for r in build.order]
        assert keys == sorted(keys)
        for i in range(1, 40):
            a, b = keys[i - 1], keys[i]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a)) - 1 if a[0] == b[0] else 0
            assert build.common[i] == max(0, same)


def test_suffix_removal_in_documents(spark):
    out = suffix_dedup.remove(frame(spark, corpus()))
    assert out.columns == frame(spark, corpus()).columns
    rows = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert rows[305].text is None and rows[300].text == "" and rows[301].n_chars == len(rows[301].text)


def test_substring_dedup(spark):
    rows = corpus()
    split = [((t or "").encode()).split() for _, t, _, _ in rows]
    order = lambda d: -(2**63) if d is None else d
    first = {}
    for (d, *_), w in zip(rows, split):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, order(d)), order(d))
    want = []
    for (d, *_), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order(d):
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    for most in (substring_dedup.MOST_ROWS, 2):
        got = [tuple(r) for r in substring_dedup.report(frame(spark, rows), most_rows=most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(9)
    rows = corpus()
    long = words(rng, 400, 5000).split()
    for k in range(20):  # near copies, so that links are chains
        long[rng.randrange(400)] = f"z{k}"
        rows.append((500 + k, " ".join(long), "en", "a"))
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, p, least.get(find(i))) for i, ((d, *_), p) in enumerate(zip(rows, prints))), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == want
    kept = simhash.keep_first(frame(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c in want if c == d and d is not None})
    assert kept.columns == frame(spark, rows).columns


def test_simhash_keeps_one_of_each_group_without_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 300, 5000) for _ in range(4))

    def near(t):
        """A text with another fingerprint, within reach."""
        w = t.split()
        for i in range(300):
            other = " ".join([*w[:i], "q", *w[i + 1 :]])
            if 0 < (plain_fingerprint(t) ^ plain_fingerprint(other)).bit_count() <= 4:
                return other

    rows = [(None, a), (None, a), (None, near(a)), (None, b), (1, c), (None, c), (None, near(c)), (5, d), (None, near(d)), (5, d), (5, b + " " + a)]
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    group = {a: 0, near(a): 0, b: 1, c: 2, near(c): 2, d: 3, near(d): 3, b + " " + a: 4}
    kept = [(r.doc_id, group[r.text]) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=lambda x: x[1]) == [(None, 0), (None, 1), (1, 2), (5, 3), (5, 4)]
    # groups are not tied together by rows without an id
    found = {(r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(plain_fingerprint(t), (None, None, 1, 5, 5)[g]) for t, g in group.items()}


def test_simhash_tiles(spark):
    """Buckets far over a tile, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    found = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for c in centre for _ in range(150)}
    prints = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64).tolist())], "node long, fp long")
    from quantloom.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df, 4, tile_rows=16)).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(prints))])
        if np.array_equal(new, label):
            break
        label = new
    assert [got.get(i, i) for i in range(len(prints))] == label.tolist()


def test_bpe(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "ab 's't're\n\t  don'tx’é漢字123-_!?'ll've  ٣ 　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)] + ["a" * 3000, "ab" * 700 + " " * 900, "'", "x's", "<|endoftext|>", "", None]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, "again", None, None), (1, texts[1], "en", "a")]
    want = []
    for d, t, _, _ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(frame(spark, rows), RANKS).collect()), key=repr) == sorted(want, key=repr)
    lists = bpe.encode(frame(spark, rows), RANKS)
    assert {r.doc_id: r.ids for r in lists.collect()}[400] == own.encode_ordinary(texts[400])
    assert {r.doc_id: bytes(r.content) for r in bpe.decode(lists, RANKS).collect()}[3] == texts[3].encode()


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(900, None, "en", "z"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "null id", "en", "b")]
    got = mixing.mix_sources(frame(spark, rows), rows_per_bucket=16).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    for r in got:
        assert r.taken == r.size * r.copies and r.copies <= 3
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    weight = dict(zip(["a", "b", "c", "z", None], (1, 2, 3, 1, 2)))
    left, open_ = float(sum(size.values())), set(size)
    want = {}
    while open_:  # shares, the excess over three times a source dealt out again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            open_.remove(s)
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    for s in size:
        assert abs(taken[s] - target[s]) <= 60
    again = mixing.mix_sources(frame(spark, rows), rows_per_bucket=1000).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mixed_documents(frame(spark, rows)).count() == sum(r.copies for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog were there", "en", None) for i in range(40)] + [(100 + i, "der hund und die katze waren dort", "de", None) for i in range(40)]
    odd = [(500, None, None, None), (501, "", "en", None), (502, "12 ½ -- ٣", "en", None), (503, "x" * 5000, None, None), (None, "der hund", "de", None), (504, "漢字", None, None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows + odd), PIECES).collect()}
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[502].score == 0.0
    assert got[0].lang_pred == "en" and got[100].lang_pred == "de" and got[503].lang_pred in ("en", "de")
    kept = langid.keep_known(frame(spark, rows + odd), PIECES)
    assert kept.columns == frame(spark, rows).columns and kept.count() >= 80
    none = langid.identify(frame(spark, [(1, "text", None, None)]), PIECES).first()
    assert none.lang_pred == "und"


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    vocab = langid.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    prob = np.zeros((vocab.size + 2, 2))
    prob[: vocab.size] = rng.random((vocab.size, 2)) / vocab.size
    prob[vocab.size] = langid.UNKNOWN
    words_ = [langid.EDGE + w for w in ("the", "ander", "queda", "漢x")]
    got = langid.log_likelihood(words_, vocab, prob)
    piece = {}
    for i, w in enumerate(words_):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(w)]
            p = np.ones(2)
            for a, b in zip(at, at[1:]):
                if w[a:b] not in piece:
                    points, _ = langid.char_hash([w[a:b]])
                    k = np.searchsorted(vocab.keys, langid.fold(points))
                    hit = k < len(vocab.keys) and vocab.keys[k] == langid.fold(points)
                    piece[w[a:b]] = vocab.index[k] if hit else (vocab.size if b - a == 1 else vocab.size + 1)
                p = p * prob[piece[w[a:b]]]
            total += p
        assert np.allclose(got[i], np.log(total))


def test_language_of_long_runs(spark):
    """Runs of letters whose probability is far under a double's range, in a row
    that the fit learns from and ahead of ordinary rows in one batch."""
    import math

    import numpy as np
    import pyarrow as pa

    vocab = langid.vocabulary(PIECES)
    prob = np.full((vocab.size + 2, 1), 1.0 / vocab.size)
    prob[vocab.size], prob[-1] = langid.UNKNOWN, 0.0
    runs = ["漢" * n for n in (1, 54, 55, 60, 200, 257)] + [langid.EDGE + "acgtqxzk" * 30]
    got = langid.log_likelihood(runs, vocab, prob)
    assert np.allclose(got[:6, 0], [n * math.log(langid.UNKNOWN) for n in (1, 54, 55, 60, 200, 257)])
    assert np.isfinite(got).all()
    counts = langid.expected(runs, np.arange(1.0, 8.0), vocab, prob)
    assert counts[vocab.size] == pytest.approx(sum(n * w for n, w in zip((1, 54, 55, 60, 200, 257), range(1, 7))))
    dear = np.full((vocab.size + 2, 1), 0.5)  # sums that grow instead
    dear[-1] = 0.0
    assert np.isfinite(langid.log_likelihood([langid.EDGE + "international" * 19], vocab, dear)).all()

    rows = [(i, "the cat and the dog were there", "en", None) for i in range(40)] + [(100 + i, "der hund und die katze waren dort", "de", None) for i in range(40)]
    rows += [(i, "漢" * 60 + " the dog", "en", None) for i in range(200, 210)]
    model = langid.fit(frame(spark, rows), PIECES)
    assert np.isfinite(model.prob).all()
    lang, score, _ = langid.score_texts(pa.array(["漢" * 60 + " the cat", "der hund und die katze", "", "the dog and the cat", "x" * 700]), model)
    assert lang[:4] == ["en", "de", langid.NO_LANGUAGE, "en"] and lang[4] in ("en", "de")
    assert all(0 <= x <= 1 for x in score) and min(score[0], score[1], score[3]) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_accuracy(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.classify(docs, labels.select("doc_id", "toxic")).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows} == {True}
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert hit / sum(r.predicted for r in held) >= 0.85 and hit / sum(r.toxic for r in held) >= 0.85


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None, None, None), (2, "", None, None), (None, "fine words", None, None), (3, "x" * 100_000, None, None), (3, "x", None, None)])
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_maximal_segments():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.integers(-4, 5, rng.integers(1, 14)).astype(float)
        got = toxicity.passages(s)

        def plain(a, b):
            best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[2], best[3]
            return plain(a, i) + [(i, j, best[0])] + plain(j, b)

        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in plain(0, len(s))))


def test_importance(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 50, 30), "en", "a") for i in range(120)] + [(1000 + i, " ".join(f"junk{rng.randrange(30)}" for _ in range(50)), "en", "a") for i in range(40)]
    rows += [(2000, None, None, None), (2001, "", None, None), (None, "w1 w2", None, None), (5, rows[5][1], "en", "a")]
    labels = spark.createDataFrame([(d, 1 if d < 1000 else 0, 0) for d, *_ in rows if d is not None and d % 2 == 0] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(frame(spark, rows), labels, share=0.75).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == len(rows) and len(kept) == round(0.75 * len(rows))
    assert sum(r.doc_id is not None and 1000 <= r.doc_id < 1100 for r in kept) <= 2
    assert min((r.draw for r in kept)) >= max((r.draw for r in got if not r.kept))
    assert all(r.kept for r in importance.resample(frame(spark, rows), labels.limit(0)).collect())


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (suffix_dedup.report(none), suffix_dedup.remove(none), substring_dedup.report(none), simhash.near_duplicates(none), simhash.keep_first(none), bpe.round_trip(none, RANKS), mixing.mix_sources(none), mixing.mixed_documents(none), langid.identify(none, PIECES), toxicity.classify(none, labels), importance.resample(none, labels)):
        assert df.count() == 0
