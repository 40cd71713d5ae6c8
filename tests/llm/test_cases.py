"""Odd rows, clashing names, hard cases of each operator, and the whole pipeline,
against brute force."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann_tree, importance, langid, lattice, mixing, simhash, substring_dedup, suffix_dedup, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
PIECES = tokenizers.path("piece_bpe_32k.model")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
MOST = 2**63 - 1
#: Names that the operators use inside.
NAMES = ["_key", "_row", "_doc", "_words", "_turn", "_text_hash", "_ranges", "_copies", "doc", "row", "whole", "hashes", "ranges", "c0", "c1", "turn", "n", "copies", "key", "id", "size", "component", "fp", "letters", "score"]
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows], BASE)


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *range(77, 77 + len(NAMES))) for d, t, lang, s in rows], BASE + "".join(f", {c} int" for c in NAMES))


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_columns_of_any_name_stay(spark):
    rng = random.Random(1)
    passage = words(rng, 120, 9000)
    rows = [(i, f"{words(rng, 60, 9000)} {passage if i < 3 else ''}", "en", "ab"[i % 2]) for i in range(12)] + [(20, "", "en", None), (21, None, "en", "a")]
    docs = clashing(spark, rows)
    for out in (suffix_dedup.remove(docs), simhash.keep_first(docs), mixing.mixed_documents(docs), langid.keep_known(docs, PIECES)):
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        found = out.collect()
        assert found and all(tuple(r)[5:] == tuple(range(77, 77 + len(NAMES))) for r in found)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for out in (suffix_dedup.report(docs), substring_dedup.report(docs), simhash.near_duplicates(docs), mixing.mix_sources(docs), langid.identify(docs, PIECES), toxicity.classify(docs, labels), importance.resample(docs, labels)):
        assert out.count() == len(rows)


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_running_hash_are_told_apart(spark):
    """Thue-Morse words and their complements clash under any running product
    modulo a power of two."""
    a = morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{i}" for i in range(12))
    got = {r.doc_id: r.n_removed for r in substring_dedup.report(docs_of(spark, [(1, f"{a} {rest}", "en", "x"), (2, f"{b} {rest}", "en", "x"), (3, f"{a} {rest}", "en", "x")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    tail = "".join(chr(97 + i % 26) for i in range(400))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.report(docs_of(spark, [(1, f"x{a}y", "en", "x"), (2, f"x{b}y", "en", "x"), (3, f"{tail}1", "en", "x"), (4, f"{tail}2", "en", "x")]), length=1024).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}


def test_repeated_rows_and_bytes_in_one_row(spark):
    same = "".join(random.Random(3).choice("abcdefgh ") for _ in range(900))
    docs = docs_of(spark, [(1, same, "en", "a")] * 3 + [(None, same[:500], "en", "a"), (None, same[100:520], "en", "a"), (4, same[:399], "en", "a")])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.report(docs).collect())
    assert got == [(399, 0), (420, 420), (500, 500), (900, 900), (900, 900), (900, 900)]


def test_the_kept_transform_is_of_the_suffix_order():
    """Each round's part, in the old order, is the symbol in front of each suffix."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, 3, (30, 9)).astype(np.int16)
    build = suffix_dedup.Columns(np.zeros(30, np.int64))
    for c in range(8, -1, -1):
        before = build.order.copy()
        build.insert(table[:, c])
        assert np.array_equal(build.transform[0], table[before, c])
    assert len(build.transform) == 9


def find_groups(prints, radius=4):
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius) for i in range(len(prints))]
        if new == label:
            return label
        label = new


def test_simhash_ids_that_repeat_or_lack_tie_nothing(spark):
    rng = random.Random(12)
    texts = [words(rng, 200, 5000) for _ in range(6)]

    def near(t):
        w, own = t.split(), simhash.fingerprint(t.encode())
        return next(x for x in (" ".join([*w[:i], "q", *w[i + 1 :]]) for i in range(200)) if 0 < (own ^ simhash.fingerprint(x.encode())).bit_count() <= 4)

    a, b, c, d, e, f = texts
    rows = [(3, a), (9, b), (7, near(a)), (7, near(b)), (None, c), (None, d), (5, near(c)), (8, near(d)), (MOST, e), (-(2**63), f), (None, near(e)), (2, near(f))]
    got = sorted((r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs_of(spark, [(i, t, "en", "a") for i, t in rows])).collect())
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    label = find_groups(prints)
    least = {g: min((i for (i, _), k in zip(rows, label) if k == g and i is not None), default=None) for g in label}
    assert got == sorted((p, least[g]) for p, g in zip(prints, label))
    assert {least[g] for g in label} == {3, 7, 5, 8, MOST, -(2**63)}


def test_forest_in_any_order_of_links():
    from quantloom.llm.tiles import forest

    rng = np.random.default_rng(8)
    for _ in range(2000):
        n = int(rng.integers(1, 14))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 16))))
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j):
                label[a] = label[b] = min(label[a], label[b])
        assert forest(n, i, j).tolist() == label


def test_simhash_blocks(spark):
    """Two and three agreeing blocks find what one finds, and what all pairs find."""
    from quantloom.llm.common import components

    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    found = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centre for _ in range(40) for k in (1, 4, 7)}
    prints = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64).tolist())], "node long, fp long")
    want = find_groups([int(p) for p in prints])
    for agree in (1, 2, 3):
        got = {r.node: r.component for r in components(simhash.links(df, 4, tile_rows=32, agree=agree)).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == want
    assert [simhash.agreeing(n, 4, 1024) for n in (10, 10**7, 10**9)] == [1, 2, 3]


VECTORS = "vec_id long, embedding array<float>, label int, node long, v int, leaf int, first int, component long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], label, 1, 2, 3, 4, 5) for i, v, label in rows], VECTORS)


def test_lattice_ids_that_repeat(spark):
    a, b = np.eye(16)[0], np.eye(16)[1]
    a2, b2 = a + 0.1 * np.eye(16)[2], b + 0.1 * np.eye(16)[3]
    rows = [(3, a, 1), (9, b, 1), (7, a2, 1), (7, b2, 1), (MOST, np.eye(16)[5], 1), (MOST, np.eye(16)[6], 1), (None, a, 1), (1, a, None)]
    got = sorted(tuple(r) for r in lattice.near_duplicates(vectors(spark, rows)).collect() if r.vec_id is not None)
    assert got == sorted([(3, 1, 3, True), (9, 1, 7, False), (7, 1, 3, False), (7, 1, 7, True), (MOST, 0, MOST, True), (MOST, 0, MOST, True), (1, 0, 1, True)])


@pytest.mark.parametrize("d,blocks", [(2, 1), (8, 1), (12, 1), (16, 1), (24, 1), (64, 1), (384, 1), (16, 2), (64, 2), (384, 2), (24, 3), (64, 3)])
def test_lattice_recall_at_the_threshold(d, blocks):
    """Of pairs at cosine 0.93 and 0.95, how many meet in a cell."""
    rng = np.random.default_rng(1)
    tables, probes = lattice.PLANS[blocks]
    for cosine in (0.93, 0.95):
        a, b = (rng.standard_normal((800, d)) for _ in range(2))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= (a * b).sum(1)[:, None] * a
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]
        x, y = (lattice.cells(v, tables, probes, lattice.cell_scale(d, 0.93), lattice.SEED, blocks) for v in (a, b))
        met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1)
        assert met.mean() >= 0.99


def test_blocks_grow_with_a_label():
    assert [lattice.blocks_for(n, 64) for n in (0, 1 << 18, (1 << 18) + 1, 1 << 25, (1 << 25) + 1, 1 << 40)] == [1, 1, 2, 2, 3, 3]
    assert [lattice.blocks_for(1 << 40, d) for d in (2, 8, 15, 16, 24)] == [1, 1, 1, 2, 3]


def test_tree_gives_as_many_as_there_are(spark):
    """Tight clusters of copies calibrate to one leaf; each query still gets its
    neighbours, also where a few ids repeat."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 8))
    rows = [(i, centre[i % 40] + 0.001 * rng.standard_normal(8), 1) for i in range(160)] + [(3, centre[5], 1), (3, centre[6], 1), (None, centre[0], 1)]
    got = {}
    for r in ann_tree.search(vectors(spark, rows), F.col("vec_id") % 40 == 0, leaf_rows=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: sorted(x)[-1][0] for q, x in got.items()} == {q: 10 for q in (0, 40, 80, 120)}
    assert all({v for r, v in x if r <= 3} == {v for v in range(160) if v % 40 == 0 and v != q} for q, x in got.items())
    few = ann_tree.search(vectors(spark, rows[:4]), F.lit(True)).collect()
    assert len(few) == 4 * 3


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)

    def plain(s, a, b):
        best = max(((s[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0.0, 0, 0))
        return [] if best[0] <= 0 else [*plain(s, a, best[1]), best[1:], *plain(s, best[2], b)]

    for k in range(200):
        s = rng.standard_normal(rng.integers(1, 16))
        if k % 3 == 0:
            s = np.sort(s)[::-1] + 0.5
        if k % 3 == 1:  # falling sums between positives
            s = np.stack([s, -1.1 * np.abs(s) - 0.01], 1).ravel()[:15]
        got = toxicity.passages(s)
        assert [x[:2] for x in got] == plain(s, 0, len(s))
        assert [x[2] for x in got] == pytest.approx([s[a:b].sum() for a, b, _ in got])


def test_segments_in_linear_time():
    rising = np.tile([1.0, -2.0], 16_000)  # each left sum is below all before
    began = time.perf_counter()
    assert len(toxicity.passages(rising)) == 16_000
    assert time.perf_counter() - began < 1.0
    nested = np.concatenate([np.tile([2.0, -1.0], 8_000), np.tile([1.0, -2.0], 8_000)])
    assert len(toxicity.passages(nested)) == 8_001


def test_toxic_evidence_and_scores(spark):
    """The query's scores from plain segments, evidence and calibration."""
    rng = random.Random(2)
    bad = [f"slur{i}" for i in range(6)]
    rows = [(i, words(rng, 40, 200) + (" " + " ".join(rng.choice(bad) for _ in range(8)) if i % 3 == 0 else ""), "en", "a") for i in range(300)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    for i, text, *_ in rows[:60]:
        data = np.frombuffer(text.encode(), np.uint8)
        values, _ = toxicity.model_scores(model, data, np.array([0, len(data)]))
        worth = []
        for a, b in itertools.combinations(range(len(values) + 1), 2):
            if any((a, b) == x[:2] for x in toxicity.passages(values)):
                worth.append(model.decay * values[a:b].sum() - math.log(toxicity.KARLIN_K * len(values)))
        total = sum(w for w in worth if w > -math.log(toxicity.SIGNIFICANT))
        assert got[i].evidence == pytest.approx(total)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(total)))))
    held = [i for i in range(300)]
    assert sum((got[i].score >= 0.7) == (i % 3 == 0) for i in held) / len(held) >= 0.9
    assert toxicity.toxic_passages(docs.where("doc_id = 0"), model).count() >= 1


def test_resampling_draws_each_row(spark):
    rng = random.Random(6)
    rows = [(None, words(rng, 30, 30), "en", "a") for _ in range(6)] + [(None, "same words", "en", "a")] * 6 + [(i, words(rng, 30, 30), "en", "a") for i in range(20)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = importance.resample(docs, labels, share=0.5).collect()
    noise = [round(r.draw - r.log_weight, 9) for r in got]
    assert len(got) == 32 and sum(r.kept for r in got) == 16 and len(set(noise)) == 32
    assert not any(r.kept for r in importance.resample(docs, labels, share=0.0).collect())
    none = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, quality int")
    assert not any(r.kept for r in importance.resample(docs, none).collect())
    # against the models counted plainly
    def grams(t):
        w = t.split()
        return [*w, *zip(w, w[1:])]

    def bucket(g):
        data = np.frombuffer(" ".join([g] if isinstance(g, str) else g).encode(), np.uint8)
        found = importance.features(data, np.array([0, len(data)]), importance.BUCKETS)[0]
        return int(found[-1])

    target, raw = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, t, *_ in rows:
        for g in grams(t):
            raw[bucket(g)] += 1
            target[bucket(g)] += d is not None and d < 10
    ratio = importance.log_ratio(target, raw)
    want = sorted(round(float(sum(ratio[bucket(g)] for g in grams(t))), 6) for _, t, *_ in rows)
    assert sorted(round(r.log_weight, 6) for r in got) == pytest.approx(want)


def plain_mix(rows):
    """The mix as its contract has it: shares, queues and the cut, one by one."""
    size = [len((t or "").encode().split()) for _, t, _, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, (*_, x) in zip(size, rows) if x == s) for s in names}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
            open_.remove(s)
    return size, own, target


def test_mix_queues_rows_without_an_id_and_repeated_ones(spark):
    rng = random.Random(4)
    rows = [(None, words(rng, 10), "en", "a") for _ in range(1000)] + [(i, words(rng, 10), "en", "b") for i in range(1000)]
    rows += [(5000, "one two three", "en", "b")] * 50 + [(5001, None, "en", "a"), (5002, "", "en", None)]
    size, own, target = plain_mix(rows)
    got = mixing.mix_sources(docs_of(spark, rows), rows_per_bucket=64).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    for s in own:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 30
        assert all(r.target == pytest.approx(target[s]) for r in got if r.source == s)
    out = mixing.mixed_documents(docs_of(spark, rows), rows_per_bucket=64).collect()
    assert len(out) == sum(r.copies for r in got)
    for s in own:
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - target[s]) <= 30
    counts = {}
    for r in out:
        counts[r.text] = counts.get(r.text, 0) + 1
    assert 50 <= counts["one two three"] <= 150 and max(n for t, n in counts.items() if t != "one two three") <= 3


def test_running_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BUCKETS", 4)
    rows = [(i % 3, i, (i * 7) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, size long")
    got = {(r.k, r.at): r.upto for r in mixing.running(df, ["k"], F.floor(F.col("at") / 5), [F.col("at")], "size", "upto", 80).collect()}
    total = {}
    for k, at, size in rows:
        total[k] = total.get(k, 0) + size
        assert got[k, at] == total[k]


def plain_language(text, model, pieces):
    """(language, posterior) by a plain sum over segmentations of each run."""
    import re

    total = np.zeros(len(model.languages))
    found, prob = re.findall(r"[^\W\d_]+", (text or "").lower()), model.prob
    for w in found:
        w = langid.EDGE + w
        sums = [np.ones(len(model.languages))] + [np.zeros(len(model.languages))] * len(w)
        for end in range(1, len(w) + 1):
            for start in range(max(0, end - 40), end):
                number = pieces.get(w[start:end], len(pieces) if end == start + 1 else None)
                if number is not None:
                    sums[end] = sums[end] + sums[start] * prob[number]
        total += np.log(sums[-1])
    if not found:
        return langid.NO_LANGUAGE, 0.0
    return model.languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def piece_numbers():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
    return {p: k for k, p in enumerate(sorted(p for p in some if p.strip(langid.EDGE).isalpha() and langid.EDGE not in p[1:] or p == langid.EDGE))}


EN = "the quick brown fox jumps over the lazy dog while many people in the old town read their books and talk about weather work and music".split()
DE = "der schnelle braune fuchs springt über den faulen hund während viele leute in der alten stadt ihre bücher lesen und über wetter und arbeit reden".split()


def test_language_query_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(EN) for _ in range(30)), "en", "a") for i in range(60)] + [(100 + i, " ".join(rng.choice(DE) for _ in range(30)), "de", "a") for i in range(60)]
    odd = [(500, None, None, None), (501, "", "en", None), (502, "12 -- ٣", "en", None), (503, "the der fuchs dog", None, None), (504, "Привет как дела сегодня хорошая погода в нашем старом городе", None, None), (505, "qzx vvkj " * 40, None, None), (None, "der hund", "de", None)]
    docs = docs_of(spark, rows + odd)
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"), PIECES)
    pieces = piece_numbers()
    got = {r.doc_id: r for r in langid.identify(docs, PIECES).collect()}
    for d, t, *_ in rows + odd:
        lang, score = plain_language(t, model, pieces)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-9)
    kept = {r.doc_id for r in langid.keep_known(docs, PIECES).collect()}
    assert kept >= {d for d, *_ in rows} and not kept & {500, 501, 502, 504, 505}


def test_runs_longer_than_a_block(monkeypatch):
    """Runs summed one by one equal those summed together, over any cut."""
    monkeypatch.setattr(langid, "BLOCK", 37)
    vocab = langid.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    prob = np.zeros((vocab.size + 2, 2))
    prob[: vocab.size] = rng.random((vocab.size, 2)) / vocab.size
    prob[vocab.size] = langid.UNKNOWN
    runs = [langid.EDGE + "".join(rng.choice(list("etaoinshrdlu漢"), n)) for n in (1, 36, 37, 38, 75, 255, 700)]
    alone = np.stack([langid.long_log_likelihood(w, vocab, prob) for w in runs])
    monkeypatch.setattr(langid, "LONG_RUN", 10_000)
    assert np.allclose(alone, langid.log_likelihood(runs, vocab, prob))


def plain_removal(texts, words):
    """Texts without the words of every sequence of so many that is also elsewhere;
    the space behind a word goes with it."""
    import re

    seen, split = {}, [re.findall(r"[^\x20\t-\r]+[\x20\t-\r]*", x) for x in texts]
    for w in split:
        for i in range(len(w) - words + 1):
            key = tuple(x.strip() for x in w[i : i + words])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(x.strip() for x in w[i : i + words])] > 1:
                gone |= set(range(i, i + words))
        out.append("".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_pipeline(spark, tmp_path):
    """Each stage by brute force on what the stage before kept; planted passages
    of over 50 words go, clean documents stay as they are."""
    import corpus_pipeline
    import tiktoken

    rng = random.Random(11)
    passage = " ".join(rng.choice(EN) for _ in range(51))
    assert corpus_pipeline.PASSAGE_WORDS <= 51
    rows = [(i, " ".join(f"{rng.choice(EN)}{rng.choice(['', 's', 'er', 'ly'])}" for _ in range(rng.randrange(40, 120))), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(DE) for _ in range(50)) + f" ende {i}.", "de", "ab"[i % 2]) for i in range(40)]
    rows += [(200 + i, f"{' '.join(rng.choice(EN) + str(i) for _ in range(60))} {passage}", "en", "a") for i in range(5)]
    rows += [(300 + i, rows[i][1], "en", "c") for i in range(5)]  # copies
    rows += [(400, None, "en", "a"), (401, "", "de", None), (402, "123 456", "en", "a"), (None, "the old dog and the people of the town", "en", "b"), (403, "Привет как дела сегодня хорошая погода в городе", None, "a")]
    docs_of(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    now = docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
        stages[name] = sorted((tuple(r) for r in out.collect()), key=repr)
        now = out
    # language: by plain sums, with the model of the rows that it may learn from
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"), PIECES)
    pieces = piece_numbers()
    likely = [d for d, t, *_ in rows if plain_language(t, model, pieces)[1] >= 0.5]
    assert sorted((r[0] for r in stages["language_id"]), key=repr) == sorted((d for d in likely if d != 403), key=repr)
    # near duplicates: the least id of each group of fingerprints
    held = stages["language_id"]
    label = find_groups([simhash.fingerprint(r[1].encode()) for r in held])
    want = [min((r for r, k in zip(held, label) if k == g), key=lambda r: (r[0] is None, r[0])) for g in set(label)]
    assert stages["simhash_dedup"] == sorted(want, key=repr) and not {r[0] for r in want} & set(range(300, 305))
    # passages: every sequence of so many words that starts anywhere else
    held = stages["simhash_dedup"]
    texts = plain_removal([r[1] for r in held], corpus_pipeline.PASSAGE_WORDS)
    assert stages["suffix_array_dedup"] == sorted(((r[0], t, r[2], r[3], len(t)) for r, t in zip(held, texts)), key=repr)
    assert not any(passage in r[1] for r in stages["suffix_array_dedup"])
    before = {r[0]: r[1] for r in held}
    assert all(before[r[0]] == r[1] for r in stages["suffix_array_dedup"] if r[0] is None or r[0] < 200)
    # mix: near the targets, rows unchanged, at most three times
    held = stages["suffix_array_dedup"]
    size, own, target = plain_mix([(r[0], r[1], r[2], r[3]) for r in held])
    for s in own:
        assert abs(sum(len(r[1].split()) for r in stages["source_mix"] if r[3] == s) - target[s]) <= 2 * max(size)
    assert all(r in held for r in stages["source_mix"]) and max(stages["source_mix"].count(r) for r in held) <= 3
    # tokens: the library's
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=__import__("quantloom.llm.bpe", fromlist=["load"]).load(RANKS).ranks, special_tokens={})
    ids = [(r[0], enc.encode_ordinary(r[1]), r[1]) for r in stages["source_mix"]]
    want = [(d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, x, t in ids]
    assert stages["byte_bpe"] == sorted(want, key=repr)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == stages["byte_bpe"]
