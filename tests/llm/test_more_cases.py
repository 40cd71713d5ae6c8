"""Clashing names, planted pairs through the query, repeated queries, plain counts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann_tree, bpe, importance, lattice, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int, node long, copies long, codes int, t int, probe int, cell int, bucket long, pair long, side int, leaf int, tile int, is_query int, shard int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], k, *range(13)) for i, v, k in rows], VECTORS)


def planted(d=64):
    """Unit vectors, some with one at a cosine of 0.93 to 0.95 or just under it."""
    rng = np.random.default_rng(6)
    rows, want = [], set()
    for i in range(0, 240, 3):
        a, b = rng.standard_normal((2, d))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = (0.9305, 0.94, 0.95, 0.9295, 0.9)[i // 3 % 5]
        rows += [(i, a, 1), (i + 1, cosine * a + math.sqrt(1 - cosine**2) * b, 1), (i + 2, a, 2)]
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for p, q in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))):
        if rows[p][2] == rows[q][2]:
            want.add((rows[p][0], rows[q][0]))
    return rows, want


def test_planted_pairs_through_the_query(spark, tmp_path):
    from quantloom.llm import queries

    rows, want = planted()
    assert len(want) == 48
    vectors(spark, rows).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op5_lattice_groups(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    found = {(r.component_id, r.vec_id) for r in got.values() if not r.kept}
    assert len(found & want) >= 0.99 * len(want) and found <= want
    assert all(got[q].n_links == got[p].n_links == 1 for p, q in found)


def test_vector_columns_of_any_name(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8), i % 2) for i in range(40)]
    df = vectors(spark, rows)
    plain = df.select("vec_id", "embedding", "label")
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == sorted(map(tuple, lattice.near_duplicates(plain).collect()))
    found = lambda t: sorted(map(tuple, ann_tree.search(t, F.col("vec_id") % 10 == 0).collect()))
    assert found(df) == found(plain) and len(found(df)) == 40
    docs = spark.createDataFrame([(1, "one two", 5, 6, 7), (2, None, 5, 6, 7)], "doc_id long, text string, n_tokens int, ids int, key int")
    out = bpe.round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"))
    assert sorted((r.doc_id, r.n_tokens > 0) for r in out.collect()) == [(1, True), (2, False)]


def test_a_repeated_query_is_answered_alike_in_any_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6), 1) for i in range(1, 300)] + [(0, rng.standard_normal(6), 1), (0, rng.standard_normal(6), 1)]
    answers = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = vectors(spark, rows).repartition(seed + 1)
        answers.add(tuple((r["rank"], r.vec_id) for r in ann_tree.search(df, F.col("vec_id") == 0, leaf_rows=400).orderBy("rank").collect()))
    assert len(answers) == 1
    asked = min((v.astype(np.float32).tolist() for i, v, _ in rows if i == 0))
    dist = sorted((float(np.linalg.norm(v.astype(np.float32).astype(float) - np.array(asked))), i) for i, v, _ in rows if i)
    assert [v for _, v in answers.pop()] == [i for _, i in dist[:10]]


def test_weights_leave_no_trace_of_their_neighbours(spark):
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(30))
    ratio = np.random.default_rng(1).standard_normal(importance.BUCKETS) * 1e3
    rows = [(i, text if i % 7 == 0 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(200)) if i % 7 < 5 else None) for i in range(210)]
    got = importance.weights(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ratio).collect()
    assert len({r.log_weight for r in got if r.doc_id % 7 == 0}) == 1 and len(got) == 210


def test_token_log_odds_by_plain_counts(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["slurring", "slurred", "vile", "kind", "word", "wordy", "old"][: 7 if i % 2 else 4][:: 1 if i % 2 else -1] + ["the", "a", "thing"]) for _ in range(12)), int(i % 2 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    keys, scores = toxicity.token_scores(df)
    bad, clean = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    base = math.log((bad + 0.5) / (clean + 0.5))
    seen, parents = [{} for _ in range(len(toxicity.PREFIXES) + 1)], {}
    for text, toxic in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        levels, _ = toxicity.tokens(data, np.array([0, len(data)]))
        for level, h in enumerate(levels):
            for k in {int(x) for x in h if x}:
                counts = seen[level].setdefault(k, [0, 0])
                counts[0 if toxic else 1] += 1
            for i in range(len(h)):
                above = [int(levels[j][i]) for j in range(level) if levels[j][i]]
                if h[i]:
                    parents[level, int(h[i])] = above[-1] if above else 0
    odds = {}
    for level, counts in enumerate(seen):
        want = {}
        for k, (t, c) in counts.items():
            if t < toxicity.LEAST_DOCS:
                continue
            above = odds.get(parents[level, k], 0.0)
            rate = 1 / (1 + math.exp(-(base + above)))
            a, b = t + toxicity.PRIOR_DOCS * rate, c + toxicity.PRIOR_DOCS * (1 - rate)
            own = odds[k] = math.log(a / b) - base
            if own > 0 and own / math.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z:
                want[k] = own
            elif above > 0:
                want[k] = min(own, above) if own > 0 else -toxicity.GAP
        assert dict(zip(map(int, keys[level]), scores[level])) == pytest.approx(want)
    assert any(len(k) for k in keys)


def test_an_empty_table_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
