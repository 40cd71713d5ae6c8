"""Nothing hangs on how long texts are, how many languages or how short words."""

import random

import numpy as np
import pytest

from quantloom.llm import langid, suffix_dedup

tokenizers = pytest.importorskip("public_tokenizers")
PIECES = tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog while many people in the old town read their books and talk about weather work and music".split()
DE = "der schnelle braune fuchs springt über den faulen hund während viele leute in der alten stadt ihre bücher lesen und über wetter und arbeit reden".split()
FR = "le renard brun saute par dessus le chien paresseux pendant que beaucoup de gens lisent leurs livres dans la vieille ville et parlent du temps".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows], SCHEMA)


def say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_a_language_of_long_texts_only(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, EN, 6000), "en") for i in range(11)] + [(100 + i, say(rng, FR, 20), "fr") for i in range(8)]
    assert all(len(t) > 20_000 for _, t, lang in rows if lang == "en")
    for some in (rows, rows[:11]):
        got = {r.doc_id: r.lang_pred for r in langid.identify(docs_of(spark, some), PIECES).collect()}
        assert got == {d: lang for d, _, lang in some}
    assert langid.keep_known(docs_of(spark, rows), PIECES).count() == len(rows)


def test_the_sample_is_of_whole_texts_and_its_most_frequent_words(spark):
    docs = docs_of(spark, [(i, f"common words here {'x' * (300 + i)} {chr(97 + i) * 3}", "en") for i in range(20)])
    counted = {r.word: r.n for r in langid.counted_words(docs.select("lang", "text"), 4).collect()}
    assert {"common": 20, "words": 20, "here": 20}.items() <= counted.items() and len(counted) == 4


def test_many_languages(spark):
    """1,200 languages, each with words of its own, are all learned."""
    rng = random.Random(2)
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for _ in range(1200)]
    rows = [(k * 10 + i, " ".join(own[k] * 3), f"l{k:04d}") for k in range(1200) for i in range(3)]
    docs = docs_of(spark, rows).repartition(4)
    model = langid.fit(docs.select("doc_id", "text", "lang"), PIECES, rounds=2)
    assert len(model.languages) == 1200 and sum(map(len, model.pieces)) < 1200 * 400
    some = docs.where("doc_id % 1000 = 0")
    got = {r.doc_id: r.lang_pred for r in langid.predict(some, model).collect()}
    assert got == {d: lang for d, _, lang in rows if d % 1000 == 0}


def test_short_texts_of_no_known_language(spark):
    rng = random.Random(3)
    rows = [(i, say(rng, EN, rng.choice([1, 2, 3, 30])), "en") for i in range(200)] + [(500 + i, say(rng, DE, rng.choice([1, 2, 3, 30])), "de") for i in range(200)]
    odd = [(1000, "Привет", None), (1001, "как дела", None), (1002, "你好吗", None), (1003, "zxqv kjwq", None), (1004, "今日はいい天気ですね", None)]
    kept = {r.doc_id for r in langid.keep_known(docs_of(spark, rows + odd), PIECES).collect()}
    assert not kept & {d for d, *_ in odd}
    told = {d for d, *_ in rows}
    assert len(kept & told) >= 0.97 * len(told)  # a word may be of both languages
    coded = docs_of(spark, [*rows, (2000, f"{say(rng, EN, 40)} xkqzvjwpq", None)])
    assert 2000 in {r.doc_id for r in langid.keep_known(coded, PIECES).collect()}


def test_what_a_text_is_allowed_grows_with_it():
    n = np.arange(1, 2000.0)
    spare = langid.allowed(np.zeros(len(n)), n) * n
    assert (np.diff(spare) > 0).all() and spare[0] < 2 and spare[-1] < langid.ALLOWANCE


def plain_passages(texts, words):
    seen = {}
    split = [t.split() for t in texts]
    for w in split:
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])] = seen.get(tuple(w[i : i + words]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone |= set(range(i, i + words))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_of_short_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 3])))
    passage = [word() for _ in range(51)]
    short = passage[:40]
    texts = []
    for i in range(40):
        own = [word() for _ in range(rng.randrange(0, 90))]
        cut = rng.randrange(len(own) + 1)
        extra = passage if i % 4 == 0 else short if i % 4 == 1 else []
        texts.append("\n ".join(own[:cut]) + " " + rng.choice([" ", "\t\n"]).join(extra) + "  " + " ".join(own[cut:]))
    texts += ["ab " * 200, "", "ünï " * 30, texts[2], "x" * 90 + " " + " ".join(passage)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, None, "en"), (3, texts[3], "en")]
    got = suffix_dedup.remove_passages(docs_of(spark, rows), 50)
    assert got.columns == docs_of(spark, rows[:1]).columns
    found = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").split()) for r in got.collect())
    want = plain_passages([t or "" for _, t, _ in rows], 50)
    assert found == sorted((d if d is not None else -1, w) for (d, _, _), w in zip(rows, want))
    same = {r.doc_id: r.text for r in got.collect()}
    assert all(same[d] == t for (d, t, _), w in zip(rows, want) if d not in (None, 3) and w == t.split())
    assert suffix_dedup.remove_passages(docs_of(spark, []), 50).count() == 0
