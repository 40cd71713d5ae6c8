"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import grouped, keep, map_arrow, mix, stage, text_bytes

RUN = re.compile(r"[^\W\d_]+")
EDGE = "▁"
LONG_RUN, BLOCK = 256, 1 << 14  # letters; longer runs are summed one by one, a block of starts at a time
UNKNOWN = 1e-7
SCALE = 16.0  # of a probability for each character, so that usual words stay in range
LOW, HIGH = 1e-100, 1e100  # sums out of this range are scaled anew
SAMPLE_DOCS, SAMPLE_WORDS, ROUNDS = 500, 50_000, 4  # of a language: documents, whole, and their most frequent words
FOLDS = 5
NO_LANGUAGE = "und"
CACHED_CELLS = 1 << 20  # scores of words that a worker keeps
TOGETHER = 64  # languages whose sums are held at a time
MARGIN = 1.0  # log units a letter under nearly all of the sample: no known language
ALLOWANCE, HALF = 60.0, 30.0  # log units that a text is allowed once, for a code or a key, and letters at which it has half of them


@dataclass
class Vocabulary:
    """Letter pieces of a fixed public vocabulary, by hash."""

    keys: np.ndarray
    index: np.ndarray
    size: int
    longest: int


def char_hash(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words end to end, and len + 1 offsets."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


MULTIPLY = np.uint64(0x2545F4914F6CDD1D)


def vocabulary(path: str) -> Vocabulary:
    return keep(f"langid:{path}", lambda: read_vocabulary(path))


def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    pieces = sorted(p for p in pieces if p.strip(EDGE).isalpha() and EDGE not in p[1:] or p == EDGE)
    points, at = char_hash(pieces)
    keys = np.array([fold(points[a:b]) for a, b in zip(at, at[1:])], np.uint64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], order.astype(np.int64), len(pieces), max(map(len, pieces)))


def fold(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for p in points:
        h = (h ^ np.uint64(p)) * MULTIPLY + np.uint64(1)
    return mix(h)[0]


def lattice(words: list[str], vocab: Vocabulary, width: int) -> list[np.ndarray]:
    """For each piece length, the piece number at each (word, start); the number
    `size` is an unknown character, -1 no piece. Words have the edge mark in front."""
    n = len(words)
    points = np.zeros((n, width), np.uint32)
    flat, at = char_hash(words)
    size = np.diff(at)
    points[np.arange(width) < size[:, None]] = flat
    found = []
    h = np.zeros((n, width), np.uint64)
    for length in range(1, min(vocab.longest, width) + 1):
        starts = width - length + 1
        h = (h[:, :starts] ^ points[:, length - 1 :].astype(np.uint64)) * MULTIPLY + np.uint64(1)
        ok = np.arange(starts) + length <= size[:, None]
        key = mix(h[ok])
        place = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        number = np.where(vocab.keys[place] == key, vocab.index[place], vocab.size if length == 1 else -1)
        out = np.full((n, starts), -1, np.int64)
        out[ok] = number
        found.append(out)
    return found


def rescale(sums: np.ndarray, shift: np.ndarray, at: int, reach: slice) -> None:
    """Brings sums[at] back to 1 where it has left the range, together with all
    that later steps read, sums[reach]; shift is the logarithm of what was divided out."""
    now = sums[at]
    off = (now > 0) & (now < LOW) | (now > HIGH)
    if off.any():
        factor = np.where(off, now, 1.0)
        sums[reach] /= factor
        shift[reach] += np.log(factor)


def forward(found: list[np.ndarray], prob: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled sums over all segmentations of each prefix, (width + 1, words, languages),
    and the logarithms to add to theirs.
    The last row of prob is all zero and stands for no piece."""
    n, langs = len(found[0]), prob.shape[1]
    alpha = np.zeros((width + 1, n, langs))
    shift = np.zeros((width + 1, n, langs))
    alpha[0] = 1.0
    for end in range(1, width + 1):
        shift[end] = shift[end - 1]
        for length in range(1, min(len(found), end) + 1):
            number = found[length - 1][:, end - length]
            some = np.flatnonzero(number >= 0)
            if len(some):
                alpha[end, some] += alpha[end - length, some] * prob[number[some]] * SCALE**length
        rescale(alpha, shift, end, slice(max(0, end - len(found) + 1), end + 1))
    return alpha, shift


def by_width(words: list[str], langs: int = 1) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of words of like length, and a width for each; the sums of a part and
    `langs` languages stay within a bound."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    low, width, most = 0, 6, int(size.max(initial=0))
    while low < most:
        which = np.flatnonzero((size > low) & (size <= width))
        for part in np.array_split(which, len(which) * width * langs // 1_600_000 + 1):
            if len(part):
                yield part, width
        low, width = width, width * 3 // 2


def long_log_likelihood(word: str, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """The same sum for one run of any length: it holds the sums of as many next
    prefixes as the longest piece has letters, and one block of starts."""
    longest = vocab.longest
    ahead = np.zeros((longest + 1, prob.shape[1]))
    ahead[0] = 1.0
    shift = np.zeros(prob.shape[1])
    scale = SCALE ** np.arange(1, longest + 1)[:, None]
    for a in range(0, len(word), BLOCK):
        part = word[a : a + BLOCK + longest - 1]
        starts = min(BLOCK, len(word) - a)
        number = np.full((longest, starts), -1, np.int64)
        for k, row in enumerate(lattice([part], vocab, len(part))):
            own = row[0, :starts]
            number[k, : len(own)] = own
        for i in range(starts):
            now = ahead[0].copy()
            if now.min() < LOW or now.max() > HIGH:
                ahead /= now
                shift += np.log(now)
                now = np.ones_like(now)
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0.0
            ahead[:longest] += now * prob[number[:, i]] * scale
    return np.log(ahead[0]) + shift - len(word) * np.log(SCALE)


def log_likelihood(words: list[str], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over segmentations."""
    if prob.shape[1] > TOGETHER:
        return np.concatenate([log_likelihood(words, vocab, np.ascontiguousarray(prob[:, k : k + TOGETHER])) for k in range(0, prob.shape[1], TOGETHER)], axis=1)
    out = np.zeros((len(words), prob.shape[1]))
    for i in (i for i, w in enumerate(words) if len(w) > LONG_RUN):
        out[i] = long_log_likelihood(words[i], vocab, prob)
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONG_RUN], np.int64)
    for part, width in by_width([words[i] for i in short], prob.shape[1]):
        part = short[part]
        chosen = [words[i] for i in part]
        alpha, shift = forward(lattice(chosen, vocab, width), prob, width)
        size = np.fromiter(map(len, chosen), np.int64, len(chosen))
        end = size, np.arange(len(chosen))
        out[part] = np.log(alpha[end]) + shift[end] - size[:, None] * np.log(SCALE)
    return out


def expected(words: list[str], weight: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words in one language, over all segmentations."""
    counts = np.zeros(len(prob))
    for part, width in by_width(words):
        chosen = [words[i] for i in part]
        found = lattice(chosen, vocab, width)
        alpha, shift = (a[:, :, 0] for a in forward(found, prob, width))
        size = np.fromiter(map(len, chosen), np.int64, len(chosen))
        n = len(chosen)
        beta = np.zeros((width + 1, n))
        beta[size, np.arange(n)] = 1.0
        shift_beta = np.zeros((width + 1, n))
        whole = np.log(alpha[size, np.arange(n)]) + shift[size, np.arange(n)]
        for start in range(width - 1, -1, -1):
            shift_beta[start] = shift_beta[start + 1]
            before = alpha[start] * np.exp(shift[start] + shift_beta[start] - whole)
            for length in range(1, min(len(found), width - start) + 1):
                number = found[length - 1][:, start]
                some = np.flatnonzero(number >= 0)
                if len(some):
                    step = prob[number[some], 0] * SCALE**length * beta[start + length, some]
                    beta[start, some] += step
                    np.add.at(counts, number[some], weight[part[some]] * before[some] * step)
            rescale(beta, shift_beta, start, slice(start, start + len(found)))
    return counts


@dataclass
class Model:
    """Piece probabilities by language. Most pieces are in no text of a language's
    sample and share its least probability, so only the others are kept."""

    languages: list[str]
    least: np.ndarray  # of a piece, by language
    pieces: list[np.ndarray]
    shares: list[np.ndarray]
    vocabulary_path: str
    floor: np.ndarray | None = None  # least log likelihood a letter, allowance included, of a text in each language

    @cached_property
    def key(self) -> int:
        return hash((tuple(self.languages), self.least.tobytes(), *(p.tobytes() for p in self.shares)))

    @cached_property
    def prob(self) -> np.ndarray:
        """(pieces + 2, languages): all probabilities, an unknown character's, and none."""
        size = vocabulary(self.vocabulary_path).size
        out = np.zeros((size + 2, len(self.languages)))
        out[:size] = self.least
        for k, (number, share) in enumerate(zip(self.pieces, self.shares)):
            out[number, k] = share
        out[size] = UNKNOWN
        return out


def letters(text: str) -> list[str]:
    return RUN.findall(text.lower())


def maximised(rows: pa.Table, vocabulary_path: str, rounds: int) -> pa.Table:
    """lang, least, pieces, shares: expectation-maximisation over one language's (lang, word, n)."""
    vocab = vocabulary(vocabulary_path)
    spelled = [EDGE + w for w in rows.column("word").to_pylist()]
    weight = rows.column("n").to_numpy().astype(float)
    p = np.full((vocab.size + 2, 1), 1.0 / vocab.size)
    for _ in range(rounds):
        p[vocab.size], p[-1] = UNKNOWN, 0.0
        c = expected(spelled, weight, vocab, p)[: vocab.size] + 0.01
        p[: vocab.size, 0] = c / c.sum()
    share = p[: vocab.size, 0]
    some = np.flatnonzero(share > share.min())
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()], pa.string()), "least": pa.array([share.min()]), "pieces": pa.array([some.astype(np.int32)], pa.list_(pa.int32())), "shares": pa.array([share[some]], pa.list_(pa.float64()))})


def sample_of(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, text: at most sample_docs different rows a language of (doc_id, text,
    lang), by a hash, whole. A cut of the hashes by each language's count comes
    first, so that few hashes of any language meet."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    drawn = docs.select("lang", "text", draw.alias("draw")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row a language each, staged, so that Spark knows their sizes and shuffles no text to meet them
    counts = stage(drawn.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    near = drawn.select("lang", "draw").join(counts, "lang").where(F.col("draw") / float(1 << 63) * F.col("rows") < 8.0 * sample_docs).select("lang", "draw").distinct()
    turn = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    cut = stage(near.withColumn("turn", turn).where(F.col("turn") <= sample_docs).groupBy("lang").agg(F.max("draw").alias("cut")), "cuts")
    return drawn.join(cut, "lang").where(F.col("draw") <= F.col("cut")).groupBy("lang", "draw").agg(F.first("text").alias("text")).select("lang", "text")


def counted_words(sample: DataFrame, sample_words: int) -> DataFrame:
    """lang, word, n: the most frequent runs of letters of each language's sample.
    Runs over LONG_RUN letters count in parts of so many."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{LONG_RUN - 1}}})")))
    counted = sample.select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counted.withColumn("turn", turn).where(F.col("turn") <= sample_words).select("lang", "word", "n")


def fit(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, rounds: int = ROUNDS) -> Model | None:
    """Piece probabilities of each language from rows of (doc_id, text, lang).

    The fit sees at most sample_docs documents of a language, chosen by a hash,
    whole, and the sample_words most frequent of their words; Spark sums them up,
    and expectation-maximisation over them runs a language a task. Every language
    with a letter in its sample is learned, however many there are and however long
    its texts. No labelled row with a letter: None. Null texts and languages, and
    rows that repeat, add nothing.
    """
    sample = stage(sample_of(docs, sample_docs), "sample")
    counted = stage(counted_words(sample, sample_words), "words")
    many = counted.select("lang").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["lang"]):
            yield from maximised(rows, vocabulary_path, rounds).to_batches()

    if not many:
        return None
    # a language a task, up to as many tasks as a shuffle may have
    place = F.dense_rank().over(W.orderBy("lang")) - 1
    places = counted.select("lang").distinct().withColumn("place", place.cast("int"))
    dealt = counted.join(places, "lang").repartitionById(min(many, 1_000), F.col("place") % 1_000).sortWithinPartitions("lang", "word")
    found = map_arrow(dealt.select("lang", "word", "n"), run, "lang string, least double, pieces array<int>, shares array<double>").toArrow().sort_by("lang")
    numpy = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in found.column(c)]
    model = Model(found.column("lang").to_pylist(), found.column("least").to_numpy(), numpy("pieces"), numpy("shares"), vocabulary_path)
    seen = evidence(sample, model).where("letters > 0").groupBy("lang").agg(F.percentile_approx("likely", 0.01, 10_000).alias("low")).collect()
    low = {r["lang"]: r["low"] for r in seen}
    model.floor = np.array([low.get(x, -np.inf) - MARGIN for x in model.languages])
    return model


def allowed(likely: np.ndarray, letters_: np.ndarray) -> np.ndarray:
    """The log likelihood a letter, with what a text of so many letters is allowed:
    the more letters, the more, up to ALLOWANCE in all."""
    return (likely + ALLOWANCE * letters_ / (letters_ + HALF)) / np.maximum(letters_, 1.0)


def sent(docs: DataFrame, model: Model | None):
    """A function that gives the model in a task: it is broadcast once, and each
    worker lays out its probabilities once."""
    if model is None:
        return lambda: None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda: shared.value


def evidence(sample: DataFrame, model: Model) -> DataFrame:
    """lang, letters, likely: the log likelihood a letter of each text in its own
    language, allowance included."""
    get = sent(sample, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(get().languages)}
        for batch in batches:
            own = np.array([number.get(x, 0) for x in batch.column(0).to_pylist()], np.int64)
            total = totals(batch.column(1), get())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[:, -1].astype(np.int64)), pa.array(allowed(total[np.arange(len(own)), own], total[:, -1]))], ["lang", "letters", "likely"])

    return map_arrow(sample.select("lang", "text"), run, "lang string, letters long, likely double")


class Words:
    """Scores of the words this worker has met; emptied when there are too many."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.score: np.ndarray | None = None

    @classmethod
    def of(cls, model: Model) -> "Words":
        return keep(f"langid:{model.key}", cls)

    def slots(self, words: list[str], model: Model) -> np.ndarray:
        if len(self.slot) * (len(model.languages) + 1) > CACHED_CELLS:
            self.__init__()
        get = self.slot.get
        new = list({w for w in words if w not in self.slot})
        if new:
            score = np.zeros((len(new), len(model.languages) + 1))
            clean = ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in new]
            some = [i for i, w in enumerate(clean) if w]
            if some:
                score[some, :-1] = log_likelihood([EDGE + clean[i] for i in some], vocabulary(model.vocabulary_path), model.prob)
            score[:, -1] = [len(w) for w in clean]
            base = 0 if self.score is None else len(self.score)
            self.slot.update(zip(new, range(base, base + len(new))))
            self.score = score if self.score is None else np.concatenate([self.score, score])
        return np.fromiter(map(get, words), np.int64, len(words))


def totals(texts: pa.Array, model: Model) -> np.ndarray:
    """(rows, languages + 1): the log likelihood of each whole text, and its letters."""
    data, at = text_bytes(texts)
    whole, at = data.tobytes(), at.tolist()
    found: list[np.ndarray] = [np.zeros((0, len(model.languages) + 1))]
    row = 0
    while row < len(at) - 1:
        words: list[str] = []
        ends = [0]
        while row < len(at) - 1 and len(words) * (len(model.languages) + 1) < 5_000_000:
            words += letters(whole[at[row] : at[row + 1]].decode("utf-8", "ignore"))
            ends.append(len(words))
            row += 1
        first, last = np.array(ends[:-1]), np.array(ends[1:])
        total = np.zeros((len(first), len(model.languages) + 1))
        if words:
            seen = Words.of(model)
            slot = seen.slots(words, model)
            total[first < last] = np.add.reduceat(seen.score[slot], first[first < last], axis=0)
        found.append(total)
    return np.concatenate(found)


def score_texts(texts: pa.Array, model: Model | None) -> tuple[list[str], list[float], np.ndarray]:
    """The language and the score of each text, and whether its letters are as
    likely as those of the language's sample."""
    if model is None:
        return [NO_LANGUAGE] * len(texts), [0.0] * len(texts), np.zeros(len(texts), bool)
    total = totals(texts, model)
    likely, letters_ = total[:, :-1], total[:, -1]
    best = likely.argmax(1)
    posterior = 1.0 / np.exp(np.maximum(likely - likely.max(1, keepdims=True), -700.0)).sum(1)
    some = letters_ > 0
    floor = model.floor if model.floor is not None else np.full(len(model.languages), -np.inf)
    like = allowed(likely[np.arange(len(best)), best], letters_) >= floor[best]
    return [model.languages[b] if s else NO_LANGUAGE for b, s in zip(best, some)], np.where(some, posterior, 0.0).tolist(), like


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score: a row a document, from its whole text.

    score is the language's posterior under equal priors. Null texts and texts
    without a letter, and every text if there is no model, get `und` and 0. One
    pass, no shuffle; repeated rows are returned each.
    """
    get = sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _ = score_texts(batch.column(1), get())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return map_arrow(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def held_out(folds: int = FOLDS):
    """True for rows that no fit learns from; also where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, vocabulary_path: str, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model that
    learns from the rows that aren't held out.

    Null and empty texts and those without a letter get `und` and 0, as all do
    where no labelled row has a letter; of languages that are as likely the first by
    name is told. A null doc_id is held out. Rows that repeat are returned each. Very
    long texts are scored whole. An empty table gives no rows; columns other than
    doc_id, text and lang are ignored.
    """
    model = fit(docs.where(~held_out(folds)).select("doc_id", "text", "lang"), vocabulary_path)
    return predict(docs, model).select("doc_id", held_out(folds).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, vocabulary_path: str, least: float = 0.5, folds: int = FOLDS) -> DataFrame:
    """The documents in a known language, with their columns.

    Rejected are texts whose language has a posterior under `least` among those
    learned, null texts and texts without a letter among them, and texts that are
    less likely, a letter, than 99 in 100 of the language's sample by more than
    MARGIN, after what `allowed` allows them: what is in none of the languages. The
    rule is the same for texts of any length; very long ones are taken whole. Rows
    that repeat stay or go together; columns of any names stay; without a labelled
    row all go; an empty table gives none.
    """
    model = fit(docs.where(~held_out(folds)).select("doc_id", "text", "lang"), vocabulary_path)
    place, get = docs.columns.index("text"), sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, like = score_texts(batch.column(place), get())
            yield batch.filter(pa.array((np.array(score) >= least) & like))

    return map_arrow(docs, run, docs.schema)
