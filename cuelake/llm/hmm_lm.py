"""Language model scoring with a hidden Markov model, beside a unigram base.

Tokens: words of the text with A-Z in lower case, then one end token.

Counts of all training words come first, in one table (combined in each task,
then by word).  The OWN most frequent words and the end are symbols of their
own; every other word belongs to one of CLASSES classes by its last two bytes.
An HMM with STATES states runs over symbols, and a word of a class has the
class's symbol probability times its smoothed share of the class, so that a
text has an exact probability.

Training is Baum-Welch: each task runs scaled forward and backward recursions
over its texts and gives expected counts, which Spark sums.  Each of ROUNDS
rounds runs over all training texts.

The HEAD most frequent words go to every task (a fixed bound).  Rarer words of
a text leave as (word, times) rows, meet their counts in a sort-merge join on
the word, and come back as one sum for each text; being rare, no such word is
hot.

Defined results: null and empty texts have the end token alone; equal rows get
equal rows, also with equal ids; a null doc_id counts as the empty text in the
fold; with no training text all counts are 0 and the model is uniform; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, crc_mod, staged, table

STATES = 4
OWN = 512
CLASSES = 64
HEAD = 1 << 18
SMOOTH = 0.1
ROUNDS = 5
SEED = 10
#: Entries of a task's word counter, and tokens of a recursion, at a time.
_WORDS = 400_000
_TOKENS = 400_000


def class_of(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-2:]) % classes


def word_counts(train: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, class, n) over all texts, without the end token."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array([class_of(w, classes) for w in words], pa.int32()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["word", "class", "n"],
            )

        counts: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                counts.update(text.lower().split())
                if len(counts) > _WORDS:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    made = train.select("text").mapInArrow(counted, "word binary, class int, n bigint")
    return made.groupBy("word", "class").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What tasks need to encode texts: the head words and the sums over the rest."""

    def __init__(self, head: list[tuple[bytes, int]], texts: int, sums: dict[int, tuple[int, int]], own: int, classes: int):
        """head: (word, n) by falling n; sums: class to (tokens, distinct words) of all words."""
        self.n_own, self.classes = min(own, len(head)), classes
        self.end = self.n_own
        self.symbols = self.n_own + 1 + classes
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head] + [0], float)
        self.symbol = np.array([i if i < self.n_own else self.n_own + 1 + class_of(w, classes) for i, (w, _) in enumerate(head)] + [0], np.int16)
        self.texts = texts
        self.total = texts + sum(n for n, _ in sums.values())
        distinct = sum(v for _, v in sums.values()) + (texts > 0)
        self.base_size = self.total + SMOOTH * (distinct + 1)
        tokens, kinds = np.zeros(classes), np.zeros(classes)
        for c, (n, v) in sums.items():
            tokens[c], kinds[c] = n, v
        for w, n in head[: self.n_own]:
            tokens[class_of(w, classes)] -= n
            kinds[class_of(w, classes)] -= 1
        self.class_log = np.log10(tokens + SMOOTH * (kinds + 1))


def vocabulary(counts: DataFrame, texts: int, own: int = OWN, classes: int = CLASSES, head: int = HEAD) -> Vocabulary:
    """counts must be staged.  The head holds all words with a count at or above the least that keeps it in bound."""
    sums = {r["class"]: (r.n, r.v) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    # Distinct counts are few: with N tokens, fewer than the square root of 2 N.
    levels = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    held, least = 0, None
    for n, words in levels:
        if held + words > head:
            break
        held, least = held + words, n
    rows = counts.filter(F.col("n") >= least).select("word", "n").toPandas() if least else None
    pairs = [] if rows is None else sorted(zip(map(bytes, rows.word), map(int, rows.n)), key=lambda x: (-x[1], x[0]))
    return Vocabulary(pairs, texts, sums, own, classes)


ENCODED = (
    "rid bigint, doc_id bigint, held_out boolean, symbols binary, n_tokens bigint, head_known bigint, "
    "base double, inside double, tail array<struct<word:binary,times:int>>"
)


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, held_out, text) to the symbols and sums of each text, with what is left to look up.

    base is the unigram sum over head words and the end; inside the sum of class
    shares; both lack log10(n + SMOOTH) of the words in tail but not their sizes.
    """
    held = docs.sparkSession.sparkContext.broadcast(words)
    kinds = [
        pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
        pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())])),
    ]
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        get, rare = v.place.get, len(v.place)
        log_counts, size = np.log10(v.counts + SMOOTH), np.log10(v.base_size)
        log_counts[rare] = 0.0
        for batch in batches:
            rows = []
            ids = zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "held_out")))
            for (rid, doc, out), text in zip(ids, as_bytes(batch.column("text"))):
                tokens = text.lower().split()
                at = np.fromiter((get(w, rare) for w in tokens), np.int64, len(tokens))
                symbols = v.symbol[at]
                unknown = np.flatnonzero(at == rare)
                tail: Counter = Counter()
                for i in unknown.tolist():
                    tail[tokens[i]] += 1
                    symbols[i] = v.n_own + 1 + class_of(tokens[i], v.classes)
                classed = symbols > v.end
                logs = log_counts[at]
                inside = logs[classed].sum() - v.class_log[symbols[classed] - v.end - 1].sum()
                base = logs.sum() + np.log10(v.texts + SMOOTH) - size * (len(tokens) + 1)
                rows.append(
                    (
                        rid, doc, out, np.append(symbols, np.int16(v.end)).tobytes(), len(tokens) + 1,
                        len(tokens) - len(unknown) + (v.texts > 0), float(base), float(inside),
                        [{"word": w, "times": n} for w, n in tail.items()],
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint"), "held_out", "text")
    return read.mapInArrow(made, ENCODED)


class Model:
    def __init__(self, first: np.ndarray, move: np.ndarray, say: np.ndarray):
        """Probabilities: (states), (states, states), (states, symbols)."""
        self.first, self.move, self.say = first, move, say

    @classmethod
    def start(cls, states: int, symbols: int, seed: int = SEED) -> "Model":
        """Uneven symbols break the symmetry of states; states that tend to stay tell languages apart soonest."""
        draw = np.random.default_rng(seed)
        first, move = draw.uniform(0.5, 1.5, states), draw.uniform(0.5, 1.5, (states, states))
        move = move / move.sum(axis=1, keepdims=True) + 9 * np.eye(states)
        parts = [first, move, draw.exponential(1.0, (states, symbols)) + 0.05]
        return cls(*[p / p.sum(axis=-1, keepdims=True) for p in parts])

    @classmethod
    def of_counts(cls, first: np.ndarray, move: np.ndarray, say: np.ndarray) -> "Model":
        parts = [first + SMOOTH, move + SMOOTH, say + SMOOTH]
        return cls(*[p / p.sum(axis=-1, keepdims=True) for p in parts])


def _bundles(texts: list[np.ndarray]):
    """Texts by falling length, some at a time: (their numbers, symbols in time order, active texts at each time)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order]) // _TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(ends)) + 1):
        if len(part):
            sizes = lengths[part]
            time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            time = time.astype(np.uint16) if sizes[0] < 1 << 16 else time
            symbols = np.concatenate([texts[i] for i in part])[np.argsort(time, kind="stable")]
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            yield part, symbols, active


def _forward(model: Model, said: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State shares after each token, the scale of each token, and where each time begins."""
    begin = np.concatenate([[0], np.cumsum(active)])
    shares, scale = np.empty_like(said), np.empty(len(said))
    for t, n in enumerate(active.tolist()):
        a = begin[t]
        before = model.first if t == 0 else shares[begin[t - 1] : begin[t - 1] + n] @ model.move
        now = before * said[a : a + n]
        total = now.sum(axis=1)
        shares[a : a + n] = now / total[:, None]
        scale[a : a + n] = total
    return shares, scale, begin


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence."""
    out, say = np.zeros(len(texts)), model.say.T.copy()
    for part, symbols, active in _bundles(texts):
        _, scale, begin = _forward(model, say[symbols], active)
        logs, sums = np.log10(scale), np.zeros(len(part))
        for t, n in enumerate(active.tolist()):
            sums[:n] += logs[begin[t] : begin[t] + n]
        out[part] = sums
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Baum-Welch expects of the texts: first states, moves, symbols said."""
    states, symbols_n = model.say.shape
    first, move, spoken, say = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols_n)), model.say.T.copy()
    for part, symbols, active in _bundles(texts):
        said = say[symbols]
        shares, scale, begin = _forward(model, said, active)
        said /= scale[:, None]
        later = np.ones((0, states))
        for t in range(len(active) - 1, -1, -1):
            n, a = int(active[t]), begin[t]
            beta = np.ones((n, states))
            if len(later):
                m = len(later)
                here = said[begin[t + 1] : begin[t + 1] + m] * later
                move += shares[a : a + m].T @ here
                beta[:m] = here @ model.move.T
            later = beta
            shares[a : a + n] *= beta
        first += shares[: active[0]].sum(axis=0)
        for s in range(states):
            spoken[s] += np.bincount(symbols, weights=shares[:, s], minlength=symbols_n)
    return first, move * model.move, spoken


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column.to_pylist()]


def baum_welch_round(encoded: DataFrame, model: Model) -> Model:
    """One round over the symbols of all rows; tasks give their expected counts, Spark sums them."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = np.concatenate([x.ravel() for x in expected_counts(held.value, _texts(batch.column("symbols")))])
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "n"])

    # Sums of numbers in decimal do not depend on the order in which tasks end.
    sums = encoded.select("symbols").mapInArrow(expect, "place int, n double").groupBy("place").agg(
        F.sum(F.col("n").cast("decimal(28,9)")).cast("double").alias("n")
    )
    states, symbols = model.say.shape
    flat = np.zeros(states + states * states + states * symbols)
    for r in sums.collect():
        flat[r.place] = r.n
    first, move, say = np.split(flat, [states, states + states * states])
    return Model.of_counts(first, move.reshape(states, states), say.reshape(states, symbols))


def train(encoded: DataFrame, symbols: int, states: int = STATES, rounds: int = ROUNDS) -> Model:
    model = Model.start(states, symbols)
    for _ in range(rounds):
        model = baum_welch_round(encoded, model)
    return model


def score_texts(docs: DataFrame, states: int = STATES, own: int = OWN, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, text), learning from rows not held out, to the counts and scores of every row."""
    learned_from = docs.filter(~F.col("held_out"))
    counts = staged(word_counts(learned_from, classes))
    words = vocabulary(counts, learned_from.count(), own, classes, head)
    encoded = staged(encode(docs, words))
    model = train(encoded.filter(~F.col("held_out")), words.symbols, states)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, base double, score double"
    keep = ["rid", "doc_id", "held_out", "n_tokens", "head_known", "base"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = log_likelihoods(held.value, _texts(batch.column("symbols"))) + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made)], names=[*keep, "score"])

    scored = encoded.select(*keep, "symbols", "inside").mapInArrow(score, schema)
    tail = encoded.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.times")
    found = tail.join(counts.select("word", "n").hint("merge"), "word", "left")
    sums = found.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("tail_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
    )
    joined = scored.join(sums.hint("merge"), "rid", "left")
    rest = F.coalesce("tail_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text"))
