"""Quality classifier: a factorisation machine.

Inputs of a text: how often each of BUCKETS hashed words occurs in it (as a
share of its words, square-rooted), and structure statistics (shares of letter
case, digits, symbols and spaces, lengths, repeated words, repeated lines) and
metadata (the size that the table states, and how far it is from the text's own)
cut into steps; label, language, source and id are never among them.  The score is a logistic of

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairs are summed in linear time as
``((sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2) / 2``.

Fitting takes about SAMPLE labelled rows chosen by a hash of the id, which is
the only bounded part; their sparse inputs come to the driver and the machine
is fitted there by Adam on mini-batches with fixed seeds.  Scoring reads every
text whole, in one pass with no shuffle.

Defined results: null and empty texts have only the intercept and the steps of
zero statistics; a null or absent n_chars is a step of its own; rows with a null label are not learned from; with no labelled
row every score is 0.5; with one class only, the share of that class; equal
rows get equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, crc_mod, sample_by_hash, table

BUCKETS = 1 << 12
RANK = 6
SAMPLE = 6_000
EPOCHS = 12
BATCH = 64
RATE = 0.02
DECAY = 1e-4
SEED = 20
#: Upper ends of the steps of each statistic.
STEPS = {
    "log_chars": (3, 4, 5, 6, 7, 8, 9, 10),
    "upper": (0.01, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digit": (0.001, 0.01, 0.03, 0.1),
    "symbol": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2),
    "sentence": (0.005, 0.02, 0.04, 0.08, 0.15),
    "space": (0.05, 0.1, 0.13, 0.16, 0.2, 0.3),
    "word_length": (3, 4, 5, 6, 7, 9, 12),
    "distinct_words": (0.05, 0.2, 0.4, 0.55, 0.7, 0.85),
    "top_word": (0.02, 0.05, 0.08, 0.12, 0.2, 0.4),
    "next_repeats": (0.002, 0.02, 0.05, 0.2, 0.5),
    "line_words": (3, 6, 12, 25, 50, 100),
    "repeated_lines": (0.01, 0.1, 0.3, 0.6),
    "stated_chars": (-0.5, 3, 4, 5, 6, 7, 8, 9, 10),
    "stated_apart": (-1e-9, 1e-9, 0.1),
}
_CLASS = {
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "symbol": list(b"#*$%&|<>@^~_=+\\/[]{}"),
    "sentence": list(b".,;:!?"),
    "space": [32, 9, 10, 11, 12, 13],
}
_FIRST = {}
_at = BUCKETS
for _name, _ends in STEPS.items():
    _FIRST[_name] = _at
    _at += len(_ends) + 1
INPUTS = _at


def inputs(text: bytes, stated: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of a text's inputs that are not zero; stated is the size in code points that the table gives."""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    distinct, times = np.unique(hashes, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    said = {
        "log_chars": np.log(size),
        "word_length": len(text) / max(1, n) - 1,
        "distinct_words": len(distinct) / max(1, n) ** 0.9,
        "top_word": times.max() / n if n else 0,
        "next_repeats": float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0,
        "line_words": n / max(1, len(lines)),
        "stated_chars": -1 if stated is None else np.log(max(1, stated)),
        "stated_apart": 0 if stated is None else np.log(max(1, stated)) - np.log(max(1, size if text.isascii() else len(text.decode()))),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0,
    } | {name: raw[members].sum() / size for name, members in _CLASS.items()}
    places = [_FIRST[name] + int(np.searchsorted(ends, said[name])) for name, ends in STEPS.items()]
    counts = np.bincount(distinct % BUCKETS, weights=times, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return np.concatenate([used, places]), np.concatenate([np.sqrt(counts[used] / max(1, n)), np.ones(len(places))])


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.squares = (factors**2).sum(axis=1)

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of texts by their inputs, of which each has some, all at a time."""
        if not texts:
            return np.zeros(0)
        first = np.cumsum([0, *(len(p) for p, _ in texts[:-1])])
        places, values = (np.concatenate(x) for x in zip(*texts))
        sums = np.add.reduceat(values[:, None] * self.factors[places], first, axis=0)
        own = np.add.reduceat(values**2 * self.squares[places], first)
        z = self.bias + np.add.reduceat(values * self.weights[places], first) + ((sums**2).sum(axis=1) - own) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = SEED) -> Machine:
    """Logistic loss, Adam, mini-batches in a seeded order."""
    weights, factors = np.zeros(INPUTS), np.zeros((INPUTS, RANK))
    if not examples:
        return Machine(0.0, weights, factors)
    rate = sum(y for _, _, y in examples) / len(examples)
    bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    if rate in (0.0, 1.0):
        return Machine(bias, weights, factors)
    draw = np.random.default_rng(seed)
    factors = draw.normal(0, 0.01, (INPUTS, RANK))
    theta = np.hstack([weights[:, None], factors])
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            part = [examples[i] for i in order[at : at + BATCH]]
            x = np.zeros((len(part), INPUTS))
            for row, (places, values, _) in enumerate(part):
                x[row, places] = values
            y = np.array([label for _, _, label in part], float)
            w, v = theta[:, 0], theta[:, 1:]
            sums = x @ v
            z = bias + x @ w + ((sums**2).sum(axis=1) - (x**2) @ (v**2).sum(axis=1)) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            grad = np.empty_like(theta)
            grad[:, 0] = x.T @ error
            grad[:, 1:] = x.T @ (error[:, None] * sums) - v * ((x**2).T @ error)[:, None]
            grad += DECAY * theta
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            pace = RATE * (0.5 if epoch >= EPOCHS * 2 // 3 else 1.0)
            theta -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias -= pace * float(error.sum())
    return Machine(bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _stated(df: DataFrame, name: str = "stated"):
    """The size that the table states, null where it has none."""
    return (F.col("n_chars") if "n_chars" in df.columns else F.lit(None)).cast("bigint").alias(name)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """(doc_id, text, label), and n_chars if there is one, to a machine."""
    known = labelled.filter(F.col("label").isNotNull())
    chosen = sample_by_hash(known, sample, known.select("doc_id").count(), "doc_id")
    schema = "doc_id bigint, label int, places array<int>, shares array<double>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [inputs(t, n) for t, n in zip(as_bytes(batch.column("text")), batch.column("stated").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([p for p, _ in both], pa.list_(pa.int32())),
                    pa.array([v for _, v in both], pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "places", "shares"],
            )

    read = chosen.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), "text", _stated(chosen))
    rows = read.mapInArrow(made, schema).toPandas()
    triples = sorted(zip(rows.doc_id, rows.label, rows.places, rows.shares), key=lambda r: (r[0], r[1], len(r[2])))
    return fit([(np.asarray(p, np.int64), np.asarray(v), int(y)) for _, y, p, v in triples])


def classify(docs: DataFrame, machine: Machine, pass_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """pass_columns of every document, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    read = docs.select(*pass_columns, F.col("text").alias("__text"), _stated(docs, "__stated"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-2]) + ", score double, predicted int"

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.score
        for batch in batches:
            sizes = batch.column("__stated").to_pylist()
            out = score([inputs(t, n) for t, n in zip(as_bytes(batch.column("__text")), sizes)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(pass_columns))] + [pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                names=[*pass_columns, "score", "predicted"],
            )

    return read.mapInArrow(scores, schema)


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    fold = crc_mod(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(fold != 1)
    # The labels are sampled before texts are fetched; at most about SAMPLE of them meet the documents.
    known = labels.filter(F.col("label").isNotNull())
    few = sample_by_hash(known, SAMPLE, known.count(), "doc_id")
    machine = learn(docs.join(F.broadcast(few), "doc_id"))
    return classify(docs.select("doc_id", (fold == 1).alias("held_out"), "text", "n_chars"), machine, ("doc_id", "held_out"))
