"""Quality rules: distribution divergence from language references.

Two histograms describe a text: its character classes (by code point) and its
use of a language's commonest words (the listed words, one bin each, and all
other words together).  The reference of a language is the sum of the
histograms of all its other documents, each of which weighs alike (its counts
are taken in millionths).  A document is rejected if the Jensen-Shannon
distance (base 2, 0 to 1) of either histogram to its language's reference is
above a bound, which is wider for short texts, whose histograms are noisy;
texts below a least size skip that test.

Base rules (word count and repeated 8-word windows) come first.

A reference of fewer than MIN_REFERENCE other documents says too little; the one
over all languages then stands in for it, and where that too is small the test
is skipped.

One pass sums the references (a few hundred counts for each language, combined
in each task before the shuffle), one pass scores.  No row moves between tasks.

Defined results: null and empty texts have no words and fail the word count;
null languages use the character reference over all languages; a language without
a word list, and the documents without a language, get a list of the words that
are commonest in their own documents, if these are LEARN_FROM or more; null
languages and those without a list are judged by the nearest of all lists, each against the reference of its language or, where the table has
no text of any listed language, against the sum of its bins over all documents;
equal rows get equal rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, in_parts, staged, table

#: Very common words of some languages; lists of others are learned from the table.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by at this from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Bounds on the distances: (bound for an endless text, what sampling noise adds
#: at one unit, falling with the square root of the size), and the least sizes.
CHAR_BOUND = (0.22, 0.6)
WORD_BOUND = (0.19, 0.9)
MIN_CHARS = 100
MIN_HISTOGRAM_WORDS = 30
#: Documents a reference needs, and what each weighs in it.
MIN_REFERENCE = 5
UNIT = 1_000_000
#: A language without a list learns one from so many documents or more: of the words in this share of them, the commonest.
LEARN_FROM = 30
SHARE = 0.2
TOP_WORDS = 20
MOST_GIVEN = 0.5
#: What the names of learned lists begin with.
LEARNED = "learned:"
BROADCAST_ROWS = 200_000

CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "beyond_ascii")
_SENTENCE = b".,;:!?'\"()-"


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"))
    for name, members in (
        ("lower", range(97, 123)),
        ("upper", range(65, 91)),
        ("digit", range(48, 58)),
        ("space", (32, 9, 10, 11, 12, 13)),
        ("sentence", _SENTENCE),
        ("beyond_ascii", range(0xC0, 256)),
    ):
        out[list(members)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)  # continuation bytes begin no code point
    return out


_CLASS = _class_of_byte()
_SYMBOL_BYTES = list(SYMBOLS)
_SPACE_BYTES = [32, 9, 10, 11, 12, 13]
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(REPEAT_WINDOW)], dtype=np.uint64)


class WordLists:
    """Word lists with the hashes of all their words, as written and capitalised."""

    def __init__(self, common_words: dict[str, list[str]]):
        self.names = list(common_words)
        self.sizes = [len(words) for words in common_words.values()]
        self.width = max(self.sizes, default=0)
        places = {
            (hash(form.encode()), k): k * self.width + i
            for k, words in enumerate(common_words.values()) for i, w in enumerate(words) for form in (w, w.capitalize())
        }
        order = sorted(places)
        self.keys, self.places = np.array([h for h, _ in order], np.int64), np.array([places[x] for x in order], np.int64)

    def bins(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """For each list the counts of its words, then of all others."""
        first = np.searchsorted(self.keys, hashes)
        hit = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == hashes) if len(self.keys) else np.zeros(0, np.int64)
        first, times = first[hit], np.searchsorted(self.keys, hashes[hit], "right") - first[hit]
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        counts = np.bincount(self.places[at], minlength=len(self.names) * self.width).reshape(len(self.names), self.width)
        return {name: np.append(counts[k, :size], len(hashes) - counts[k, :size].sum()) for k, (name, size) in enumerate(zip(self.names, self.sizes))}


def group_of(lang: str | None, lists) -> str | None:
    """The name of a language's word list: itself if it is listed, else that of its learned list, else itself."""
    learned = LEARNED + (lang or "")
    return learned if lang not in lists and learned in lists else lang


def learned_words(docs: DataFrame, common_words: dict[str, list[str]], least: int = LEARN_FROM) -> dict[str, list[str]]:
    """Lists of the commonest words of the languages that have none, and of the documents without a language.

    A language needs ``least`` documents, and a word a share SHARE of them; the
    TOP_WORDS in most documents are taken.  Documents whose common words are
    mostly those of given lists are no language of their own but a mixture of
    listed ones, and get no list.  The driver gets these words alone.
    """
    other = docs.filter(F.col("lang").isNull() | ~F.col("lang").isin(list(common_words)))
    sizes = staged(other.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    n_groups = sizes.count()
    if not n_groups:
        return {}
    said = F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    words = other.select(F.coalesce("lang", F.lit("")).alias("of"), F.explode(said).alias("word")).filter(F.col("word") != "")
    counts = words.groupBy("of", "word").agg(F.count("*").alias("docs")).filter(F.col("docs") >= SHARE * least)
    side = F.broadcast(sizes) if n_groups <= BROADCAST_ROWS else sizes.hint("merge")
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("docs"), "word"))
    common = counts.join(side, "of").filter(F.col("docs") >= SHARE * F.col("n")).withColumn("place", place).filter(F.col("place") <= TOP_WORDS)
    out: dict[str, list[str]] = {}
    for r in common.orderBy("of", "place").collect():
        out.setdefault(LEARNED + r["of"], []).append(r["word"])
    given = {w for words in common_words.values() for w in words}
    return {name: words for name, words in out.items() if sum(w in given for w in words) <= MOST_GIVEN * len(words)}


def _text_counts(text: bytes) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Class counts, code points in words, symbols, and a hash of each word."""
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=raw, minlength=len(CLASSES) + 1).astype(np.int64)
    chars = int(raw.sum() - raw[0x80:0xC0].sum())
    words = text.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    return classes[: len(CLASSES)], chars - int(raw[_SPACE_BYTES].sum()), int(raw[_SYMBOL_BYTES].sum()), hashes


def repeated_words(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = hashes.view(np.uint64)
    keys = sum((h[k : k + n] * _MIX[k] for k in range(window)), np.zeros(n, np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[np.flatnonzero(twice)] += 1
    edge[np.flatnonzero(twice) + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def _alike(counts: np.ndarray) -> np.ndarray:
    """Counts in millionths of their sum; nothing for nothing."""
    return counts * UNIT // max(1, int(counts.sum()))


def _distance(counts: np.ndarray, reference: np.ndarray) -> float:
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def references(docs: DataFrame, common_words: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """Sums over all documents: (lang, words_of, kind, bin, n).

    lang is null where the row stands for all languages; words_of is the word
    list that kind 'word' was counted with, and lang then the name of that list.
    """
    schema = "lang string, words_of string, kind string, bin int, n bigint"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = WordLists(common_words)
        total: dict[tuple, np.ndarray] = {}

        def add(key, counts):
            total[key] = total[key] + counts if key in total else counts

        for batch in in_parts(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                classes, _, _, hashes = _text_counts(text)
                for name in {lang, None}:
                    add((name, None, "char"), _alike(classes))
                group = group_of(lang, common_words)
                for own, counts in listed.bins(hashes).items():
                    for name in {own, None} if own == group else {None}:
                        add((name, own, "word"), _alike(counts))
        rows = [(*key, i, int(n)) for key, counts in total.items() for i, n in enumerate(counts)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))],
                names=["lang", "words_of", "kind", "bin", "n"],
            )

    counted = docs.select("lang", "text").mapInArrow(sums, schema)
    return counted.groupBy("lang", "words_of", "kind", "bin").agg(F.sum("n").alias("n"))


RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, char_distance double, word_distance double, kept boolean"
)


def quality_rules(
    docs: DataFrame,
    common_words: dict[str, list[str]] = COMMON_WORDS,
    char_bound: tuple[float, float] = CHAR_BOUND,
    word_bound: tuple[float, float] = WORD_BOUND,
    pass_columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """pass_columns of every document, its counts, distances and verdict.

    The references hold one row for each language and bin; they go to the tasks
    with the function.  Only languages of word lists and those found in the
    table make rows, so their number is that of languages.
    """
    spark = docs.sparkSession
    common_words = common_words | learned_words(docs, common_words) if common_words else common_words
    found: dict[tuple, dict[int, int]] = {}
    for r in references(docs, common_words).collect():
        found.setdefault((r.lang, r.words_of, r.kind), {})[r.bin] = r.n
    known = {k: np.array([v.get(i, 0) for i in range(max(v) + 1)], float) for k, v in found.items()}
    shared = spark.sparkContext.broadcast(known)
    n_pass = len(pass_columns)
    read = docs.select(*pass_columns, F.col("lang").alias("__lang"), F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:n_pass]) + ", " + RESULT

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, reference = WordLists(common_words), shared.value
        least = (MIN_REFERENCE - 0.5) * UNIT
        none = np.zeros(1)
        nearest = [own for own in listed.names if reference.get((own, own, "word"), none).sum() >= least]

        def distance(own, lang, *kind):
            """The distance of counts to the reference of lang, else to that of all; the own text is in both."""
            share = _alike(own)
            for name in (lang, None):
                if (name, *kind) in reference:
                    rest = reference[(name, *kind)] - share
                    if rest.sum() >= least:
                        return _distance(own, rest)
            return 0.0

        def word_distance(hashes, lang):
            group, counts = group_of(lang, common_words), listed.bins(hashes)

            def of(own, name):
                if name is not None and name != group:  # another language's reference, without the own text
                    return _distance(counts[own], reference[(name, own, "word")])
                return distance(counts[own], name, own, "word")

            if lang is not None and group in common_words:
                return of(group, group)
            return min([of(own, own) for own in nearest] or [of(own, None) for own in listed.names])

        for batch in in_parts(batches):
            rows = []
            for lang, text in zip(batch.column("__lang").to_pylist(), as_bytes(batch.column("__text"))):
                classes, word_chars, symbols, hashes = _text_counts(text)
                n, repeats = len(hashes), repeated_words(hashes)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                by_char = by_word = 0.0
                if classes.sum() >= MIN_CHARS:
                    by_char = distance(classes, lang, None, "char")
                if listed.names and n >= MIN_HISTOGRAM_WORDS:
                    by_word = word_distance(hashes, lang)
                far = by_char > char_bound[0] + char_bound[1] / max(1, classes.sum()) ** 0.5
                far = far or by_word > word_bound[0] + word_bound[1] / max(1, n) ** 0.5
                kept = not failed and not far
                rows.append((n, word_chars, symbols, duplicate_lines(text), repeats, failed, by_char, by_word, bool(kept)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            made = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n_pass)] + made,
                names=[*pass_columns, *[x.split()[0] for x in RESULT.split(", ")]],
            )

    return read.mapInArrow(score, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
