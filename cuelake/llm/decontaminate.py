"""Benchmark decontamination: a BM25 inverted index of test items, searched with
block-max WAND by every passage of every document.

The index holds each item as one entry: for each term, postings (item, impact)
in item order, cut into blocks with the greatest impact of each.  Impacts are
BM25 term weights over the item's greatest score (that of a query with all its
terms), so one threshold, a share of an item's own weight, holds for all items.

Items are looked for by classes of their length (up to 64 words, then each eight
times as long).  Passages are windows of twice a class's greatest length with
half overlap, so a verbatim item always lies whole inside one, and what is found
depends neither on the shard nor on the other items' lengths.  Items stand in at most RANGES ranges; where
the greatest impacts of a passage's terms within a range sum to less than the
threshold, no item of that range can score it.  This first pivot test of WAND
is done for all passages and ranges of a text at once; what it leaves is
searched cursor by cursor within the range.

An item found is verified on five-word shingles: at least OVERLAP of those of
the question and of the answer must stand in the passage.  With no answer
column, the last sentence of an item is its answer and the rest its question,
and an item counts as well if at least OVERLAP of the shingles of its whole
text stand there, whatever its last sentence.  Texts too short for a shingle
are compared as a whole word sequence.

Document frequencies and the mean length are counted over all items, however
many shards there are.  The index goes to tasks in shards of at most SHARD_WORDS
words, each read from the item table by its share of the hash range; a table of tests that fits one
shard makes one pass over the documents, larger ones a pass for each shard.
Documents never move between tasks, so hot passages and long texts add only
their own length.

Defined results: null and empty texts and items match nothing; equal rows get
equal rows; equal items are each reported; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, staged, table

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 64
RANGES = 32
SHARD_WORDS = 2_000_000
#: Half the words of the shortest passages.
LEAST_HALF = 64

_NORMAL = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LAST_SENTENCE = re.compile(r"[.!?\n]\s*(?=[^.!?\n]*[.!?\n]*\s*$)")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def question_and_answer(text: str) -> tuple[str, str]:
    cut = None
    for m in _LAST_SENTENCE.finditer(text):
        if text[m.end() :].strip(" .!?\n"):
            cut = m.end()
    return (text, "") if not cut else (text[:cut], text[cut:])


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Postings of a shard of items, and their shingles."""

    def __init__(self, items: list[tuple], whole: bool = False, totals: tuple[int, float, dict] | None = None, longest: int | None = None):
        """items: (item_id, question, answer) with a word in either; whole: its whole text verifies an item too.

        totals: number and mean length of all items, and how many of them have each term; from these items if absent.
        longest: half the words of a passage, from these items if absent.
        """
        self.ids = [i for i, _, _ in items]
        parts = [(tokens(q.encode()), tokens(a.encode())) for _, q, a in items]
        words = [q + a for q, a in parts]
        self.longest = longest or max((len(w) for w in words), default=1)
        self.parts = [[(len(p), shingles(p)) for p in pair if p] for pair in parts]
        self.wholes = [(len(w), shingles(w)) for w in words] if whole else None
        n_items, mean, having = totals or (len(items), sum(map(len, words)) / max(1, len(words)), None)
        counts: dict[bytes, list[tuple[int, int]]] = {}
        for n, w in enumerate(words):
            own: dict[bytes, int] = {}
            for x in w:
                own[x] = own.get(x, 0) + 1
            for x, c in own.items():
                counts.setdefault(x, []).append((n, c))
        total = np.zeros(len(items))
        self.terms = {x: t for t, x in enumerate(counts)}
        self.postings, impacts = [], []
        for x, found in counts.items():
            df = having[x] if having is not None else len(found)
            idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
            at = np.array([n for n, _ in found])
            tf = np.array([c for _, c in found], float)
            length = np.array([len(words[n]) for n in at])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            self.postings.append(at)
            impacts.append(weight)
            np.add.at(total, at, weight)
        self.impacts = [w / total[at] for at, w in zip(self.postings, impacts)]
        self.greatest = np.array([w.max() for w in self.impacts])
        self.width = max(1, math.ceil(len(items) / RANGES))
        self.range_most = np.zeros((len(counts), RANGES), np.float32)
        for t, (at, w) in enumerate(zip(self.postings, self.impacts)):
            np.maximum.at(self.range_most[t], at // self.width, w.astype(np.float32))
        self.block_last = [at[BLOCK - 1 :: BLOCK] if len(at) % BLOCK == 0 else np.append(at[BLOCK - 1 :: BLOCK], at[-1]) for at in self.postings]
        self.block_most = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) for w in self.impacts]

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All (item number, score) at or above the threshold for distinct terms: block-max WAND.

        Only items from low to below high are searched.
        """
        high = len(self.ids) if high is None else high
        cursors = []  # item, place, term
        for t in terms:
            place = int(np.searchsorted(self.postings[t], low)) if low else 0
            if place < len(self.postings[t]) and self.postings[t][place] < high:
                cursors.append([int(self.postings[t][place]), place, t])
        out = []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort()
            upper, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                upper += self.greatest[t]
                if upper >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, ends = 0.0, []
            for _, _, t in cursors[: pivot + 1]:
                block = int(np.searchsorted(self.block_last[t], item))
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    ends.append(int(self.block_last[t][block]))
            if bound >= slack:
                if cursors[0][0] == item:
                    score = float(sum(self.impacts[t][place] for at, place, t in cursors[: pivot + 1]))
                    if score >= slack:
                        out.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:  # no item up to the nearest end of these blocks, or the next cursor, can score enough
                goal = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            alive = []
            for k, (at, place, t) in enumerate(cursors):
                if k <= pivot and at < goal:
                    place += int(np.searchsorted(self.postings[t][place:], goal))
                    if place == len(self.postings[t]):
                        continue
                    at = int(self.postings[t][place])
                    if at >= high:
                        continue
                alive.append([at, place, t])
            cursors = alive
        return out

    def text_hits(self, text: bytes, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Item number to (score, question share, answer share) of its best passage, verified items only."""
        words = tokens(text)
        if not words:
            return {}
        get, unknown = self.terms.get, len(self.terms)
        ids = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
        stride, slack = self.longest, threshold - 1e-4
        known = np.flatnonzero(ids < unknown)
        if not len(known):
            return {}
        half = known // stride
        pairs = np.unique(half * unknown + ids[known])  # each term once in each half passage
        half, term = np.divmod(pairs, unknown)
        most = np.zeros(((len(words) - 1) // stride + 2, RANGES), np.float32)
        first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        most[half[first]] = np.add.reduceat(self.range_most[term], first, axis=0)
        bounds = most[:-1] + most[1:]
        if len(bounds) > 1:
            bounds = bounds[:-1]  # the last half passage is searched with the one before
        edges = np.searchsorted(half, np.arange(len(most) + 1))
        out: dict[int, tuple[float, float, float]] = {}
        for number in np.flatnonzero(bounds.max(axis=1) >= slack).tolist():
            start, end = number * stride, min(len(words), (number + 2) * stride)
            terms = np.unique(term[edges[number] : edges[number + 2]])
            found = []
            for r in np.flatnonzero(self.range_most[terms].sum(axis=0) >= slack).tolist():
                found += self.search(terms.tolist(), threshold, r * self.width, min(len(self.ids), (r + 1) * self.width))
            here = shingles(words[start:end]) if found else set()

            def share(size, own, start=start, end=end, here=here):
                if size >= SHINGLE:
                    return len(own & here) / len(own)
                run = next(iter(own))
                return float(any(tuple(words[i : i + size]) == run for i in range(start, end - size + 1)))

            for item, score in found:
                shares = [share(*part) for part in self.parts[item]]
                if min(shares) >= overlap or (self.wholes and share(*self.wholes[item]) >= overlap):
                    made = (score, shares[0], shares[-1])
                    out[item] = max(out.get(item, made), made)
        return out


def length_class(words: int) -> int:
    """Half the words of the passages in which an item of so many words is looked for, whatever other items there are."""
    half = LEAST_HALF
    while half < words:
        half *= 8
    return half


def indexes(items: list[tuple], whole: bool, totals: tuple[int, float, dict] | None) -> list[Index]:
    """An index for each length class of the items of a shard; terms weigh as totals, or else all these items, say."""
    sizes = [tokens((q + " " + a).encode()) for _, q, a in items]
    if totals is None:
        totals = len(items), sum(map(len, sizes)) / max(1, len(items)), Counter(x for w in sizes for x in set(w))
    classes: dict[int, list[tuple]] = {}
    for item, words in zip(items, sizes):
        classes.setdefault(length_class(len(words)), []).append(item)
    return [Index(own, whole, totals, half) for half, own in sorted(classes.items())]


def item_terms(items: DataFrame) -> DataFrame:
    """(shard, term, words) of each distinct term of each item with a word; words is the item's length, on its first term only."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, found, lengths = [], [], []
            for shard, q, a in zip(batch.column("shard").to_pylist(), as_bytes(batch.column("question")), as_bytes(batch.column("answer"))):
                words = tokens(q + b" " + a)
                for k, x in enumerate(sorted(set(words))):
                    shards.append(shard)
                    found.append(x)
                    lengths.append(None if k else len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), pa.array(found, pa.binary()), pa.array(lengths, pa.int64())], names=["shard", "term", "words"]
            )

    return items.mapInArrow(terms, "shard int, term binary, words bigint")


RESULT = "item_id bigint, score double, question_overlap double, answer_overlap double"


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each verified pair.

    items: item_id, text; or item_id, question and answer.
    """
    spark = docs.sparkSession
    split = "question" in items.columns
    texts = items.select("item_id", "question", "answer") if split else items.select("item_id", F.col("text").alias("question"), F.lit("").alias("answer"))
    chars = texts.agg(F.sum(F.length(F.concat_ws(" ", "question", "answer")))).first()[0] or 0
    shards = max(1, math.ceil(chars / 6 / shard_words))
    own = F.pmod(F.xxhash64("item_id", "question"), F.lit(shards))
    if shards > 1:
        terms = staged(item_terms(texts.select(own.cast("int").alias("shard"), "question", "answer")))
        n_items, mean = terms.agg(F.count("words"), F.avg("words")).first()
        having = staged(terms.groupBy("term").agg(F.count("*").alias("items")))
    schema = f"doc_id bigint, {RESULT}"
    read = docs.select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for shard in range(shards):
        rows = texts.filter(own == shard).orderBy("item_id").collect()
        pairs = [(r.item_id, *((r.question or "", r.answer or "") if split else question_and_answer(r.question or ""))) for r in rows]
        held = spark.sparkContext.broadcast([p for p in pairs if tokens((p[1] + " " + p[2]).encode())])

        totals = None
        if shards > 1:  # the terms of one shard, so no more than SHARD_WORDS
            mine = having.join(terms.filter(F.col("shard") == shard).select("term").hint("merge"), "term", "left_semi")
            totals = spark.sparkContext.broadcast((n_items, mean, {bytes(r.term): r.items for r in mine.collect()}))

        def search(batches: Iterator[pa.RecordBatch], held=held, totals=totals) -> Iterator[pa.RecordBatch]:
            found = indexes(held.value, not split, totals.value if totals else None)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    for index in found:
                        for item, shares in index.text_hits(text, threshold, overlap).items():
                            rows.append((doc, index.ids[item], *shares))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = read.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
