"""Fuzzy line deduplication over the whole table.

Lines are the pieces of a text between newlines.  A line is normalised (A-Z to
lower case, digits to 0, other ASCII characters than letters and digits to
spaces, words joined by one space).  Equal normalised lines with a word are one
item, whatever their length (grouped first, combined in each task).

Lines of MIN_CHARS code points or more are linked if their edit similarity (1 -
edits / length of the longer) is at least SIMILARITY.  Pairs to judge meet in
cells, of two kinds:

* blocks of a line's SimHash: two SimHashes within NEAR bits agree on two of
  BLOCKS blocks, so they meet;
* runs of a line: where a few edits fall on a line, some run of its words stays
  whole.  Of all runs of a fixed number of bytes that begin at a word (or at a
  code point past ASCII) the least under several hashes are kept, and lines that
  keep one in common meet.  Short lines keep themselves less one word each.

SimHash blocks narrow enough for large tables find few lines that differ in
more than a word or two, so the runs find the rest; the recall of both together
is measured against all pairs in the tests.  In a cell a pair is judged if
lengths allow the similarity and the SimHashes differ in at most RADIUS of 48
bits, a wide radius (unrelated lines differ in about 24); ``radius=48`` judges
all pairs that meet.

Of each connected group the first occurrence by (doc_id, line number) stays; all
others are taken out of their documents.

Only numbers are dealt to cells at first; the text of a line moves only if it has
a pair to judge.  Cells over SHARD rows are cut into slices and every pair of
slices is searched as a cell of its own.  Inside a cell pairs that are connected
already are not judged again, and a cell gives a spanning forest of its links.

Defined results: null text stays null and has no lines; rows are known by doc_id
and text, so rows of null or equal doc_id and other texts are documents of their
own, and equal rows keep the same lines; places are ordered by doc_id, a null
one first, then line number, then a hash of the row; an empty table gives an empty result; other
columns pass through unless they carry a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bktree import Groups
from cuelake.llm.common import as_bytes, in_parts, staged, table
from cuelake.llm.components import connected, spread_join
from cuelake.llm.simhash_dedup import deal, over_cells, whole_cells

SIMILARITY = 0.8
#: Code points from which lines are linked; exact repeats go at any length.
MIN_CHARS = 20
#: Bits within which two SimHashes always meet, and the blocks of a SimHash.
NEAR = 2
BLOCKS = 4
#: Bits of the 48 that go with a line in which judged pairs may differ.
RADIUS = 12
SHARD = 4096
#: Bytes of a run, least and most bytes of the lines that keep such runs, and how many are kept.
RUNS = ((16, 28, 80, 4), (24, 64, 240, 6), (40, 190, 1 << 62, 6))
#: Lines up to so many bytes and words also keep themselves less one word, if this share of the line is left.
SHORT_BYTES, SHORT_WORDS, LEFT = 55, 12, 0.6
#: Words shorter than this many bytes count in a SimHash only where a line has no longer one.
LONG_WORD = 4
#: Rows up to which a table of line numbers by document goes to all tasks; beyond, both sides are sorted.
BROADCAST_ROWS = 200_000
#: A line's kin number: its length in code points (15 bits), then 48 bits of its SimHash.
KIN_BITS = 48
LONGEST = (1 << 15) - 1
#: Odd multipliers of the mixing of hashes (large primes or golden ratio multiples).
_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(8)], np.uint64)
#: Bytes of lines hashed at a time, so that their hashes stay in the cache.
_STEP_BYTES = 1 << 16
#: Pairs whose edits are counted at a time, at first and at most.
_FIRST_PAIRS, _STEP_PAIRS = 1 << 12, 1 << 14
#: Edits that each word of a band of the distance matrix holds; pairs that are counted together at least and at most;
#: the time of one code of many pairs together, in that of one code of a single pair.
BAND_EDITS, FEW_PAIRS, _BAND_PAIRS, _BAND_COST = 32, 16, 1 << 10, 20
#: Lines of a task that are remembered, so that repeats are not dealt again.
_SEEN = 1_000_000
#: For each byte a number whose bytes are the byte's bits, and how many such numbers can be added.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_LANE_MOST = 255
_NORMAL = bytes(
    c if c >= 0x80 or 97 <= c <= 122 or c == 10 else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 for c in range(256)
)


def normal_lines(text: bytes) -> list[list[bytes]]:
    """The words of each normalised line."""
    return [line.split() for line in text.translate(_NORMAL).split(b"\n")]


def edit_distance(a: bytes | str, b: bytes | str, most: int) -> int:
    """Levenshtein distance, or any number above ``most`` if it is above it.

    Shared ends are cut off, then whole columns of the distance matrix advance
    as bit vectors of vertical differences.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[head:], b[head:]
    n -= head
    tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for j, c in enumerate(b):
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & last) - bool(left & last)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        right = (right << 1 | 1) & full
        left = (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return score


def _middles(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """a and b without the words that both begin and end with."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    apart = x[:n] != y[:n]
    head = int(apart.argmax()) if apart.any() else n
    head = max(0, a.rfind(b" ", 0, head) + 1) if head < max(len(a), len(b)) else head
    apart = x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1]
    tail = int(apart.argmax()) if apart.any() else n - head
    at = a.find(b" ", len(a) - tail)
    tail = len(a) - at if at >= 0 else 0
    return a[head : len(a) - tail], b[head : len(b) - tail]


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray, width: int) -> np.ndarray:
    """The edit distance of each pair where it is at most ``most`` and BAND_EDITS * width - 1, else any number above either.

    a is at least as long as b, and longer by no more edits than the band holds; pairs are sorted by falling length of b.
    Only a band of ``width`` 64-bit words of each column is kept, which moves down a row at each code of b (Hyyro's
    bit vectors).  All pairs advance together; a pair leaves when the cell of its end's diagonal is above its bound.
    The last FEW_PAIRS of them are given back as -1, not counted.
    """
    size_a, size_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    edits, kinds = BAND_EDITS * width - 1, 1 + max(int(x.max()) for x in (*a, *b))
    low = 64 * width - 1 - edits  # bits of the first band that lie before the text
    pair, at = np.repeat(np.arange(len(a)), size_a), np.arange(size_a.sum()) - np.repeat(np.cumsum(size_a) - size_a, size_a) + low
    places = np.zeros(((int(size_b[0]) >> 6) + width + 2, len(a) * kinds), np.uint64)
    np.add.at(places.reshape(-1), (at >> 6) * places.shape[1] + pair * kinds + np.concatenate(a), np.uint64(1) << (at & 63).astype(np.uint64))
    codes = np.zeros((size_b[0], len(b)), np.int64)
    codes[np.arange(size_b.sum()) - np.repeat(np.cumsum(size_b) - size_b, size_b), np.repeat(np.arange(len(b)), size_b)] = np.concatenate(b)
    codes += np.arange(len(a)) * kinds
    active = len(a) - np.searchsorted(size_b[::-1], np.arange(size_b[0]), "right")
    first = ((1 << edits + 1) - 1) << low
    up = np.repeat(np.array([first >> 64 * w & 2**64 - 1 for w in range(width)], np.uint64)[:, None], len(a), axis=1)
    down, score, bound, who = np.zeros_like(up), size_a - size_b, np.minimum(most, edits), np.arange(len(a))
    word, bit = (low + score) >> 6, ((low + score) & 63).astype(np.uint64)
    out, whole, one, top = np.full(len(a), edits + 1), True, np.uint64(1), np.uint64(63)
    for j, n in enumerate(active.tolist()):
        n = n if whole else int(np.searchsorted(who, n))
        if n < len(who):
            out[who[n:]] = score[n:]
            who, score, bound, word, bit, up, down = who[:n], score[:n], bound[:n], word[:n], bit[:n], up[:, :n], down[:, :n]
        if j % 16 == 0 and (over := score > bound).any():
            out[who[over]] = np.maximum(most[who[over]], edits) + 1
            on, whole = np.flatnonzero(~over), False
            who, score, bound, word, bit, up, down = who[on], score[on], bound[on], word[on], bit[on], up[:, on], down[:, on]
        if not len(who):
            return out
        if len(who) < FEW_PAIRS and j % 16 == 0 and j + 64 < size_b[who[0]]:
            break
        here, past = places[j >> 6 : (j >> 6) + width + 1].take(codes[j, :n] if whole else codes[j, who], axis=1), np.uint64(j & 63)
        equal = here[:-1] >> past | here[1:] << (top - past) << one
        both = equal & up
        added = both + up
        if width > 1:
            carry = added < up
            for w in range(1, width):
                added[w] += carry[w - 1]
                carry[w] |= carry[w - 1] & (added[w] == 0)
        level = (added ^ up) | equal | down
        right, left = down | ~(level | up), level & up
        score = score + ((level[word, np.arange(len(who))] >> bit & one) == 0)
        below = level >> one
        below[:-1] |= level[1:] << top
        up, down = left | ~(below | right), below & right
    else:
        out[who] = score
        return out
    out[who] = -1
    return out


def _codes(rows: list[tuple]) -> list[np.ndarray]:
    """Both texts of each row (place, text, text, most) as numbers of their characters, counted from 0 in each row."""
    texts = [np.frombuffer(t, np.uint8) if isinstance(t, bytes) else np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, x, y, _ in rows for t in (x, y)]
    sizes, flat = np.fromiter(map(len, texts), np.int64, len(texts)), np.concatenate(texts)
    used = np.zeros(int(flat.max()) + 1, bool)
    used[flat] = True
    flat = (np.cumsum(used) - 1)[flat]
    kinds, ends = int(used.sum()), np.cumsum(sizes)
    out, step = [], max(1, (1 << 22) // kinds)
    for k in range(0, len(rows), step):
        n = min(step, len(rows) - k)
        own = flat[ends[2 * k] - sizes[2 * k] : ends[2 * (k + n) - 1]] + kinds * np.repeat(np.arange(n), sizes[2 * k : 2 * (k + n)].reshape(-1, 2).sum(axis=1))
        used = np.zeros(n * kinds + 1, bool)
        used[own + 1] = True
        before = np.cumsum(used, dtype=np.int32)
        out.append(before[own + 1] - 1 - before[own // kinds * kinds])
    return np.split(np.concatenate(out), ends[:-1])


def similar(a: list[bytes], b: list[bytes], similarity: float) -> np.ndarray:
    """Whether the edit similarity of each pair of normalised lines in UTF-8, by code points, is high enough.

    Words that both begin and end with are left aside.  Edits are counted for many
    pairs together, in a narrow band first and in twice as wide a one for those it
    does not decide, down to few pairs, which are counted one by one.
    """
    out, left = np.zeros(len(a), bool), []
    for i, (x, y) in enumerate(zip(a, b)):
        plain = x.isascii() and y.isascii()
        most = int((1 - similarity) * (max(len(x), len(y)) if plain else max(len(x.decode()), len(y.decode()))) + 1e-9)
        x, y = _middles(x, y)
        if not plain:
            x, y = x.decode(), y.decode()
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        if len(x) - len(y) > most:
            continue
        if len(x) <= most or not y:  # rewriting the middle takes no more edits
            out[i] = True
            continue
        left.append((i, x, y, most))
    width, single = 1, []
    while len(left) >= FEW_PAIRS:
        edits = BAND_EDITS * width - 1
        left.sort(key=lambda row: -len(row[2]))
        fits = [row for row in left if len(row[1]) - len(row[2]) <= edits]
        left = [row for row in left if len(row[1]) - len(row[2]) > edits]
        while fits:
            some = max(FEW_PAIRS, min(_BAND_PAIRS, (_BAND_PAIRS << 6) // (len(fits[0][2]) // 64 + width + 2)))
            part, fits = fits[:some], fits[some:]
            # The longest of them are counted alone where the others would wait for them.
            sizes = np.array([0, *(len(y) for *_, y, _ in part[:FEW_PAIRS]), 0])
            alone = int((np.cumsum(sizes)[:-1] + _BAND_COST * sizes[1:]).argmin())
            single, part = single + part[:alone], part[alone:]
            if not part:
                continue
            numbered, limits = _codes(part), np.array([m for *_, m in part])
            counted = _banded(numbered[::2], numbered[1::2], limits, width)
            out[[i for i, *_ in part]] = (counted >= 0) & (counted <= np.minimum(limits, edits))
            left += [row for row, n in zip(part, counted.tolist()) if n > edits < row[3]]
            single += [row for row, n in zip(part, counted.tolist()) if n < 0]
        width *= 2
    for i, x, y, most in single + left:
        out[i] = edit_distance(x, y, most) <= most
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _MIX[0]
    h = (h ^ h >> np.uint64(33)) * _MIX[1]
    return h ^ h >> np.uint64(33)


def _simhashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A SimHash for each run of hashes.

    Bits are counted in byte lanes, eight to a number, over parts of a run that
    no lane can overflow.
    """
    lanes = _LANES[hashes.astype(">u8").view(np.uint8)].reshape(-1, 8)
    parts = -(-sizes // _LANE_MOST)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(sizes) - sizes - _LANE_MOST * first, parts) + _LANE_MOST * np.arange(parts.sum())
    ones = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).astype(np.int32)
    if len(begin) > len(sizes):
        ones = np.add.reduceat(ones, first, axis=0)
    packed = np.packbits(2 * ones > sizes[:, None], axis=1)
    return packed.view(">u8").ravel().astype(np.uint64)


def _firsts(line: np.ndarray) -> np.ndarray:
    """Where each line begins, of rows sorted by line."""
    return np.flatnonzero(np.r_[True, line[1:] != line[:-1]])


def marks_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SimHash of each normalised line, the cells of its runs, and how many these are.

    A mark stands at each word and at each code point past ASCII; what counts in
    the SimHash is the word from the mark on, to eight bytes.
    """
    joined = b"\n".join(lines) + b"\n" + bytes(64)
    raw, eight = np.frombuffer(joined, np.uint8), np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    text = raw[:-64]
    ends = np.flatnonzero(text == 10)
    begins = np.r_[0, ends[:-1] + 1]
    breaks = np.flatnonzero((text == 32) | (text == 10))
    mark = text >= 0xC0
    mark[0] = True
    mark[breaks[:-1] + 1] = True
    at = np.flatnonzero(mark)
    line = np.searchsorted(begins, at, "right") - 1
    word = np.minimum(breaks[np.searchsorted(breaks, at)] - at, 8)
    whole = np.bincount(line[word >= LONG_WORD], minlength=len(lines)) == 0
    on = np.flatnonzero((word >= LONG_WORD) | whole[line])
    hashes = _mixed(eight[at[on]] & (np.uint64(2**64 - 1) >> (8 * (8 - word[on])).astype(np.uint64)))
    prints = _simhashes(hashes, np.bincount(line[on], minlength=len(lines)))
    length, cells, own = ends - begins, [], []
    for size, least, most, kept in RUNS:
        on = np.flatnonzero(((length >= least) & (length < most))[line] & (ends[line] - at >= size))
        if not len(on):
            continue
        hashes = np.full(len(on), size, np.uint64)
        for k in range(0, size, 8):
            hashes = _mixed((hashes ^ eight[at[on] + k]) * _ODD[7])
        first = _firsts(line[on])
        for k in range(kept):
            cells.append(np.minimum.reduceat((hashes ^ _ODD[k]) * _ODD[k], first) ^ np.uint64(k))
            own.append(line[on][first])
    for i in np.flatnonzero(length <= SHORT_BYTES).tolist():
        words = lines[i].split()
        if len(words) <= SHORT_WORDS:
            less = [b" ".join(words[:k] + words[k + 1 :]) for k in range(len(words))]
            kept = {xxhash.xxh3_64_intdigest(x) for x in [lines[i], *less] if len(x) >= LEFT * len(lines[i])}
            cells.append(np.array(sorted(kept), np.uint64))
            own.append(np.full(len(kept), i))
    if not cells:
        return prints, np.zeros(0, np.uint64), np.zeros(len(lines), np.int64)
    own, cells = np.concatenate(own), np.concatenate(cells)
    return prints, cells[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(lines))


def with_row(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a hash of doc_id and text, by which rows are known."""
    own = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())
    return docs.withColumn(name, own)


def line_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def pairs_of_cells(cell: np.ndarray):
    """(earlier, later) rows of one cell, all pairs, by their distance; rows are sorted by cell."""
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[begin, len(cell)])
    end, rows, apart = np.repeat(begin + sizes, sizes), np.arange(len(cell)), 1
    while len(rows := rows[rows + apart < end[rows]]):
        yield rows, rows + apart
        apart += 1


def line_prints(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, line_no, key, id, print, kin, cells) of every line with a word.

    cells is null where the line is too short to be linked, or was met before in
    the same task; print and kin then say nothing.
    """
    schema = "doc_id bigint, row bigint, line_no int, key binary, id bigint, print bigint, kin bigint, cells array<bigint>"

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest128, seen = xxhash.xxh3_128_digest, set()
        for batch in in_parts(batches):
            ids, rows, numbers, keys, new, lengths, made, lines, held = [], [], [], [], [], [], [], [], 0
            known = zip(batch.column("doc_id").to_pylist(), batch.column("__row").to_pylist(), as_bytes(batch.column("text")))
            for doc, row, text in known:
                for i, words in enumerate(normal_lines(text)):
                    if not words:
                        continue
                    line = b" ".join(words)
                    key = digest128(line)
                    ids.append(doc)
                    rows.append(row)
                    numbers.append(i)
                    keys.append(key)
                    length = len(line) if line.isascii() else len(line.decode())
                    if length < min_chars or key in seen:
                        continue
                    if len(seen) == _SEEN:
                        seen.clear()
                    seen.add(key)
                    new.append(len(keys) - 1)
                    lengths.append(min(LONGEST, length))
                    lines.append(line)
                    held += len(line)
                    if held > _STEP_BYTES:
                        made.append(marks_of(lines))
                        lines, held = [], 0
            if lines:
                made.append(marks_of(lines))
            if not keys:
                continue
            own, kin = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            count, flat, none = np.zeros(len(keys), np.int64), np.zeros(0, np.uint64), np.ones(len(keys), bool)
            if made:
                print_, flat, count_ = (np.concatenate(x) for x in zip(*made))
                own[new], count[new], none[new] = print_, count_, False
                kin[new] = print_ >> np.uint64(64 - KIN_BITS) | np.array(lengths, np.uint64) << np.uint64(KIN_BITS)
            offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32), mask=np.r_[none, False])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()),
                    pa.array(keys, pa.binary()), pa.array([line_id(k) for k in keys], pa.int64()),
                    pa.array(own.view(np.int64)), pa.array(kin.view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))),
                ],
                names=["doc_id", "row", "line_no", "key", "id", "print", "kin", "cells"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "__row", "text").mapInArrow(prints, schema)


class Judge:
    """Which pairs of a cell are to be judged."""

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity

    def pairs(self, cell: np.ndarray, ids: np.ndarray, kin: np.ndarray):
        """(earlier, later) rows of one cell, of other lines, whose lengths and SimHashes allow it; rows are sorted by cell."""
        kin = kin.view(np.uint64)
        length, low = (kin >> np.uint64(KIN_BITS)).astype(np.int64), np.uint64((1 << KIN_BITS) - 1)
        for a, b in pairs_of_cells(cell):
            longer = np.maximum(length[a], length[b])
            fits = (np.abs(length[a] - length[b]) <= (1 - self.similarity) * longer + 1e-9) | (longer == LONGEST)
            fits &= (ids[a] != ids[b]) & (np.bitwise_count((kin[a] ^ kin[b]) & low) <= self.radius)
            yield a[fits], b[fits]


def one_row_a_line(lines: DataFrame) -> DataFrame:
    """What is dealt to cells: each task gives a line once, and the rows of all tasks become one, however often the line stands."""
    kept = [F.first(c).alias(c) for c in ("print", "kin", "cells")]
    return lines.filter(F.col("cells").isNotNull()).repartition("id").groupBy("id").agg(*kept)


def cells_with_pairs(lines: DataFrame, judge: Judge, near: int, blocks: int, shard: int) -> DataFrame:
    """Lines to distinct (cell, id, kin) of those that have a pair to judge; a cell is here a set of lines that such pairs connect."""

    def partners(cell, ids, kin):
        groups, used = Groups(len(cell)), np.zeros(len(cell), bool)
        for a, b in judge.pairs(cell, ids, kin):
            used[a] = used[b] = True
            groups.join(a, b)
        if used.any():
            # Rows are renamed to their set: lines that meet in several cells are judged in one.
            root = groups.roots(np.arange(len(cell)))
            sums = np.zeros(len(cell), np.uint64)
            np.add.at(sums, root, _mixed(ids.view(np.uint64) ^ _ODD[0]))
            yield [pa.array(x[used]) for x in (sums[root].view(np.int64), ids, kin)]

    new = one_row_a_line(lines)
    by_block = deal(new.select("print", "id", "kin"), near, blocks).select("cell", "id", "kin")
    by_run = new.select(F.explode("cells").alias("cell"), "id", "kin")
    return over_cells(by_block.unionByName(by_run), partners, "cell bigint, id bigint, kin bigint", shard).distinct()


class Common:
    """Which pairs of rows have no lesser cell in common than the one they stand in, from the sorted cells of each row's line."""

    def __init__(self, cell: np.ndarray, sets: list):
        width = max(map(len, sets))
        self.cell, self.none = cell, np.iinfo(np.int64).max
        self.sets = np.full((len(sets), width), self.none)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        rows = np.repeat(np.arange(len(sets)), sizes)
        self.sets[rows, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(sets)

    def first_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for k in range(0, len(a), 1 << 14):
            x, y, here = self.sets[a[k : k + (1 << 14)]], self.sets[b[k : k + (1 << 14)]], self.cell[a[k : k + (1 << 14)]]
            x = np.where(x < here[:, None], x, self.none)
            for column in range(x.shape[1]):
                own = x[:, column]
                out[k : k + (1 << 14)] &= ~((y == own[:, None]).any(axis=1) & (own < self.none))
        return out


def in_steps(pairs):
    """Pairs some at a time, few at first, so that what they connect is known before the rest is taken."""
    held, most = [[], []], _FIRST_PAIRS
    for a, b in pairs:
        held[0] += a.tolist()
        held[1] += b.tolist()
        if len(held[0]) >= most:
            yield held
            held, most = [[], []], min(2 * most, _STEP_PAIRS)
    if held[0]:
        yield held


def judged_links(lines: DataFrame, judge: Judge, node: str = "key") -> DataFrame:
    """(cell, id, kin, sets, key, line) to (a, b): keys, or ids, of a forest of each cell's links; a pair is judged in the least cell of both."""
    names, kind = ("id", "kin", "sets", "line") if node == "id" else ("id", "kin", "sets", "line", node), "bigint" if node == "id" else "binary"

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cell, ids, kin, sets, texts, *keys) in whole_cells(batches, names):
            nodes = keys[0] if keys else ids
            groups, common, out = Groups(len(ids)), Common(cell, sets), []

            def pairs(cell=cell, ids=ids, kin=kin, common=common, groups=groups):
                for a, b in judge.pairs(cell, ids, kin):
                    open_ = groups.roots(a) != groups.roots(b)
                    a, b = a[open_], b[open_]
                    here = common.first_here(a, b)
                    yield a[here], b[here]

            for x, y in in_steps(pairs()):
                open_ = groups.roots(np.array(x)) != groups.roots(np.array(y))
                x, y = np.array(x)[open_].tolist(), np.array(y)[open_].tolist()
                for i in np.flatnonzero(similar([texts[i] for i in x], [texts[i] for i in y], judge.similarity)).tolist():
                    if groups.root(x[i]) != groups.root(y[i]):
                        groups.join_one(x[i], y[i])
                        out.append((nodes[x[i]], nodes[y[i]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if node == "id" else pa.binary()) for c in zip(*out)], names=["a", "b"])

    dealt = lines.withColumn("line", F.col("line").cast("binary")).select("cell", *names)
    return dealt.repartition("cell").sortWithinPartitions("cell", "kin", "id").mapInArrow(links, f"a {kind}, b {kind}")


def _beside(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Join documents with a table of at most one row for each __row; ``small`` must be staged."""
    side = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge")
    return docs.join(side, "__row", how)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, line_no, key) to (key, line), the normalised lines."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keys, lines = [], []
            for text, picks in zip(as_bytes(batch.column("text")), batch.column("__wanted").to_pylist()):
                words = normal_lines(text)
                for p in picks:
                    keys.append(p["key"])
                    lines.append(b" ".join(words[p["line_no"]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.binary())], names=["key", "line"])

    by_doc = staged(
        wanted.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("line_no", "key")).alias("__wanted"))
    )
    held = _beside(docs.select("__row", "text"), by_doc, "inner").select("text", "__wanted")
    return held.mapInArrow(pick, "key binary, line binary").dropDuplicates(["key"])


def repeated_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    near: int = NEAR,
    blocks: int = BLOCKS,
    radius: int = RADIUS,
    shard: int = SHARD,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(__row, __lines): the line numbers to take out of each document, known by ``with_row``, that loses lines."""
    judge = Judge(radius, similarity)
    lines = staged(line_prints(docs, min_chars))
    items = staged(
        lines.groupBy("key", "id").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.count("*").alias("n"))
    )
    judged_in = staged(cells_with_pairs(lines, judge, near, blocks, shard))
    some = judged_in.groupBy("id").agg(F.array_sort(F.collect_set("cell")).alias("sets"))
    wanted = staged(items.join(some.hint("merge"), "id").select("id", "key", "sets", "first.row", "first.line_no"))
    texts = staged(line_texts(docs, wanted).join(wanted.select("key", "id", "sets").hint("merge"), "key"))
    # Groups are of ids, which Spark sorts and hashes faster than keys, unless two of these lines share one.
    node = "id" if wanted.groupBy("id").count().filter(F.col("count") > 1).isEmpty() else "key"
    hung = connected(judged_links(judged_in.join(texts.hint("merge"), "id"), judge, node)).withColumnRenamed("node", node)
    roots = staged(hung.unionByName(hung.select(F.col("root").alias(node), "root").distinct()))
    linked = staged(items.join(roots.hint("merge"), node).select("key", "root", "first"))
    groups = linked.groupBy("root").agg(F.min("first").alias("keep"))
    in_groups = spread_join(linked.select("key", "root"), groups, "root").select("key", "keep")
    alone = items.filter(F.col("n") > 1).join(roots.select(node).hint("merge"), node, "left_anti")
    keepers = staged(in_groups.unionByName(alone.select("key", F.col("first").alias("keep"))))
    places = lines.select("key", "doc_id", "line_no", "row")
    placed = spread_join(places, keepers, "key")
    gone = placed.filter(~F.struct("doc_id", "line_no", "row").eqNullSafe(F.col("keep")))
    return gone.groupBy(F.col("row").alias("__row")).agg(F.collect_set("line_no").alias("__lines"))


def line_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines and n_removed (lines before, lines gone)."""
    docs = with_row(docs.drop("n_lines", "n_removed"))
    gone = staged(repeated_lines(docs, **parameters))
    joined = _beside(docs, gone, "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains("__lines", i))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("bigint"))
        .withColumn("n_removed", F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
        .drop("__lines", "__row")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
