"""Ordered computations over a media that no task sees whole.

``carried`` is a running aggregate in two levels: totals by (media, time bin),
what comes before each bin, then the bins each on their own.

``fold_in_blocks`` is for chains, in which what happens to a row depends on what
happened to those before it.  A block of rows is first summed up as a function
from the state before it to the state after it; the states before all blocks
follow from these summaries alone, and each block is then gone through once more
from its state.

``sweep`` goes through intervals that overlap in each time bin, with those that
reach into the bin from before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 600_000
#: Rows of a block.
BLOCK = 1_024
#: A threshold below any time.
BEFORE_ALL = -(2**62)
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def carried(
    rows: DataFrame, how: str, values: dict[str, Column], at: Column, ties: tuple[str, ...] = (), descending: bool = False, exclusive: bool = False,
    width: int = BIN_MS, keys: tuple[str, ...] = ("media_id",),
) -> DataFrame:
    """rows with a column for each of values: it over all rows of the same keys up to each, in order of (at, ties).

    how: sum, min, max, or last (the latest value that is not null).
    descending turns the whole order round.  exclusive leaves the row itself out.
    """
    sign, names = -1 if descending else 1, list(values)
    own = [f"__{name}" for name in names]
    ordered = [F.col(c) * sign if descending else F.col(c) for c in ties]
    keyed = rows.withColumns({"__at": at * sign} | {o: values[n] for o, n in zip(own, names)}).withColumn("__bin", F.floor(F.col("__at") / width))
    # One shuffle of the rows serves the totals, the join with what came before, and the windows.
    keyed = keyed.repartition(*keys, "__bin")
    over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}[how]

    def total(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("__at", *ordered))) if how == "last" else over(F.col(c))

    # One row for each bin of the keys.
    totals = keyed.groupBy(*keys, "__bin").agg(*[total(c).alias(c) for c in own])
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__bin", *[over(F.col(c)).over(earlier).alias(f"{c}_before") for c in own])
    inside = Window.partitionBy(*keys, "__bin").orderBy("__at", *ordered).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    met = keyed.join(before.hint("merge"), [*keys, "__bin"], "left")
    running = met.withColumns({n: both(F.col(f"{o}_before"), over(F.col(o)).over(inside)) for n, o in zip(names, own)})
    return running.drop("__at", "__bin", *own, *[f"{o}_before" for o in own])


def _stream(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _batches(rows: Iterator[tuple], schema: str, size: int = 8_192) -> Iterator[pa.RecordBatch]:
    fields, held = [f.split() for f in schema.split(", ")], []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*held), fields)], names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


_PLACE = ("media_id", "__major", "__minor")


def fold_in_blocks(
    rows: DataFrame, order: tuple[str, str], light: tuple[str, ...], whole: tuple[str, ...], start: list[int],
    summary: Callable[[list[tuple]], list[int]], advance: Callable[[list[int], list[int]], list[int]],
    replay: Callable[[list[int], Iterator[tuple]], Iterator[tuple]], schema: str, size: int = BLOCK,
) -> DataFrame:
    """A chain over each media's rows in ``order`` (a list number, a row number in it).

    summary sums up a block's rows (columns ``light``); advance gives the state
    after a block from the one before it and its summary; replay gives the
    result rows (schema, without media_id) of a block's rows (columns
    ``whole``) from the state before it.  A block is at most ``size`` row numbers of one list.
    """
    place = [F.col(order[0]).cast("bigint").alias("__major"), F.floor(F.col(order[1]) / size).cast("bigint").alias("__minor")]
    number = F.col(order[1]).alias("__number")

    def sum_up(batches):
        def made():
            for block, found in groupby(_stream(batches, *_PLACE, *light), key=lambda r: r[:3]):
                yield (*block, summary([r[3:] for r in found]))

        yield from _batches(made(), "media_id bigint, __major bigint, __minor bigint, __summary array<bigint>", 256)

    def chain(batches):
        def made():
            for _, blocks in groupby(_stream(batches, *_PLACE, "__summary"), key=lambda r: r[0]):
                state = start
                for *block, summed in blocks:
                    yield (*block, state)
                    state = advance(state, summed)

        yield from _batches(made(), "media_id bigint, __major bigint, __minor bigint, __state array<bigint>")

    def go_through(batches):
        def made():
            for block, found in groupby(_stream(batches, *_PLACE, "__state", *whole), key=lambda r: r[:3]):
                state = next(found)[3]
                for row in replay(state, (r[4:] for r in found)):
                    yield (block[0], *row)

        yield from _batches(made(), f"media_id bigint, {schema}")

    short = rows.select("media_id", *place, number, *light)
    summed = short.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "__number").mapInArrow(
        sum_up, "media_id bigint, __major bigint, __minor bigint, __summary array<bigint>"
    )
    states = summed.repartition("media_id").sortWithinPartitions(*_PLACE).mapInArrow(chain, "media_id bigint, __major bigint, __minor bigint, __state array<bigint>")
    # The state comes before the block's rows, which have a number.
    both = rows.select("media_id", *place, number, F.lit(1).alias("__own"), *whole).unionByName(states.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    return both.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "__own", "__number").mapInArrow(go_through, f"media_id bigint, {schema}")


def jumps(rows: list[tuple[int | None, int]], slack: int) -> list[int]:
    """Summary of a block for the chain in which a row stays if it starts at the threshold or later, and sets the threshold to its end less slack.

    Each row points to the first later one that may follow it, so the threshold
    after the block, with a row as the first that stays, is known from the row
    it points to.  The first to stay at a threshold is the first row that starts there or
    later, always one that starts later than all before it: their starts, then the thresholds that follow from them.
    """
    after = [0] * len(rows)
    places: list[int] = []  # rows that start later than all between here and them, nearest last
    less: list[int] = []  # their starts, negative
    for i in range(len(rows) - 1, -1, -1):
        start, end = rows[i]
        follows = bisect_right(less, slack - end) - 1
        after[i] = after[places[follows]] if follows >= 0 else end - slack
        if start is not None:
            while places and less[-1] >= -start:
                places.pop()
                less.pop()
            places.append(i)
            less.append(-start)
    return [-x for x in reversed(less)] + [after[i] for i in reversed(places)]


def jump(state: list[int], summary: list[int]) -> list[int]:
    n = len(summary) // 2
    k = bisect_left(summary, state[0], 0, n)
    return [summary[n + k]] if k < n else state


def line_closes(hard: list[bool], sentences: int, most_words: int) -> Callable[[int, int, int], int | None]:
    """The word that closes a line which has ``held`` words, ``ends`` of them hard, before the word ``at``; None if none of these does."""
    ends_at = [i for i, h in enumerate(hard) if h]
    soft = [len(hard)] * (len(hard) + 1)
    for i in range(len(hard) - 1, -1, -1):
        soft[i] = soft[i + 1] if hard[i] else i

    def close(held: int, ends: int, at: int) -> int | None:
        k = bisect_left(ends_at, at) + sentences - ends - 1
        by_end = ends_at[k] if k < len(ends_at) else len(hard)
        by_size = soft[min(len(hard), at + max(0, most_words - held - 1))]
        first = min(by_end, by_size)
        return first if first < len(hard) else None

    return close


def lines(rows: list[tuple[bool]], sentences: int, most_words: int) -> list[int]:
    """Summary of a block of words for the chain of lines: for each (words held, sentences ended) before it, lines closed in it and the same pair after it."""
    hard, n = [bool(h) for (h,) in rows], len(rows)
    close = line_closes(hard, sentences, most_words)
    before = [0]
    for h in hard:
        before.append(before[-1] + h)
    # From a line's first word: lines closed from there on, words and ends left open.
    opened: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = close(0, 0, i)
        opened[i] = (0, n - i, before[n] - before[i]) if c is None else (opened[c + 1][0] + 1, *opened[c + 1][1:])
    out: list[int] = []
    for held in range(most_words + sentences + 1):
        for ends in range(sentences):
            c = close(held, ends, 0)
            out += (0, held + n, ends + before[n]) if c is None else (opened[c + 1][0] + 1, *opened[c + 1][1:])
    return out


def next_lines(state: list[int], summary: list[int], sentences: int) -> list[int]:
    line, held, ends = state
    at = 3 * (held * sentences + ends)
    return [line + summary[at], summary[at + 1], summary[at + 2]]


def sweep(intervals: DataFrame, width: int = BIN_MS) -> DataFrame:
    """(media_id, start_ms, end_ms, speaker) of the interval that started latest, of equal ones the first listed, wherever there is one.

    Pieces end at bins' edges and where the speaker changes.  In each bin the
    intervals come in the order in which they begin; those begun and not ended
    form a stack with the winner on top, so an interval is pushed once and
    popped once.
    """
    first, last = F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width)
    reach = intervals.filter("end_ms > start_ms").select("media_id", "start_ms", "end_ms", "ord", "speaker", F.explode(F.sequence(first, last)).alias("__bin"))

    def go(batches):
        def made():
            for (media, bin_), found in groupby(_stream(batches, "media_id", "__bin", "start_ms", "end_ms", "speaker"), key=lambda r: r[:2]):
                for start, end, speaker in _winners((r[2:] for r in found), bin_ * width, (bin_ + 1) * width):
                    yield media, start, end, speaker

        yield from _batches(made(), "media_id bigint, start_ms bigint, end_ms bigint, speaker string")

    ordered = reach.repartition("media_id", "__bin").sortWithinPartitions("media_id", "__bin", "start_ms", F.desc("ord"))
    return ordered.mapInArrow(go, "media_id bigint, start_ms bigint, end_ms bigint, speaker string")


def _winners(intervals: Iterator[tuple[int, int, str]], low: int, high: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, speaker) pieces within [low, high) from intervals in order of start, of equal starts the first listed last."""
    stack: list[tuple[int, str]] = []
    open_piece: list = []
    at = low

    def piece(start, end, speaker):
        if open_piece and open_piece[1] == start and open_piece[2] == speaker:
            open_piece[1] = end
            return None
        done = tuple(open_piece)
        open_piece[:] = [start, end, speaker]
        return done or None

    def upto(time):
        nonlocal at
        while stack and at < time:
            end, speaker = stack[-1]
            if end <= at:
                stack.pop()
                continue
            to = min(end, time)
            if done := piece(at, to, speaker):
                yield done
            at = to
        at = max(at, time)

    for start, end, speaker in intervals:
        yield from upto(max(low, start))
        stack.append((end, speaker))
    yield from upto(high)
    if open_piece:
        yield tuple(open_piece)
