"""Cheapest repair of damaged conversations by an auction shortest-path algorithm.

The nodes of a lattice are (rows passed, state), the state being what the roles
given so far allow next; its arcs are edits with integer costs: Keep, Rerole,
Delete, Insert.  Each node has a price, at first a lower bound of what the rest
costs.  A path grows from an origin along the arc with the least cost plus
price; where that sum is above the end node's price, the price rises to it and
the path gives the node up.  A path that meets a node of proven price proves the
prices of all its nodes.  Nodes are settled STRIDE rows at a time from the last
row, so a path is short and every node is visited a few times.  Arcs whose cost
is the exact difference of proven prices are tight: all cheapest repairs run
along them, and the least by letters is found by taking at each node the tight
arc with the least letter.

At scale.  A row is first a code of one byte (its role's initial and fault).
Codes are range-sorted, so a conversation of any length lies in as many tasks
as it needs, and cut into blocks of up to BLOCK rows; for each block the same
algorithm gives the costs between its four states at entry and exit.  A
conversation's blocks are then a short lattice of their own; its prices are the
exit prices with which each block is traced.  What one task holds of one
conversation is its audit and as many codes, a byte for a row, which one output
row must hold in any case.  Texts are shuffled once, sorted, and hashed as a
stream; SHA-256 is a chain, so one conversation's texts pass one task in turn.

Defined results: a null role or text is one space; rows of equal turn stand in
order of role, then of the text's digest; a row whose role is empty, or begins
with another letter than s, u or a, can't be kept; of equal rows the first may be kept; an
empty table has no rows; null conv_id is a conversation; null turns stand first
and aren't counted in gaps; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import SPACES, crc32_sql, staged, table
from cuelake.llm.components import spread_join

BLOCK = 4_096
STRIDE = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 60

#: What the roles so far allow next: nothing given, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The user's turn is next, but after the user.
ANSWER = (USER, USER, ASSISTANT, USER)
#: What each state can become.
FUTURE = ((NONE, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))
#: Costs and letters of the inserts that end a conversation in each state.
EXITS = (0, 2 * INSERT, INSERT, 0)
ENDINGS = ("", "II", "I", "")
ROLES = {USER: "user", ASSISTANT: "assistant"}

#: A row's code is 4 * place in INITIALS + place in FAULTS.
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, CUT = 1, 2, 3
RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)

#: (letter, cost, next state, rows passed)
Arc = tuple[str, int, int, int]


def _arcs(code: int, state: int) -> list[Arc]:
    """The edits open before a row, in order of their letters."""
    initial, fault = INITIALS[code >> 2], code & 3
    arcs = [("D", DELETE, state, 1), ("I", INSERT, ANSWER[state], 0)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        if initial == "s" and state == NONE:
            arcs.append(("K", KEEP + extra, SYSTEM, 1))
        if initial == ("a" if state == USER else "u"):
            arcs.append(("K", KEEP + extra, ANSWER[state], 1))
        arcs.append(("R", REROLE + extra, ANSWER[state], 1))
    return arcs


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(16)]
#: The least that passing a row costs in any state.
FLOORS = [min(cost for arcs in ARCS[code] for _, cost, _, passed in arcs if passed) for code in range(16)]


class Lattice:
    """Prices of the nodes 4 * i + state of n steps, found by auctions.

    arcs(node) lists (letter, cost, node), floors has the least cost of each
    step and exits the prices after the last one.
    """

    def __init__(self, n: int, arcs: Callable[[int], list[tuple[str, int, int]]], floors: list[int], exits):
        self.n, self.arcs = n, arcs
        self.price = [NEVER] * (4 * n) + list(exits)
        self.exact = bytearray(4 * n) + b"\1\1\1\1"
        closed = [all(exits[later] >= NEVER for later in FUTURE[state]) for state in range(4)]
        for high in range(n, 0, -STRIDE):
            low = max(0, high - STRIDE)
            bound = min(self.price[4 * high : 4 * high + 4])
            for i in range(high - 1, low - 1, -1):
                bound += floors[i]
                for state in range(4):
                    if closed[state]:
                        self.exact[4 * i + state] = 1
                    else:
                        self.price[4 * i + state] = bound
            for state in range(4):
                self.cost(4 * low + state)

    def cost(self, origin: int) -> int:
        """The proven price of a node: the path grows and shrinks until it meets a proven one."""
        price, exact, path = self.price, self.exact, [origin]
        while not exact[node := path[-1]]:
            best, to = NEVER, -1
            for _, cost, other in self.arcs(node):
                if cost + price[other] < best:
                    best, to = cost + price[other], other
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = 1
        return price[origin]

    def trace(self, node: int) -> tuple[str, int]:
        """The least letters of the tight arcs to the end, and the state there."""
        letters = []
        while node < 4 * self.n:
            for letter, cost, other in self.arcs(node):
                if cost + self.price[other] == self.price[node] and cost + self.cost(other) == self.price[node]:
                    letters.append(letter)
                    node = other
                    break
        return "".join(letters), node & 3


def rows_lattice(codes: bytes, exits=EXITS) -> Lattice:
    def arcs(node):
        i = node >> 2
        return [(letter, cost, (i + passed) * 4 + to) for letter, cost, to, passed in ARCS[codes[i]][node & 3]]

    return Lattice(len(codes), arcs, [FLOORS[c] for c in codes], exits)


def matrix(codes: bytes) -> list[int]:
    """Costs over a block from each state at its begin (four numbers) to each at its end, NEVER where there is no way."""
    out = [[NEVER] * 4 for _ in range(4)]
    for end in range(4):
        lattice = rows_lattice(codes, [0 if state == end else NEVER for state in range(4)])
        for begin in range(4):
            out[begin][end] = lattice.price[begin]
    return [cost for row in out for cost in row]


def blocks_lattice(costs: list[list[int]]) -> Lattice:
    def arcs(node):
        k, state = node >> 2, node & 3
        return [("", cost, 4 * k + 4 + end) for end, cost in enumerate(costs[k][4 * state : 4 * state + 4]) if cost < NEVER]

    return Lattice(len(costs), arcs, [min(c) for c in costs], EXITS)


def audit_of(blocks: list[tuple[bytes, list[int] | None]]) -> tuple[int, list[str]]:
    """Least cost and, for each block of a conversation, the letters of its edits."""
    if len(blocks) == 1:
        whole = rows_lattice(blocks[0][0])
        letters, state = whole.trace(NONE)
        return whole.price[NONE], [letters + ENDINGS[state]]
    above = blocks_lattice([costs for _, costs in blocks])
    pieces, state = [], NONE
    for k, (codes, _) in enumerate(blocks):
        letters, state = rows_lattice(codes, [above.cost(4 * k + 4 + end) for end in range(4)]).trace(state)
        pieces.append(letters)
    pieces[-1] += ENDINGS[state]
    return above.price[NONE], pieces


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += 200 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if length >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _typed(schema: str) -> tuple[list[str], list[pa.DataType]]:
    fields = [f.split() for f in schema.split(", ")]
    return [name for name, _ in fields], [_ARROW[kind] for _, kind in fields]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, code, again): equal rows as one, n of them, with the codes of the first and of the others."""
    word = F.col("text").rlike(f"[^{SPACES}]")
    closed = F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    light = staged(
        rows.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.max(~word).alias("blank"), F.max(~closed).alias("cut"))
    )
    light = light.withColumn("said", F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("h"), F.lit(":"), "role"), 256))
    first = light.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("at"))).alias("first"))
    met = spread_join(light, first, "said")
    earlier = ~F.col("turn").eqNullSafe(F.col("first.at"))
    fault = F.when(F.col("blank"), BLANK).when(earlier, DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    initial = F.coalesce(*(F.when(F.col("role").startswith(x), 4 * k) for k, x in enumerate("sua")), F.lit(12))
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    return met.select("conv_id", "turn", "role", "h", "n", (initial + fault).alias("code"), (initial + again).alias("again"))


BLOCKS = "conv_id bigint, ord bigint, turn bigint, role string, h binary, codes binary, n_turns bigint, first_turn bigint, last_turn bigint, costs array<bigint>"


def blocks_of(codes: DataFrame, size: int = BLOCK) -> DataFrame:
    """BLOCKS rows: runs of up to size rows of a conversation, with the key of their first row and ord in their order.

    costs is null for a conversation that lies whole in one block of one task.
    """
    names, kinds = _typed(BLOCKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ord_ = TaskContext.get().partitionId() << 40

        def made():
            nonlocal ord_
            groups = groupby(_rows(batches, "conv_id", "turn", "role", "h", "n", "code", "again"), key=lambda r: r[0])
            here = next(groups, None)
            first = True
            while here is not None:
                conv, rows = here
                waiting = None  # a block that may turn out to be the only one
                for key, part, turns in _cut(rows, size):
                    if waiting is not None:
                        yield (conv, ord_, *waiting[0], waiting[1], *waiting[2], matrix(waiting[1]))
                        ord_ += 1
                        first = True  # so the last block gets its costs too
                    waiting = key, part, turns
                here = next(groups, None)
                whole = not first and here is not None
                yield (conv, ord_, *waiting[0], waiting[1], *waiting[2], None if whole else matrix(waiting[1]))
                ord_ += 1
                first = False

        yield from _batches(made(), names, kinds)

    keys = ("conv_id", "turn", "role", "h")
    return codes.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(cut, BLOCKS)


def _cut(rows: Iterator[tuple], size: int):
    """(key of the first row, codes, (distinct turns, first, last)) of each block of one conversation's sorted rows."""
    key, part, n_turns, first, last = None, bytearray(), 0, None, None
    for _, turn, role, h, n, code, again in rows:
        at = 0
        while at < n:
            if len(part) == size:
                yield key, bytes(part), (n_turns, first, last)
                key, part, n_turns, first, last = None, bytearray(), 0, None, None
            if key is None:
                key = (turn, role, h)
            if turn is not None and turn != last:
                n_turns, first, last = n_turns + 1, turn if first is None else first, turn
            if at == 0:
                part.append(code)
                at = 1
            else:
                more = min(n - at, size - len(part))
                part += bytes([again]) * more
                at += more
    yield key, bytes(part), (n_turns, first, last)


_TO_INITIAL = bytes(ord(INITIALS[c >> 2]) if c < 16 else 63 for c in range(256))
_LEGAL = re.compile(rb"(?=su|ua|au)")


def tallies(blocks: list[tuple]) -> list[int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation from (codes, n_turns, first_turn, last_turn) of its blocks."""
    counts, illegal, before, n_turns, low, high = [0] * 4, 0, b"", 0, None, None
    for codes, here, first, last in blocks:
        for code in set(codes):
            counts[code & 3] += codes.count(code)
        initials = before + codes.translate(_TO_INITIAL)
        illegal += len(initials) - 1 - len(_LEGAL.findall(initials))
        before = initials[-1:]
        if here:
            n_turns += here - (first == high)
            low, high = first if low is None else low, last
    return [0 if low is None else high - low + 1 - n_turns, counts[BLANK], counts[DUPLICATE], counts[CUT], illegal]


#: Rows of one conversation in the order in which the last step reads them: its head, its tallies, then pieces and rows by turn.
STREAM = "conv_id bigint, level int, turn bigint, role string, h binary, kind int, ord bigint, letters string, counts array<bigint>"
HEAD, COUNTS, BODY = 0, 1, 2


def audited(blocks: DataFrame) -> DataFrame:
    """STREAM rows: the tallies and cost of each conversation, and the letters of each of its blocks."""
    names, kinds = _typed(STREAM)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            columns = ("conv_id", "ord", "turn", "role", "h", "codes", "n_turns", "first_turn", "last_turn", "costs")
            for conv, rows in groupby(_rows(batches, *columns), key=lambda r: r[0]):
                rows = list(rows)
                cost, pieces = audit_of([(r[5], r[9]) for r in rows])
                yield (conv, COUNTS, None, None, None, 0, 0, None, [*tallies([r[5:9] for r in rows]), cost])
                for (_, ord_, turn, role, h, *_), letters in zip(rows, pieces):
                    yield (conv, BODY, turn, role, h, 0, ord_, letters, None)

        yield from _batches(made(), names, kinds)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(solve, STREAM)


def repaired(texts: DataFrame, audits: DataFrame, heads: DataFrame) -> DataFrame:
    """RESULT rows: audits laid over the rows that they edit."""
    names, kinds = _typed(RESULT)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, rows in groupby(_rows(batches, "conv_id", "level", "kind", "role", "text", "letters", "counts"), key=lambda r: r[0]):
                counts, letters, at, state, text_hash, begun, audit = [0] * 6, "", 0, NONE, hashlib.sha256(), False, []

                def say(role, text):
                    nonlocal begun, state
                    text_hash.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun, state = True, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

                for _, level, kind, role, text, more, numbers in rows:
                    if level == COUNTS:
                        counts = numbers
                    elif level == BODY and kind == 0:
                        audit.append(more)
                        letters, at = letters[at:] + more, 0
                    elif level == BODY:
                        while letters[at] == "I":
                            say(ROLES[ANSWER[state]], "")
                            at += 1
                        if letters[at] != "D":
                            say(role if letters[at] == "K" else ROLES[ANSWER[state]], text)
                        at += 1
                for _ in letters[at:]:
                    say(ROLES[ANSWER[state]], "")
                yield (conv, *counts, "".join(audit), text_hash.hexdigest())

        yield from _batches(made(), names, kinds)

    rows = texts.select("conv_id", F.lit(BODY).alias("level"), "turn", "role", "h", F.lit(1).alias("kind"), "text")
    all_rows = audits.unionByName(rows, allowMissingColumns=True).unionByName(heads.select("conv_id", F.lit(HEAD).alias("level")), allowMissingColumns=True)
    return all_rows.repartition("conv_id").sortWithinPartitions("conv_id", "level", "turn", "role", "h", "kind", "ord").mapInArrow(replay, RESULT)


def repair(rows: DataFrame, heads: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """RESULT rows of all conversations of (conv_id, turn, role, text) rows, and of those of heads that have no row."""
    none = F.lit(" ")
    texts = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"),
    ).withColumn("h", F.unhex(F.sha2("text", 256)))
    heads = (rows if heads is None else heads).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    # Range sorts read their input twice, once to see its spread.
    codes = staged(coded(texts))
    return repaired(texts, audited(staged(blocks_of(codes, block))), heads)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage that the checksum of conv_id and turn does to each."""
    none = F.lit(" ")
    said = [F.coalesce(F.col(c).cast("string"), none) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    role, text = F.coalesce("role", none), F.coalesce("text", none)
    return rows.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(role).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(way == 0, F.array()).when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(given), given)


def _add(state: str, cost: str, letter: str, said: str = "''") -> str:
    """SQL: a state after one more edit.  It is cost in nine digits, audit, a mark, and the repaired rows, so that min() picks by cost and audit."""
    mark = f"strpos({state}, chr(1))"
    return f"printf('%09d', CAST(substr({state}, 1, 9) AS BIGINT) + {cost}) || substr({state}, 10, {mark} - 10) || '{letter}' || substr({state}, {mark}) || {said}"


_U, _A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_EITHER = "least(v0, vs, ia)"
OP11_SQL = rf"""
WITH RECURSIVE crc AS ({crc32_sql("SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations")}),
d AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(0, CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations JOIN crc ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM o),
walk(conv_id, pos, v0, vs, vu, va, iu, ia) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
    '000000002I' || chr(1) || {_U}, '000000004II' || chr(1) || {_U} || {_A} FROM conversations
  UNION ALL
  SELECT conv_id, pos, v0, vs, vu, va, iu, least(va, {_add("iu", "2", "I", _A)}) FROM (
    SELECT *, least(vu, {_add("v0", "2", "I", _U)}, {_add("vs", "2", "I", _U)}, {_add("va", "2", "I", _U)}) AS iu FROM (
      SELECT w.conv_id, f.pos, {_add("v0", "3", "D")} AS v0,
        least({_add("vs", "3", "D")}, CASE WHEN ok AND c = 's' THEN {_add("v0", "extra", "K", "line")} END) AS vs,
        least({_add("iu", "3", "D")}, CASE WHEN ok AND c = 'u' THEN {_add(_EITHER, "extra", "K", "line")} END,
          CASE WHEN ok THEN {_add(_EITHER, "2 + extra", "R", _U + " || text")} END) AS vu,
        least({_add("ia", "3", "D")}, CASE WHEN ok AND c = 'a' THEN {_add("iu", "extra", "K", "line")} END,
          CASE WHEN ok THEN {_add("iu", "2 + extra", "R", _A + " || text")} END) AS va
      FROM walk AS w JOIN (
        SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra, chr(10) || role || ':' || text AS line FROM f) AS f
      ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1))),
best AS (
  SELECT conv_id, arg_max(least(v0, {_add("vs", "4", "II", _U + " || " + _A)}, {_add("vu", "2", "I", _A)}, va), pos) AS v FROM walk GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(substr(v, 1, 9) AS BIGINT) AS cost, substr(v, 10, strpos(v, chr(1)) - 10) AS audit,
  sha256(substr(v, strpos(v, chr(1)) + 2)) AS repaired_sha256
FROM best AS b LEFT JOIN (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id) AS t ON b.conv_id IS NOT DISTINCT FROM t.conv_id
"""
