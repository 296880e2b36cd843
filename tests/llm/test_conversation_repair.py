"""Conversation repair against a search over all edits, SQL and cases worked by hand."""

import hashlib
import heapq
import random
import re

import pytest

from cuelake.llm import conversation_repair as cr

ROWS = "conv_id bigint, turn bigint, role string, text string, h string, ord string, letters string, n string"


def cheapest(codes):
    """(cost, audit) by best-first search over (cost, audit, rows passed, roles given)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, cr_state(roles)) in done:
            continue
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        done.add((i, cr_state(roles)))
        for role in "ua":
            if re.fullmatch("s?(ua)*u?", roles + role):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role))
        if i < len(codes):
            initial, fault = cr.INITIALS[codes[i] >> 2], cr.FAULTS[codes[i] & 3]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                for role, letter, more in [(initial, "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                    if re.fullmatch("s?(ua)*u?", roles + role):
                        heapq.heappush(heap, (cost + more + extra, audit + letter, i + 1, roles + role))


def cr_state(roles):
    return roles[-1:]


def test_auction_against_all_edits():
    rng = random.Random(3)
    for _ in range(1500):
        codes = bytes(rng.choice([0, 4, 8, 4, 8, 12, 1, 5, 9, 2, 6, 10, 3, 7, 11, 15]) for _ in range(rng.randrange(12)))
        want = cheapest(codes)
        assert cr.audit_of([(codes, None)]) == (want[0], [want[1]])
        size = rng.randrange(1, 5)
        parts = [codes[k : k + size] for k in range(0, len(codes), size)] or [b""]
        cost, pieces = cr.audit_of([(p, cr.matrix(p)) for p in parts])
        assert (cost, "".join(pieces)) == want


def test_long_conversations_in_blocks():
    rng = random.Random(4)
    codes = bytes(rng.choice([4, 8, 4, 8, 5, 7, 11, 12]) for _ in range(5_000))
    cost, (whole,) = cr.audit_of([(codes, None)])
    parts = [codes[k : k + 100] for k in range(0, len(codes), 100)]
    assert cr.audit_of([(p, cr.matrix(p)) for p in parts])[0] == cost
    assert "".join(cr.audit_of([(p, cr.matrix(p)) for p in parts])[1]) == whole


def by_hand(rows, heads):
    """RESULT rows from plain lists of (conv_id, turn, role, text)."""
    out = []
    for conv in heads:
        mine = [(turn, role if role is not None else " ", text if text is not None else " ") for c, turn, role, text in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, codes = set(), [], []
        for _, role, text in mine:
            stripped = text.strip("\t\n\v\f\r ")
            fault = 1 if not stripped else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            codes.append(4 * ("sua".index(role[0]) if role[:1] in tuple("sua") else 3) + fault)
        cost, audit = cheapest(bytes(codes))
        given, at, roles = [], 0, ""
        for letter in audit:
            nxt = "assistant" if roles.endswith("u") else "user"
            if letter == "I":
                given.append(f"{nxt}:")
                roles += nxt[0]
                continue
            _, role, text = mine[at]
            at += 1
            if letter != "D":
                role = role if letter == "K" else nxt
                given.append(f"{role}:{text}")
                roles += role[0]
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(given).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randrange(9)):
            turn = rng.choice([None, *range(7)])
            role = rng.choice([None, "", "system", "user", "assistant", "user", "assistant", "tool", "umpire"])
            rows.append((conv, turn, role, rng.choice([None, "", " \n", "Yes.", "No", "é?\n", "Fine! ", "ok"]), "a", "b", "c", "d"))
    return rows + rows[:30] + rows[:10]


@pytest.mark.parametrize("block", [2, 4096])
def test_odd_rows(spark, block):
    """Nulls everywhere, empty roles and texts, ties, repeated rows, conversations without rows, clashing names; long ones in blocks."""
    rows = odd_rows()
    heads = [None, *range(45)]
    got = cr.repair(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(c,) for c in heads], "conv_id bigint"), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand([r[:4] for r in rows], heads)


def test_one_long_conversation_over_many_tasks(spark):
    """A conversation of 3,000 rows, with a row that stands 500 times, over several range partitions and blocks; and a very long text."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {t}.", f"So {t}"])) for t in range(2_500)]
    rows += [(1, 40, "user", "again.")] * 500 + [(2, 0, "user", "word " * 300_000 + "."), (2, 1, "assistant", "Yes.")]
    got = cr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), block=64)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, [1, 2])


def test_empty_table(spark):
    assert cr.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_a_case_by_hand():
    # system, user, user cut off, assistant said twice: the second user row can be deleted (3), or an answer put before it (2 and 1 for the cut).
    codes = bytes([0, 4, 7, 8, 10])
    assert cr.audit_of([(codes, None)]) == (6, ["KKDKD"])
