"""Archives: whole round trips, and files damaged in known places."""

import base64
import gzip
import hashlib
import os

import pytest

from cuelake.llm import warc

PAGES = "page_id bigint, url string, html string, h string, size string, copy string, payload string"


def pages_of(n):
    rows = [(i, f"http://a.example/{i}?q=a b%20é", f"<p>{i % 7}</p>" if i % 3 else f"<p>only {i}</p>", "x", "y", "z", "w") for i in range(n)]
    return rows + [(None, None, None, "x", "y", "z", "w"), (None, "http://b.example/", "", "x", "y", "z", "w"), *rows[:5], (10_000, "u\r\nv", "<p>1</p>", *"xyzw")]


def expected(rows, min_bytes):
    groups, out = {}, []
    for page_id, url, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0, url is not None, url or "", page_id))
    for payload, mine in groups.items():
        mine.sort()
        for k, row in enumerate(mine):
            first = len(payload) < min_bytes or k == len(mine) - 1
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((row[4], len(payload), sha1, "response" if first else "revisit", None if first else mine[-1][4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes,segment", [(0, warc.SEGMENT), (8, 700), (1, 1)])
def test_round_trip(spark, tmp_path, min_bytes, segment):
    """Nulls, empty payloads, repeated rows, equal payloads, urls with line ends, clashing names."""
    rows = pages_of(200)
    files = warc.write_archives(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", min_bytes, segment)
    found = warc.read_archives(spark, f"{tmp_path}/w", payload=True)
    assert files.agg({"records": "sum"}).first()[0] == len(rows) == found.count()
    assert found.filter("gap is not null").count() == 0
    assert {len(r.payload) for r in found.filter("record_type = 'revisit'").collect()} <= {0}
    assert sorted(map(tuple, warc.resolved(found).collect()), key=repr) == expected(rows, min_bytes)
    assert not [f for f in os.listdir(tmp_path / "w") if f.endswith(".tmp")]
    # Other tools read the members one after another.
    for f in os.listdir(tmp_path / "w"):
        if f.endswith(".gz"):
            assert gzip.decompress((tmp_path / "w" / f).read_bytes()).count(b"WARC/1.1\r\n") >= 1


def test_empty_table_and_long_text(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.write_archives(none, f"{tmp_path}/none").count() == 0
    assert warc.resolved(warc.read_archives(spark, f"{tmp_path}/none")).count() == 0
    long = spark.createDataFrame([(1, "u", "<p>word</p>" * 500_000, *"xyzw"), (2, "v", "<p>word</p>" * 500_000, *"xyzw")], PAGES)
    warc.write_archives(long, f"{tmp_path}/long")
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in warc.resolved(warc.read_archives(spark, f"{tmp_path}/long")).collect())
    assert got == [(1, 5_500_000, "revisit", 2), (2, 5_500_000, "response", None)]


def members(n=6, size=400):
    out = []
    for i in range(n):
        payload = b"%d " % i + os.urandom(size).hex().encode()
        out.append(warc.page_record("response", f"urn:r{i}", i, f"http://x/{i}", payload, len(payload), warc.digest(payload)))
    return out


def ids(found):
    return [int(what["warc-page-id"]) for _, _, what, block in found if block is not None]


def gaps(found):
    return [(a, b, what) for a, b, what, block in found if block is None]


def test_salvage_of_gzip_members():
    raw = [warc.member(r) for r in members()]
    at = [sum(map(len, raw[:i])) for i in range(7)]
    whole = b"".join(raw)
    assert ids(warc.salvaged(whole, True)) == list(range(6)) and gaps(warc.salvaged(whole, True)) == []

    flipped = bytearray(whole)
    flipped[at[2] + len(raw[2]) // 2] ^= 0xFF
    found = list(warc.salvaged(bytes(flipped), True))
    assert ids(found) == [0, 1, 3, 4, 5] and [g[:2] for g in gaps(found)] == [(at[2], at[3])]

    cut = whole[: at[1] + 30] + whole[at[3] :]  # the rest of 1 and all of 2 are lost
    found = list(warc.salvaged(cut, True))
    assert ids(found) == [0, 3, 4, 5] and [g[:2] for g in gaps(found)] == [(at[1], at[1] + 30)]

    found = list(warc.salvaged(b"junk" + whole[:-10], True))
    assert ids(found) == [0, 1, 2, 3, 4] and gaps(found) == [(0, 4, "no gzip member"), (4 + at[5], 4 + at[6] - 10, "gzip member is cut off")]

    # A false start inside the damage is no record.
    found = list(warc.salvaged(whole[: at[1]] + warc.MAGIC * 50 + whole[at[1] :], True))
    assert ids(found) == list(range(6)) and [g[:2] for g in gaps(found)] == [(at[1], at[1] + 150)]


def test_salvage_of_version_lines():
    raw = members()
    at = [sum(map(len, raw[:i])) for i in range(7)]
    whole = b"".join(raw)
    assert ids(warc.salvaged(whole, False)) == list(range(6))
    broken = bytearray(whole)
    broken[at[3] - 40] ^= 1  # inside the payload of 2
    found = list(warc.salvaged(bytes(broken), False))
    assert ids(found) == [0, 1, 3, 4, 5] and gaps(found) == [(at[2], at[3], "block digest")]
    found = list(warc.salvaged(whole[: at[4] - 9] + whole[at[4] :], False))
    assert ids(found) == [0, 1, 2, 4, 5] and gaps(found) == [(at[3], at[4] - 9, "record does not end where its length says")]
    found = list(warc.salvaged(whole.replace(b"Content-Length: ", b"Content-Length: x", 1), False))
    assert ids(found) == [1, 2, 3, 4, 5]


def test_salvage_inside_a_member():
    raw = members(3)
    bad = bytearray(raw[1])
    bad[-20] ^= 1
    content = raw[0] + bytes(bad) + raw[2]
    data = warc.member(content) + warc.member(members(1)[0])
    found = list(warc.salvaged(data, True))
    assert ids(found) == [0, 2, 0]
    ((begin, end, what),) = gaps(found)
    assert (begin, end) == (0, len(warc.member(content))) and f"bytes {len(raw[0])} to {len(raw[0]) + len(raw[1])}" in what


def test_lost_response(spark, tmp_path):
    """A revisit whose response is in the damage stays, and names none."""
    rows = [(i, "u", "<p>same</p>", *"xyzw") for i in range(4)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    for f in (tmp_path / "w").iterdir():
        data = bytearray(f.read_bytes())
        for begin, end, what, block in list(warc.salvaged(bytes(data), True)):
            if what["warc-type"] == "response":
                data[begin + 20 : begin + 40] = b"\0" * 20
        f.write_bytes(bytes(data))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    found = warc.read_archives(spark, f"{tmp_path}/w")
    assert found.filter("gap is not null").count() == 1
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.resolved(found).collect()) == [(0, "revisit", None), (1, "revisit", None), (2, "revisit", None)]
