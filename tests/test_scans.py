"""Scans in bins and blocks against loops over whole media."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import joins as J
from cuelake.operators import models as M
from cuelake.operators import scans as S
from cuelake.operators import sets as U
from cuelake.operators import textual as X
from cuelake.operators import windows as W
from cuelake.plans import text_queries
from tests import oracle


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how,exclusive,descending", [("sum", False, False), ("min", True, False), ("max", False, True), ("last", True, False), ("last", False, False), ("min", False, True)])
def test_running_aggregates(spark, how, exclusive, descending):
    rng = random.Random(1)
    rows = [(m, rng.randrange(-50, 400), k, rng.choice([None, *range(9)])) for m in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "media_id bigint, t bigint, k bigint, v bigint")
    got = S.carried(df, how, {"out": F.col("v")}, F.col("t"), ("k",), descending=descending, exclusive=exclusive, width=37)
    want = []
    for m in range(4):
        mine = sorted((r for r in rows if r[0] == m), key=lambda r: r[1:3], reverse=descending)
        for i, r in enumerate(mine):
            vs = [x[3] for x in mine[: i if exclusive else i + 1] if x[3] is not None]
            want.append((*r, None if not vs else {"sum": sum, "min": min, "max": max, "last": lambda v: v[-1]}[how](vs)))
    assert rows_of(got.select("media_id", "t", "k", "v", "out")) == sorted(want, key=repr)


def chain(rows, slack):
    threshold, out = None, []
    for r in rows:
        if r[3] is not None and (threshold is None or r[3] >= threshold):
            threshold = (r[4] if r[4] is not None else r[3]) - slack
            out.append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunk_chain_over_blocks(spark, seed):
    """Rows in any order, shorter than the slack, without times, over many blocks of one list and many lists."""
    rng = random.Random(seed)
    rows = []
    for media in range(3):
        at = 0
        for chunk in range(4):
            at = max(0, at - 300)
            for ord_ in range(2_500 if media == 0 else 30):
                at += rng.choice([-120, 0, 5, 60])
                length = rng.choice([0, 20, 90, 110, 400])
                rows.append((media, chunk, ord_, rng.choice([at] * 30 + [None]), rng.choice([at + length] * 30 + [None]), "x"))
    df = spark.createDataFrame(rows, "media_id bigint, chunk_no bigint, ord bigint, start_ms bigint, end_ms bigint, text string")
    want = [r for m in range(3) for r in chain([r for r in rows if r[0] == m], 100)]
    assert rows_of(W.dedupe_chunks(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("sentences,most,force", [(2, 28, True), (2, 28, False), (1, 4, True), (3, 7, False)])
def test_lines_over_blocks(spark, sentences, most, force):
    rng = random.Random(sentences * 10 + most)
    rows = [(m, seg, k, rng.choice(["a", "b.", "c", "d!", "e"])) for m, segs, n in ((0, 1, 3_000), (1, 40, 9), (2, 1, 1)) for seg in range(segs) for k in range(n)]
    want = []
    for m in range(3):
        held, ends, line, mine = 0, 0, 1, []
        for r in (r for r in rows if r[0] == m):
            hard = r[3][-1] in ".!"
            held, ends = held + 1, ends + hard
            mine.append((*r[:3], line))
            if ends >= sentences if hard else held >= most:
                held, ends, line = 0, 0, line + 1
        want += [r for r in mine if force or r[3] < line]
    df = spark.createDataFrame(rows, "media_id bigint, seg_no bigint, word_no bigint, word string")
    assert rows_of(W.group_lines(df, sentences, most, force)) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [50, 1_000])
def test_sweep(spark, width, monkeypatch):
    rng = random.Random(width)
    rows = []
    for m in range(3):
        for k in range(60):
            start = rng.randrange(0, 900)
            rows.append((m, k, start, start + rng.choice([0, 1, 30, 200]), rng.choice("ABC")))
    want = []
    for m in range(3):
        edges = sorted({t for r in rows if r[0] == m for t in r[2:4]})
        pieces = []
        for a, b in zip(edges, edges[1:]):
            active = [r for r in rows if r[0] == m and r[2] < b and r[3] > a]
            if active:
                speaker = max(active, key=lambda r: (r[2], -r[1]))[4]
                if pieces and pieces[-1][2] == a and pieces[-1][3] == speaker:
                    pieces[-1][2] = b
                else:
                    pieces.append([m, a, b, speaker])
        want += [(m, i + 1, a, b, s) for i, (m, a, b, s) in enumerate(pieces)]
    df = spark.createDataFrame(rows, "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, speaker string")
    monkeypatch.setattr(W, "sweep", lambda d: S.sweep(d, width))
    assert rows_of(W.resolve_overlaps(df)) == sorted(want, key=repr)
    edges = spark.createDataFrame([(m, t, t + 40) for m in range(3) for t in range(0, 1000, 40)], "media_id bigint, start_ms bigint, end_ms bigint")
    counts = [(m, t, t + 40, n) for m in range(3) for t in range(0, 1000, 40) if (n := sum(r[0] == m and r[2] < t + 40 and r[3] > t for r in rows))]
    assert rows_of(J.active_speakers(edges, df)) == sorted(counts, key=repr)


def test_cut_time_with_overlapping_cuts(spark):
    rng = random.Random(9)
    cuts = [(m, s, s + rng.randrange(1, 90)) for m in range(3) for s in (rng.randrange(0, 500) for _ in range(20))]
    times = [(m, t) for m in range(4) for t in range(0, 650, 7)]
    want = [(m, t, sum(max(0, min(t, e) - s) for c, s, e in cuts if c == m)) for m, t in times]
    cut_rows = spark.createDataFrame(cuts, "media_id bigint, start_ms bigint, end_ms bigint")
    assert rows_of(J.removed_before(spark.createDataFrame(times, "media_id bigint, t bigint"), cut_rows)) == sorted(want, key=repr)
    left = spark.createDataFrame([(m, t, t + 13) for m, t in times], "media_id bigint, start_ms bigint, end_ms bigint")
    gone = dict(((m, t), x) for m, t, x in want)
    for m, s, e, a, b in J.without_cuts(left, cut_rows).collect():
        later = sum(max(0, min(e, y) - x) for c, x, y in cuts if c == m)
        assert (a, b) == (s - gone[(m, s)], e - later)


def test_pieces_and_shares_of_a_long_segment(spark):
    text = "word, " * 30_000
    df = spark.createDataFrame([(1, 0, 0, text, 0, 60_000_000)], "media_id bigint, ord bigint, seg_no bigint, text string, start_ms bigint, end_ms bigint")
    pieces = X.split_segments(df, "punctuation")
    got = pieces.agg(F.count("*"), F.min("start_ms"), F.max("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms"))).first()
    assert tuple(got) == (30_000, 0, 60_000_000, 60_000_000)
    said = spark.createDataFrame([(1, 0, "xx", "mot " * 60_000)], "media_id bigint, seg_no bigint, lang string, text string")
    dealt = X.split_translation(pieces, said)
    assert dealt.filter("translation <> 'mot mot'").count() == 0 and dealt.count() == 30_000


def test_a_model_is_made_once_in_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        import os

        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda ps: [p.split("\n\n", 1)[1] for p in ps]

    rows = spark.createDataFrame([(m, k, f"line {k}") for m in range(40) for k in range(9)], "media_id bigint, ord bigint, text string").repartition(8)
    for _ in range(2):
        got = M.translate(rows, factory, "fr", size=3, source="en", key="shared", most=2)
        assert got.filter(F.col("text") != F.concat(F.lit("line "), F.col("seg_no"))).count() == 0
    workers = open(made).read().split()
    assert len(workers) == len(set(workers))


@pytest.mark.parametrize("dense", [2, 50_000])
def test_interval_joins_in_dense_bins(spark, monkeypatch, dense):
    monkeypatch.setattr(J, "DENSE", dense)
    rng = random.Random(dense)

    def spans(n):
        return [(m, k, (s := rng.choice([rng.randrange(-20, 3_000), 700])), s + rng.choice([0, 1, 40, 900])) for m in range(3) for k in range(n)]

    left, right = spans(40), spans(25)
    kind = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint"
    l, r = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    want = sorted((*a, *b[1:]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    pairs = J.overlap_pairs(l, r, bin_ms=500).select("media_id", "l.ord", "l.start_ms", "l.end_ms", "r.ord", "r.start_ms", "r.end_ms")
    assert sorted(map(tuple, pairs.collect())) == want
    hits = J.point_pairs(l, "start_ms", r, F.col("r.start_ms") - 7, F.col("r.end_ms") + 3, bin_ms=500).select("media_id", "l.ord", "r.ord")
    assert sorted(map(tuple, hits.collect())) == sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] - 7 <= a[2] < b[3] + 3)
    if dense == 2:
        busy = J.dense_bins([l.select("media_id", F.col("start_ms").alias("at"))], 500)
        assert busy.count() > 3 and busy.agg(F.max("part_ms")).first()[0] < 500
    else:
        assert J.dense_bins([l.select("media_id", F.col("start_ms").alias("at"))], 500) is None


@pytest.mark.parametrize("n", [1, 3, 4, 5, 8])
def test_last_characters_begin_with_the_space_between_rows(spark, n):
    texts = {0: ["ab", "cde", "f", None, "ghij"], 1: ["", "", "k"], 2: [None, "lmn"]}
    rows = [(m, k, t) for m, ts in texts.items() for k, t in enumerate(ts)]
    got = U.last_characters(spark.createDataFrame(rows, "media_id bigint, ord bigint, text string"), n)
    assert rows_of(got) == [(m, " ".join(t for t in ts if t is not None)[-n:]) for m, ts in texts.items()]


def test_levels_equal_to_the_threshold_and_frames_of_one_id(spark, tmp_path):
    import duckdb

    rows = [(k, 1, [x, -0.1]) for k, x in enumerate([0.35, 0.35, 0.35, 0.35, 0.36, -0.35, 0.2, 0.1, 0.34])]
    rows += [(k // 4, 2, [x]) for k, x in enumerate([0.4, 0.1, 0.2, 0.5] * 3)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "w18_silence_runs"
    oracle.check(spark, con, str(tmp_path), text_queries.QUERIES[name], text_queries.ORACLE_SQL[name])
    assert text_queries.QUERIES[name](spark, str(tmp_path)).count() == 2  # of label 2, no run has four frames


@pytest.mark.parametrize("name", ["f15_sentences", "f17_compose_wide"])
def test_texts_are_searched_once(spark, sf_dir, name):
    plan = text_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_translations_are_dealt_from_their_texts(spark):
    rows = [([2, 1, 3], " a\tb  c\nd e\x0bf g h "), ([1, 1], None), ([4], " x  y "), ([1, 1], "")]
    got = spark.createDataFrame(rows, "n array<int>, whole string").select(text_queries.T.dealt("n", "whole").alias("d")).collect()
    assert [r.d for r in got] == [["a b", "c", "d e f g h"], [None, None], [" x  y "], ["", ""]]
