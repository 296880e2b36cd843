"""Streams give the rows of the batch form, in one trigger and in many."""

import datetime
import json
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators.aggregates import progress
from cuelake.plans import inputs as I
from cuelake.plans import live_queries as Q
from cuelake.sources import readers as R
from cuelake.streaming import live as L
from tests import oracle


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return sorted(map(str, spark.table(name).collect()))


def clocked(rows):
    """Rows by a clock that starts at one minute: a stream's first watermark is zero, and what is not after it is late."""
    return rows.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 1 MINUTE"))


@pytest.mark.parametrize("files", [1, 3])
def test_live_transcript(spark, sf_dir, tmp_path, files):
    rows = clocked(Q.hypotheses(I.segments(spark, sf_dir)).filter("session_id < 6000"))
    rows.cache()
    for k in range(files):  # later cycles in later files
        part = rows.filter(F.floor(F.col("cycle") * files / 40).cast("int") == k) if k < files - 1 else rows.filter(F.floor(F.col("cycle") * files / 40) >= k)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
    stream = R.read_hypotheses_stream(spark, str(tmp_path / "h"), 1)
    want = sorted(map(str, L.live_transcript(rows).collect()))
    assert drained(spark, L.live_transcript(stream), f"live{files}") == want


def test_utterances_and_sessions(spark, sf_dir, tmp_path):
    rows = clocked(Q.frames(I.segments(spark, sf_dir)).filter("session_id < 4"))
    rows.coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = R.read_frames_stream(spark, str(tmp_path / "f"))
    assert drained(spark, L.utterances(stream), "utter") == sorted(map(str, L.utterances(rows).collect()))
    closed = drained(spark, L.speech_sessions(stream), "sess")
    whole = sorted(map(str, L.speech_sessions(rows).collect()))
    assert set(closed) <= set(whole) and len(closed) >= len(whole) / 2


def in_files(df, path, order, n=3):
    """df as n files, in order."""
    rows = df.withColumn("__part", F.ntile(n).over(Window.orderBy(order)))
    for k in range(1, n + 1):
        rows.filter(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_reveal_and_graduation(spark, sf_dir, tmp_path):
    s = I.segments(spark, sf_dir).filter("media_id < 20")
    lists = s.select(F.col("media_id").alias("session_id"), F.col("ord").alias("cycle"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"))
    shown = L.append_only(in_files(lists, str(tmp_path / "w"), "cycle"))
    assert drained(spark, shown, "shown") == sorted(map(str, L.append_only(lists).collect()))
    lines = s.select(F.col("media_id").alias("session_id"), F.col("ord").alias("line_no"), "start_ms")
    left = L.graduated(in_files(lines, str(tmp_path / "l"), "line_no"))
    assert drained(spark, left, "left") == sorted(map(str, L.graduated(lines).collect()))


def test_drafts_of_finals(spark, sf_dir, tmp_path):
    s = I.segments(spark, sf_dir).filter("media_id < 20")
    finals, drafts = Q.finals(s), Q.drafts(s)
    want = [str(r) for r in L.finals_with_drafts(finals, drafts).collect()]
    stream = L.finals_with_drafts(in_files(finals, str(tmp_path / "f"), "event_ts"), in_files(drafts, str(tmp_path / "d"), "event_ts"))
    got = drained(spark, stream, "joined")
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert {r for r in want if "reused=None" not in r} <= set(got)
    assert any("reused=None" in r for r in got)


def test_batches_and_late_rows(spark, sf_dir, tmp_path):
    frames = clocked(Q.frames(I.segments(spark, sf_dir)).filter("session_id < 4"))
    stream, calls = in_files(frames, str(tmp_path / "f"), "event_ts"), []
    write = L.by_batch(str(tmp_path / "out"))

    def call(rows, batch_id):
        calls.append(batch_id)
        write(rows, batch_id)
        write(rows, batch_id)  # a batch that is repeated

    q = L.on_batches(L.utterances(stream), call, str(tmp_path / "c"))
    assert q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, L.utterances(frames).collect()))
    assert calls == sorted(set(calls)) and len(calls) >= 3

    speech = frames.filter("is_speech").limit(1).withColumn("event_ts", F.timestamp_millis(F.lit(0)))
    newest = speech.withColumn("event_ts", F.timestamp_millis(F.lit(10_000_000)))
    for rows in (newest, newest, speech):
        rows.write.mode("append").parquet(str(tmp_path / "late"))
    again = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    q = L.speech_sessions(again).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert L.late_rows(q) == 1


def test_running_results(spark, sf_dir, tmp_path):
    """In update mode the last row of a key is the batch form's row."""
    s = I.segments(spark, sf_dir).filter("media_id < 20")
    actions = s.select(F.col("media_id").alias("session_id"), F.col("role").alias("action"), F.col("ord").alias("seq"))
    drafts = s.select(F.col("media_id").alias("session_id"), F.floor(F.col("seg_no") / 2).cast("bigint").alias("index"), F.lit("xx").alias("lang"), "text", F.col("seg_no").alias("cycle"))
    chunks = s.select("media_id", F.floor(F.col("ord") / 8).alias("chunk_no"), "end_ms")
    for name, rows, order, keys, form in (
        ("acts", actions, "seq", ["session_id"], L.latest_actions),
        ("drafted", drafts, "cycle", ["session_id", "index", "lang"], L.drafts_to_translate),
        ("running", chunks, "end_ms", ["media_id", "chunk_no"], progress),
    ):
        drained(spark, form(in_files(rows, str(tmp_path / name), order)), name, "update")
        last = {tuple(r[k] for k in keys): r for r in spark.table(name).collect()}
        assert sorted(map(str, last.values())) == sorted(map(str, form(rows).collect()))
        assert spark.table(name).count() > len(last)


def state_rows(query):
    return sum(op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"])


def test_state_ends(spark, tmp_path):
    """No state is left of sessions that stopped or fell silent; a row after the silence begins anew, in streams and batches alike."""
    word = "struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>"
    schema = f"session_id bigint, cycle bigint, kind string, buffer_start_ms bigint, buffer_dur_ms bigint, words array<{word}>, event_ts timestamp"
    said = [(f"w{i}", 100 * i, 100 * i + 50, 0.5) for i in range(6)]

    def row(session, cycle, second, kind="partial", words=said):
        return (session, cycle, kind, 0, 3000, words, datetime.datetime.fromtimestamp(1000 + second, datetime.timezone.utc))

    rows = [
        row(1, 0, 0), row(1, 1, 1), row(1, 2, 2, "stop"),  # stops
        row(2, 0, 0), row(2, 1, 1), row(2, 2, 200), row(2, 3, 201),  # silent for longer than a minute, then anew
        row(3, 0, 0), row(3, 1, 1),  # silent to the end
        row(4, 0, 500, "stop"), row(4, 1, 900, "stop"),
    ]
    whole = spark.createDataFrame(rows, schema)
    stream = L.live_transcript(in_files(whole, str(tmp_path / "h"), "event_ts", len(rows)), silent_ms=60_000)
    q = stream.writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    want = L.live_transcript(whole, silent_ms=60_000)
    assert sorted(map(str, spark.table("ended").collect())) == sorted(map(str, want.collect()))
    again = [r for r in want.collect() if r.session_id == 2 and r.event == "draft"]
    assert [(r.cycle, r.line_no) for r in sorted(again, key=lambda r: r.cycle)] == [(1, 0), (3, 0)]
    assert state_rows(q) == 0


def by_hand(rows):
    """Live events of one session told step by step, apart from the library's code: (cycle, event, line, text)."""
    out, pending, before, lines, shown, last_end = [], [], [], 0, "", 0
    clean = lambda w: w.strip().lower().strip(".,!?;:、，。？！；：")

    def text(ws):
        said = ""
        for w in ws:
            if w:
                said += w if w[0] in " '’,.!?:;" else " " + w
        return said.strip()

    def unreal(words):
        if not words:
            return False
        if sum(w[3] for w in words) / len(words) < 0.35:
            return True
        if "thanks for watching" in " ".join(w[0].strip() for w in words if w[0]).lower():
            return True
        tokens = [w[0].lower().strip(".,!?;:、，。") for w in words if w[0]]
        if len(tokens) >= 5 and max(map(tokens.count, tokens)) / len(tokens) > 0.55:
            return True
        pairs = [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
        return len(tokens) >= 6 and max(map(pairs.count, pairs)) / len(pairs) > 0.45

    for cycle, kind, end, dur, words in rows:
        events, bad = [], unreal(words)
        if kind == "partial" and (bad or not words):
            continue
        if bad or (kind == "stop" and dur < 400):
            words = []
        words = [w for w in words if w[1] >= last_end]
        if kind == "partial":
            n = 0
            while n < min(len(before), len(words)) and clean(before[n][0]) == clean(words[n][0]) and abs(before[n][1] - words[n][1]) <= 500:
                n += 1
            while n < len(words) and words[n][3] >= 0.72 and end - words[n][2] >= 150:
                n += 1
            n = len(words) if n == 0 and dur >= 12_000 else n
        else:
            n = len(words)
        last_end = words[n - 1][2] if n else last_end
        before = words[n:]
        for w in words[:n]:
            pending.append(w)
            marks = [p[0].strip()[-1:] for p in pending]
            hard = [m for m in marks if m and m in ".!?。？！"]
            if (marks[-1] in ".!?。？！" and marks[-1] and len(hard) >= 2) or (not (marks[-1] and marks[-1] in ".!?。？！") and len(pending) >= 28):
                if text([p[0] for p in pending]):
                    events.append(("final", lines, text([p[0] for p in pending])))
                    lines, shown = lines + 1, ""
                pending = []
        if pending and (kind == "stop" or (kind == "pause" and len(pending) >= 8)):
            if text([p[0] for p in pending]):
                events.append(("final", lines, text([p[0] for p in pending])))
                lines, shown = lines + 1, ""
            pending = []
        if kind == "pause":
            shown = ""
        draft = text([p[0] for p in pending])
        if draft and draft != shown:
            events.append(("draft", lines, draft))
            shown = draft
        tail = " ".join(w[0].strip() for w in before).strip()
        if tail:
            events.append(("partial", lines, tail))
        elif kind == "partial":
            if not events:
                events.append(("partial", lines, ""))
        elif not pending and (kind == "pause" or dur >= 400):
            events.append(("partial", lines, ""))
        out += [(cycle, *e) for e in events]
        if kind == "stop":
            pending, before, lines, shown, last_end = [], [], 0, "", 0
    return out


def test_live_events_told_by_hand(spark):
    """Random sessions with pauses, stops, made-up cycles, words that bring spaces and empty words."""
    rng = random.Random(8)
    vocabulary = ["so", " we", "go.", "on", ",", "yes!", "no", "", "home ", "and"]
    word = "struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>"
    schema = f"session_id bigint, cycle bigint, kind string, buffer_start_ms bigint, buffer_dur_ms bigint, words array<{word}>, event_ts timestamp"
    table, want = [], []
    for session in range(60):
        text = [(rng.choice(vocabulary), 300 * i, 300 * i + 200, rng.choice([0.3, 0.6, 0.9])) for i in range(90)]
        told, seen = [], 0
        for cycle in range(24):
            seen = min(90, seen + rng.randrange(7))
            words = [w if rng.random() > 0.05 else (w[0] + "x", *w[1:]) for w in text[max(0, seen - 14) : seen]]
            if rng.random() < 0.12:
                words = [("Thanks", 0, 10, 0.9), (" for", 10, 20, 0.9), (" watching", 20, 30, 0.9)]
            if rng.random() < 0.08:
                words = []
            kind, dur = rng.choices(["partial", "pause", "stop"], [8, 2, 1])[0], rng.choice([200, 3_000, 12_000])
            end = words[-1][2] + rng.choice([100, 400]) if words else 0
            told.append((cycle, kind, end, dur, words))
            table.append((session, cycle, kind, end - dur, dur, words, datetime.datetime.fromtimestamp(1000 + cycle, datetime.timezone.utc)))
        want += [(session, *e) for e in by_hand(told)]
    got = L.live_transcript(spark.createDataFrame(table, schema)).select("session_id", "cycle", "event", "line_no", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {"final", "draft", "partial"} == {e[2] for e in want}


def test_live_fold_over_sessions_that_cross_batches(spark, sf_dir):
    rows = Q.hypotheses(I.segments(spark, sf_dir)).filter("session_id < 9000")
    held = {}
    for r in sorted(rows.collect(), key=lambda r: (r.session_id, r.cycle)):
        state, words = held.setdefault(r.session_id, ({}, [])), [tuple(w) for w in r.words]
        state[1].extend((r.cycle, *e) for e in L.live_step(state[0], r.cycle, r.kind, r.buffer_start_ms + r.buffer_dur_ms, r.buffer_dur_ms, words))
    want = sorted((k, *e) for k, (_, events) in held.items() for e in events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = L.live_transcript(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_parts_follow_the_words_of_all_cycles(spark, sf_dir, monkeypatch):
    rows = I.segments(spark, sf_dir)
    monkeypatch.setattr(Q, "TASK_ITEMS", 3000)
    words = Q.hypotheses(rows).select(F.sum(F.size("words"))).first()[0]
    assert 0.7 < Q.hypotheses(rows).rdd.getNumPartitions() / (words / 3000) < 1.6


@pytest.mark.parametrize("name", "t3_final_texts t4_sure_words t5_forced_words t6_lines t7_pause t8_stop t10_pause_events t11_dropped_cycle t20_session_summary".split())
def test_made_up_turns_in_sql(spark, tmp_path, name):
    rng = random.Random(3)
    turns = [" ".join(rng.choices(["of", "Of.", "the", "to!", "end"], [w, 3, 2, 2, 1], k=rng.randrange(1, 60))) for w in (2, 5, 12) for _ in range(25)]
    turns += ["so Thanks for watching it.", "of of of of", "a b of of of of of of of of of of of of"]
    rows = [(k // 3, k % 3, "user", t) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    oracle.check(spark, con, str(tmp_path), Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_frames_of_overlapping_turns_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    turns = [(m, k, s := rng.randrange(0, 3_000), s + rng.randrange(0, 900)) for m in range(6) for k in range(m)]
    monkeypatch.setattr(Q, "TASK_ITEMS", 100)
    got = Q.frames(spark.createDataFrame(turns, "media_id bigint, ord bigint, start_ms bigint, end_ms bigint"))
    want = []
    for m in range(1, 6):
        mine = [t for t in turns if t[0] == m]
        n = (max(t[3] for t in mine) + 500) // 30 + 1
        want += [(m, f, any(t[2] <= f * 30 < t[3] for t in mine)) for f in range(n)]
    assert sorted((r.session_id, r.frame_no, r.is_speech) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() == len(want) // 100 + 1


@pytest.mark.parametrize("name", "t3_final_texts t4_sure_words t5_forced_words t6_lines t7_pause t8_stop t10_pause_events t11_dropped_cycle".split())
def test_marks_that_cling_in_sql(spark, tmp_path, name):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["...", ", and", "'s", "’s", "? yes", ";", ": so.", "! no!"]
    turns = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 5, 9, 30, 70)] + ["... one two.", "? one. two. three ... four"]
    rows = [(k // 3, k % 3, "user", t) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    oracle.check(spark, con, str(tmp_path), Q.QUERIES[name], Q.ORACLE_SQL[name])
