"""Hand-computed cases and properties."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake import schema
from cuelake.functions import text as T
from cuelake.functions import timecode as C
from cuelake.operators import joins as J
from cuelake.operators import windows as W
from cuelake.sources import export as E
from cuelake.sources import readers as R
from cuelake.streaming import live as L

TURNS = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, speaker string"


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, a, b, s) for i, (a, b, s) in enumerate(rows)], TURNS)


def spans(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_interjection_is_cut_out(spark):
    out = W.resolve_overlaps(turns(spark, (0, 10, "A"), (4, 6, "B")))
    assert spans(out, "start_ms", "end_ms", "speaker") == [(0, 4, "A"), (4, 6, "B"), (6, 10, "A")]


def test_turns_have_no_gaps(spark):
    out = W.merge_turns(turns(spark, (0, 3, "A"), (4, 6, "A"), (7, 9, "B")))
    assert spans(out, "start_ms", "end_ms", "speaker") == [(0, 7, "A"), (7, 9, "B")]


def test_whole_sentence_goes_to_one_speaker(spark):
    seg = spark.createDataFrame([(1, 0, 0, 10)], "media_id bigint, ord bigint, start_ms bigint, end_ms bigint")
    out = J.assign_dominant(seg, turns(spark, (0, 6, "A"), (6, 10, "B")))
    assert spans(out, "speaker") == [("A",)]


def test_complement_and_shift(spark):
    cuts = spark.createDataFrame([(1, 2000, 3000), (1, 5000, 6000)], "media_id bigint, start_ms bigint, end_ms bigint")
    media = spark.createDataFrame([(1, 8000), (2, 500)], "media_id bigint, duration_ms bigint")
    assert spans(W.kept_ranges(cuts, media), "media_id", "start_ms", "end_ms") == [(1, 0, 2000), (1, 3000, 5000), (1, 6000, 8000), (2, 0, 500)]
    times = spark.createDataFrame([(1, 2500), (1, 4000)], "media_id bigint, t bigint")
    assert spans(J.removed_before(times, cuts), "t", "removed_ms") == [(2500, 500), (4000, 1000)]


def test_greedy_chunks_and_midpoints(spark):
    rows = [(1, 0, 0, 0, 1000, "a"), (1, 0, 1, 500, 3000, "b"), (1, 0, 2, 1500, 1800, "c")]
    chunks = spark.createDataFrame(rows, "media_id bigint, chunk_no bigint, ord bigint, start_ms bigint, end_ms bigint, text string")
    assert spans(W.dedupe_chunks(chunks), "ord") == [(0,), (2,)]
    media = spark.createDataFrame([(1, 10)], "media_id bigint, duration_ms bigint")
    assert spans(W.turn_clips(turns(spark, (0, 4, "A"), (6, 9, "B")), media), "start_ms", "end_ms") == [(0, 5), (5, 10)]


def test_numbered_answers(spark):
    df = spark.createDataFrame([("1. a\n3. c", 3), ("1.\n2. x", 2), ("only\nlines", 2), ("[EMPTY]", 1), ("", 2)], "r string, n int")
    got = [r[0] for r in df.select(T.parse_numbered(F.col("r"), F.col("n"))).collect()]
    assert got[0] == ["a", "", "c"]
    assert got[1][0] == "2. x"
    assert got[2] == ["only", "lines"]
    assert got[3] == [""] and got[4] == ["", ""]


def test_lines_close_after_two_sentences(spark):
    rows = [(1, 0, i, w) for i, w in enumerate("a b. c d. e f.".split())]
    words = spark.createDataFrame(rows, "media_id bigint, seg_no bigint, word_no bigint, word string")
    assert spans(W.group_lines(words), "line_no", "word_no") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    assert len(W.group_lines(words, force=False).collect()) == 4


def test_logs_and_names(spark):
    log = spark.createDataFrame([(1, 0, 1000, 9000, "silence_start: -0.001\nsilence_end: 0.3\nsilence_start: 2.5")], "media_id bigint, chunk_no bigint, chunk_start_ms bigint, chunk_end_ms bigint, log string")
    assert spans(R.parse_silence_log(log), "start_ms", "end_ms", "type") == [(1000, 1300, "breath"), (3500, 9000, "silence")]
    files = spark.createDataFrame([(1, "/a/x.srt"), (2, "/b/x.srt"), (3, "/b/y.srt")], "file_id bigint, path string")
    taken = spark.createDataFrame([("y.srt",)], "name string")
    assert spans(E.dedupe_names(files, taken), "name") == [("x.srt",), ("x_1.srt",), ("y_1.srt",)]
    files = spark.createDataFrame([(i, p) for i, p in enumerate(["a.srt", "a.srt", "a_1.srt", "b_1", "b", "b", "b"])], "file_id bigint, path string")
    got = {r.file_id: r.name for r in E.dedupe_names(files).collect()}
    assert [got[i] for i in range(7)] == ["a.srt", "a_1.srt", "a_1_1.srt", "b_1", "b", "b_2", "b_3"]


def test_files_round_trip(spark, tmp_path):
    segs = spark.createDataFrame([(1, 0, 0.5, 1.2345, None, "hi", "en", None, None)], "media_id bigint, ord bigint, start double, end double, type string, text string, language string, speaker string, speakerLabel string")
    segs.write.json(str(tmp_path / "s"))
    assert spans(R.read_segments(spark, str(tmp_path / "s"), "json"), "start_ms", "end_ms", "type") == [(500, 1235, "speech")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.WAV").write_bytes(b"x")
    assert spans(R.read_media(spark, str(tmp_path / "m")), "kind", "length") == [("audio", 1)]
    speech = spark.createDataFrame([(1, 0, 0, 1500, "speech", "hi & bye")], "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, type string, text string")
    E.write_text(E.srt_original(speech), str(tmp_path / "out"))
    said = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "00:00:00,000 --> 00:00:01,500" in said


def test_displays(spark):
    df = spark.createDataFrame([(59_999,), (3_600_000,)], "ms bigint")
    assert [tuple(r) for r in df.select(C.clock(F.col("ms")), C.srt_time(F.col("ms"))).collect()] == [("1:00.00", "00:00:59,999"), ("60:00.00", "01:00:00,000")]


SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.sampled_from("ABC")), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPANS)
def test_resolved_turns_never_overlap(spark, raw):
    out = spans(W.resolve_overlaps(turns(spark, *[(a, a + n, s) for a, n, s in raw])), "start_ms", "end_ms")
    assert all(b[0] >= a[1] for a, b in zip(out, out[1:]))
    covered = {t for a, n, _ in raw for t in range(a, a + n)}
    assert covered == {t for a, b in out for t in range(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b.", "c"]), st.integers(0, 3)), max_size=6), max_size=6))
def test_committed_words_are_never_taken_back(cycles):
    state, finals = {}, []
    for i, words in enumerate(cycles):
        rows = [(w, 1000 * k + d, 1000 * k + d + 500, 0.5) for k, (w, d) in enumerate(words)]
        for event in L.live_step(state, i, "partial", 9000, 3000, rows):
            if event[0] == "final":
                finals.append(event)
    assert [f[1] for f in finals] == list(range(len(finals)))
    assert all(a[4] <= b[3] for a, b in zip(finals, finals[1:]))


def test_transcripts_with_words(spark, tmp_path):
    rows = [
        '{"media_id": 1, "ord": 0, "start": 0.5, "end": 2.0005, "text": "a b", "words": [{"word": "a", "start": 0.5, "end": 1.2345, "probability": 0.9}, {"word": " b", "start": 1.25, "end": 2.0}]}',
        '{"media_id": 1, "ord": 1, "start": 3, "end": 4, "text": null}',
    ]
    (tmp_path / "t.json").write_text("\n".join(rows))
    read = R.read_transcripts(spark, str(tmp_path / "t.json"))
    assert spans(read, "ord", "start_ms", "end_ms", "text") == [(0, 500, 2001, "a b"), (1, 3000, 4000, None)]
    want = [(0, 0, "a", 500, 1235, 0.9), (0, 1, " b", 1250, 2000, None)]
    assert spans(R.words_of(read), "seg_no", "word_no", "word", "start_ms", "end_ms", "prob") == want


def test_samples(spark, tmp_path):
    spark.createDataFrame([(1, 0, 16000, [1, -2]), (1, 1, 16000, [])], schema.SAMPLES).write.parquet(str(tmp_path / "s"))
    assert spans(R.read_samples(spark, str(tmp_path / "s")), "chunk_no", "sample_rate", "samples") == [(0, 16000, [1, -2]), (1, 16000, [])]


def test_compose_spacing(spark):
    words = [["Hello", ",", " world", "!"], ["", "a", ""], [" a", "b"], []]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").select(T.compose(F.col("w")).alias("t"))
    assert [r["t"] for r in got.collect()] == ["Hello, world!", "a", "a b", ""]
