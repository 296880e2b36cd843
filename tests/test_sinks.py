"""Files by name, the SQL table function, messages, late rows and superseded drafts."""

import base64
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.functions import tables
from cuelake.operators import textual as X
from cuelake.plans import inputs as I
from cuelake.sources import export as E
from cuelake.sources import files, readers
from cuelake.streaming import changes as C
from cuelake.streaming import live as L
from tests.test_streams import in_files


def test_one_file_a_media(spark, sf_dir, tmp_path):
    """Bytes and names are those of the rendered subtitles; nothing else is left; writing again replaces."""
    s = I.segments(spark, sf_dir).filter("media_id < 12")
    names = s.select("media_id").distinct().withColumn("name", E.output_name(F.concat(F.lit("/in/v"), F.col("media_id").cast("string"), F.lit(".mp4")), "original"))
    timed = s.filter(F.trim("text") != "").withColumn("text", F.trim("text")).select("media_id", "ord", "start_ms", "end_ms", "text")
    folder = str(tmp_path / "srt")
    for _ in range(2):
        files.save(E.srt_file_rows(timed, names), folder)
        want = {f"v{r.media_id}_original.srt": r.content.encode() for r in E.srt_original(s).collect()}
        assert {f: (tmp_path / "srt" / f).read_bytes() for f in os.listdir(folder)} == want


def test_repeated_and_failed_tasks(tmp_path):
    """Only the attempt that is committed leaves a file; an aborted job leaves none."""

    def batch(*rows):
        return iter([pa.RecordBatch.from_pylist([{"name": n, "number": k, "line": x} for n, k, x in rows])])

    job = files.NamedTextWriter(str(tmp_path))
    first = job.write(batch(("a.txt", 1, "one\n"), ("a.txt", 2, "two\n"), ("b.txt", 1, "é")))
    lost = job.write(batch(("a.txt", 1, "one\n")))
    assert lost.files and os.listdir(tmp_path) == [files.STAGING]
    job.commit([first, None])
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"a.txt": "one\ntwo\n", "b.txt": "é"}
    other = files.NamedTextWriter(str(tmp_path))
    other.abort([other.write(batch(("c.txt", 1, "x")))])
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt"]
    third = files.NamedTextWriter(str(tmp_path))
    with pytest.raises(ValueError):
        third.commit([third.write(batch(("d.txt", 1, "x"))), third.write(batch(("d.txt", 2, "y")))])
    with pytest.raises(ValueError):
        third.write(batch(("../e.txt", 1, "x")))
    third.abort([None])  # as Spark does after a failed task
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt"]


@pytest.mark.parametrize("how,most", [("natural", 0), ("word", 0), ("punctuation", 0), ("maxWords", 6)])
def test_split_in_sql(spark, sf_dir, how, most):
    s = I.segments(spark, sf_dir).select("media_id", "ord", "text", "start_ms", "end_ms")
    odd = spark.createDataFrame([(900, 0, "", 0, 10), (900, 1, None, 0, 10), (900, 2, " a,  b ", 0, 10), (900, 3, "x", 5, 5)], s.schema)
    both = s.unionByName(odd)
    both.createOrReplaceTempView("segments_to_split")
    tables.register(spark)
    columns = ["media_id", "parent_no", "piece_no", "text", "start_ms", "end_ms"]
    got = spark.sql(f"SELECT {', '.join(columns)} FROM split_segments(TABLE(segments_to_split), '{how}', {most})")
    want = X.split_segments(both, how, most).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_split_in_sql_asks_for_its_columns(spark):
    tables.register(spark)
    spark.range(3).createOrReplaceTempView("numbers_only")
    with pytest.raises(Exception, match="a table with"):
        spark.sql("SELECT * FROM split_segments(TABLE(numbers_only), 'word', 1)").collect()


def test_messages(spark, tmp_path):
    pcm = base64.b64encode(b"\1\0\2\0").decode()
    lines = [
        '{"session_id": 1, "action": "start", "language": "auto", "time_offset": 2.5}', '{"session_id": 1, "audio": "%s"}' % pcm, '{"session_id": 1, "action": "stop"}',
        "not json", '{"session_id": 1, "action": "dance"}', '{"action": "stop"}', '{"session_id": 2, "audio": "*"}', '{"session_id": 2, "audio": "QQ=="}', "{}", "[1]",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    parsed = readers.parsed_messages(readers.read_messages_stream(spark, str(tmp_path / "in")))

    def call(rows, batch_id):
        readers.good(rows).write.mode("append").parquet(str(tmp_path / "good"))
        readers.bad(rows).write.mode("append").parquet(str(tmp_path / "bad"))

    assert L.on_batches(parsed, call, str(tmp_path / "c")).awaitTermination(240)
    good = spark.read.parquet(str(tmp_path / "good")).collect()
    assert sorted((r.action or "", r.language, r.model, r.time_offset, bytes(r.pcm or b"")) for r in good) == [
        ("", None, "base", 0.0, b"\1\0\2\0"), ("start", None, "base", 2.5, b""), ("stop", None, "base", 0.0, b""),
    ]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.value for r in bad) == sorted(lines[3:]) and all(r.reason for r in bad)


def test_late_rows_are_kept(spark, tmp_path):
    """Each late row can be read, with the watermark that it missed; batches that are repeated change nothing."""
    side, passed = str(tmp_path / "side"), []
    split = C.apart_from_late(lambda rows, batch_id: passed.append((batch_id, sorted(r.k for r in rows.collect()))), side, late_ms=1_000)
    times = [[5_000, 4_500], [9_000, 3_900, 4_000], [7_999, 8_000], [20_000], [], [18_999, 19_500]]
    late = [[], [3_900], [7_999], [], [], [18_999]]
    for batch_id, batch in enumerate(times):
        rows = spark.createDataFrame([(t,) for t in batch], "k bigint").withColumn("event_ts", F.timestamp_millis("k"))
        split(rows, batch_id)
        split(rows, batch_id)
    kept = C.late_rows_kept(spark, side, "k bigint, event_ts timestamp").collect()
    assert sorted((r.batch_id, r.k) for r in kept) == [(i, k) for i, ks in enumerate(late) for k in ks]
    assert all(r.k < r.watermark_ms for r in kept)
    assert [p for i, p in enumerate(passed) if i % 2 == 0] == [(i, sorted(set(b) - set(late[i]))) for i, b in enumerate(times)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_superseded_drafts(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = [(s, i, "xx", " ".join(rng.choice(["one", "two"]) for _ in range(rng.randrange(2, 7))), c) for c in range(12) for s in range(3) for i in range(2) if rng.random() < 0.7]
    drafts = spark.createDataFrame(rows, "session_id bigint, index bigint, lang string, text string, cycle bigint")
    stream = C.draft_changes(in_files(drafts, str(tmp_path / "d"), "cycle", cuts))
    write = C.upserts(str(tmp_path / "t"))

    def call(rows, batch_id):
        write(rows, batch_id)
        write(rows, batch_id)

    assert L.on_batches(stream, call, str(tmp_path / "c")).awaitTermination(240)
    got = C.table_of(spark, str(tmp_path / "t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, L.drafts_to_translate(drafts).select(*got.columns).collect()))
    log = spark.read.parquet(str(tmp_path / "t"))
    assert log.filter("retracted").count() == log.filter("NOT retracted").count() - got.count() > 0
