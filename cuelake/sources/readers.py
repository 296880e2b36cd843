"""Sources: segment and transcript files, media catalogues, logs, live streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import schema
from cuelake.functions.timecode import half_up, seconds_to_ms

#: File extensions by kind.
VIDEO = ("mp4", "mov", "mkv", "avi", "mxf", "webm", "flv", "wmv", "m4v")
AUDIO = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "aiff", "wma")


def read_segments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Segment files with times in seconds, as BIGINT milliseconds."""
    raw = spark.read.schema(schema.SEGMENT_SECONDS).format(fmt).load(path)
    return raw.select(
        "media_id",
        "ord",
        seconds_to_ms(F.col("start")).alias("start_ms"),
        seconds_to_ms(F.col("end")).alias("end_ms"),
        F.coalesce("type", F.lit("speech")).alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        "language",
        "speaker",
        F.col("speakerLabel").alias("speaker_label"),
    )


def read_transcripts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recogniser output with nested words."""
    raw = spark.read.schema(schema.TRANSCRIPT_SECONDS).format(fmt).load(path)
    ms = lambda x: F.floor(x * 1000 + 0.5).cast("bigint")
    nested = F.transform(
        F.coalesce("words", F.array().cast(raw.schema["words"].dataType)),
        lambda w: F.struct(
            w["word"].alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms"), w["probability"].alias("probability")
        ),
    )
    return raw.select(
        "media_id", "ord", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "text", "language",
        "no_speech_prob", "avg_logprob", nested.alias("words"),
    )


def words_of(transcripts: DataFrame) -> DataFrame:
    """One row a word."""
    return transcripts.select("media_id", F.col("ord").alias("seg_no"), F.posexplode("words").alias("word_no", "w")).select(
        "media_id", "seg_no", F.col("word_no").cast("bigint").alias("word_no"), "w.word", "w.start_ms", "w.end_ms", F.col("w.probability").alias("prob")
    )


def media_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio").otherwise("other")


def read_media(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, length, kind) of files; their contents are pruned from the scan."""
    return spark.read.format("binaryFile").load(path_glob).select("path", "length", media_kind(F.col("path")).alias("kind"))


def choose_source(paths: DataFrame) -> DataFrame:
    """One path for each group: audio before video before others, then the first listed."""
    kind = media_kind(F.col("path"))
    rank = F.when(kind == "audio", 0).when(kind == "video", 1).otherwise(2)
    return paths.groupBy("group_id").agg(F.min_by("path", F.struct(rank.alias("r"), F.col("ord"))).alias("path"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SAMPLES).parquet(path)


def parse_silence_log(lines: DataFrame) -> DataFrame:
    """(media_id, chunk_no, chunk_start_ms, chunk_end_ms, log) to silences.

    The log of a chunk has silence_start and silence_end numbers in seconds
    from the chunk's start; starts below 0 count as 0 and a missing last end is
    the chunk's end.
    """
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"

    def times(name):
        found = F.regexp_extract_all("log", F.lit(name + r":\s*" + number), F.lit(1))
        return F.transform(found, lambda x: half_up(x.cast("double") * 1000))

    pairs = F.arrays_zip(times("silence_start").alias("s"), times("silence_end").alias("e"))
    rows = lines.select("media_id", "chunk_no", "chunk_start_ms", "chunk_end_ms", F.posexplode(pairs).alias("ord", "p"))
    start = F.col("chunk_start_ms") + F.greatest(F.lit(0), F.col("p.s"))
    end = F.coalesce(F.col("chunk_start_ms") + F.col("p.e"), F.col("chunk_end_ms"))
    timed = rows.filter(F.col("p.s").isNotNull()).select(
        "media_id", "chunk_no", F.col("ord").cast("bigint").alias("ord"), start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms")
    )
    return timed.filter(F.col("end_ms") > F.col("start_ms")).withColumn(
        "type", F.when(F.col("end_ms") - F.col("start_ms") < 400, "breath").otherwise("silence")
    )


def parse_duration(line: Column) -> Column:
    """Milliseconds of a ``Duration: H:M:S.f`` line; 0 without one."""
    at = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(line, at, i)
    ms = part(1).cast("bigint") * 3_600_000 + part(2).cast("bigint") * 60_000 + half_up(part(3).cast("double") * 1000)
    return F.when(F.regexp_like(line, F.lit(at)), ms).otherwise(F.lit(0)).cast("bigint")


def read_frames_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_hypotheses_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.HYPOTHESES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_control(message: Column) -> Column:
    """A control message; language auto is null."""
    made = F.from_json(message, schema.CONTROL)
    return made.withField("language", F.nullif(made["language"], F.lit("auto")))


ACTIONS = ("start", "stop")


def read_messages_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Raw messages as a stream: lines of the files of a folder, or with source="kafka" (and its options) the values of a topic."""
    if source == "kafka":
        return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("event_ts"))
    return spark.readStream.format("text").options(**options).load(source).select("value", F.col("_metadata.file_modification_time").alias("event_ts"))


def parsed_messages(raw: DataFrame, *keep: str) -> DataFrame:
    """value and event_ts (and columns to keep), the parsed message, and why it is bad (null for a good one).

    A message is a control with a known action, or audio with a session and PCM
    samples of two bytes in base64.  ``good`` and ``bad`` tell them apart; bad ones keep their value.
    """
    m = F.from_json(F.col("value"), schema.MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.withColumn("m", m)
    pcm = F.try_to_binary(F.col("m.audio"), F.lit("base64"))
    reason = (
        F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "no JSON object of this form")
        .when(F.col("m.session_id").isNull(), "no session")
        .when(F.col("m.action").isNull() & F.col("m.audio").isNull(), "neither action nor audio")
        .when(F.col("m.action").isNotNull() & ~F.col("m.action").isin(*ACTIONS), "unknown action")
        .when(F.col("m.audio").isNotNull() & (pcm.isNull() | (F.octet_length(pcm) % 2 != 0)), "no PCM in base64")
    )
    made = F.struct(
        F.col("m.session_id").alias("session_id"), F.col("m.action").alias("action"), F.nullif(F.col("m.language"), F.lit("auto")).alias("language"),
        F.coalesce("m.model", F.lit("base")).alias("model"), F.coalesce("m.time_offset", F.lit(0.0)).alias("time_offset"), pcm.alias("pcm"),
    )
    return rows.select(*keep, "value", "event_ts", F.when(reason.isNull(), made).alias("message"), reason.alias("reason"))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("event_ts", "message.*")


def bad(parsed: DataFrame) -> DataFrame:
    """Messages that could not be taken, for a table of their own."""
    return parsed.filter(F.col("reason").isNotNull()).select("event_ts", "value", "reason")
