"""Sinks: subtitles, transcripts, edit lists and their file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import basename, stem
from cuelake.functions.timecode import srt_time
from cuelake.operators.filters import speech_nonblank
from cuelake.operators.joins import not_fully_cut, without_cuts
from cuelake.operators.windows import numbered


def _joined(rows: DataFrame, line: Column, sep: str, *keys: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    return rows.groupBy("media_id", *keys).agg(
        F.count("*").alias("n_lines"), F.array_join(F.transform(held, lambda x: x["line"]), sep).alias("content")
    )


def _srt_block() -> Column:
    return F.concat(
        F.col("number").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")),
        F.lit("\n"), F.col("text"), F.lit("\n"),
    )


def _srt(rows: DataFrame, *keys: str) -> DataFrame:
    return _joined(numbered(rows, keys=("media_id", *keys)), _srt_block(), "\n", *keys)


def srt_file_rows(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """(name, number, line) of subtitle files for ``files.save``: timed rows with text, and a name for each media (and other keys).

    The lines of a file make the content that the subtitle functions give, but no row holds a whole file.
    """
    placed = numbered(rows, keys=("media_id", *keys)).join(names.hint("merge"), ["media_id", *keys])
    line = F.concat(F.when(F.col("number") > 1, "\n").otherwise(""), _srt_block())
    return placed.select("name", "number", line.alias("line"))


def srt_original(segments: DataFrame) -> DataFrame:
    """(media_id, n_lines, content): subtitles at the times of the source."""
    return _srt(speech_nonblank(segments).withColumn("text", F.trim("text")))


def srt_live(segments: DataFrame) -> DataFrame:
    """As srt_original, with texts as they are."""
    return _srt(speech_nonblank(segments))


def shifted(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Times with the cut time before them taken out; rows left with no length go."""
    moved = without_cuts(rows, cuts).drop("start_ms", "end_ms").withColumnsRenamed({"new_start": "start_ms", "new_end": "end_ms"})
    return moved.filter(F.col("end_ms") > F.col("start_ms"))


def srt_after_cuts(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    left = not_fully_cut(speech_nonblank(segments), cuts).withColumn("text", F.trim("text"))
    return _srt(shifted(left.select("media_id", "ord", "start_ms", "end_ms", "text"), cuts))


def srt_translated(segments: DataFrame, translations: DataFrame, cuts: DataFrame) -> DataFrame:
    """Subtitles of each language, after cuts; empty translations go."""
    said = translations.filter(F.trim("text") != "").select("media_id", F.col("seg_no").alias("ord"), "lang", F.trim("text").alias("text"))
    rows = speech_nonblank(segments).select("media_id", "ord", "start_ms", "end_ms").join(said, ["media_id", "ord"])
    return _srt(shifted(rows, cuts), "lang")


def txt(segments: DataFrame) -> DataFrame:
    return _joined(numbered(speech_nonblank(segments)), F.trim("text"), "\n")


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def edl(clips: DataFrame, fps: int = 30) -> DataFrame:
    """Edit list of a timeline (media_id, name, clip_no, in_frame, out_frame, out_start, out_end, camera) as XML text."""
    line = F.concat(
        F.format_string(
            '    <clipitem id="clip-%d"><name>%s</name><start>%d</start><end>%d</end><in>%d</in><out>%d</out><track>%d</track></clipitem>',
            F.col("clip_no"), xml_escaped(F.col("name")), F.col("out_start"), F.col("out_end"), F.col("in_frame"), F.col("out_frame"), F.col("camera"),
        )
    )
    held = F.array_sort(F.collect_list(F.struct("clip_no", line.alias("line"))))
    body = clips.groupBy("media_id").agg(F.max("out_end").alias("n_frames"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("body"))
    head = F.format_string('<sequence id="%d"><rate><timebase>%d</timebase></rate><duration>%d</duration>\n  <video>\n', "media_id", F.lit(fps), "n_frames")
    return body.select("media_id", "n_frames", F.concat(head, "body", F.lit("\n  </video>\n</sequence>\n")).alias("content"))


def output_name(path: Column, kind: str, lang: Column | None = None) -> Column:
    """Name of an output file: original, cut, edit list, or cut in a language."""
    if lang is not None:
        return F.concat(stem(path), F.lit("_cut_"), lang, F.lit(".srt"))
    return F.concat(stem(path), F.lit({"original": "_original.srt", "cut": "_cut.srt", "edit": "_edit.xml", "text": ".txt"}[kind]))


def dedupe_names(files: DataFrame, existing: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """(file_id, path) to names that clash neither with each other nor with existing ones: stem, then stem_1, stem_2, ...

    Files of one name take numbers in order of file_id.  Where files of two stems
    ask for one name, or it exists, the first (an existing one before all) has
    it and the other stem passes over that number; this is done again until no
    name is asked for twice, in as many rounds as names clash in a chain.
    """
    own = Window.partitionBy("stem", "ext").orderBy("file_id")
    base = basename(F.col("path"))
    placed = files.select(
        "file_id", F.regexp_replace(base, r"\.[^.]+$", "").alias("stem"), F.regexp_extract(base, r"(\.[^.]+)?$", 0).alias("ext")
    ).withColumn("place", F.row_number().over(own) - 1)
    blocked = placed.select("stem", "ext", F.col("place").alias("number")).limit(0)
    for _ in range(most_rounds):
        passed = blocked.groupBy("stem", "ext").agg(F.array_sort(F.collect_set("number")).alias("passed"))
        number = F.aggregate(F.coalesce("passed", F.array().cast("array<int>")), F.col("place"), lambda n, b: F.when(b <= n, n + 1).otherwise(n))
        suffix = F.when(F.col("number") == 0, "").otherwise(F.concat(F.lit("_"), F.col("number").cast("string")))
        named = placed.join(passed.hint("merge"), ["stem", "ext"], "left").withColumn("number", number).withColumn("name", F.concat("stem", suffix, "ext"))
        asked = named.select("name", F.struct(F.lit(1).alias("new"), "file_id").alias("who"))
        if existing is not None:
            asked = asked.unionByName(existing.select("name", F.struct(F.lit(0).alias("new"), F.lit(None).cast(files.schema["file_id"].dataType).alias("file_id")).alias("who")))
        clashes = asked.groupBy("name").agg(F.min("who").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
        lost = named.join(clashes.hint("merge"), "name").filter((F.col("first.new") == 0) | (F.col("first.file_id") != F.col("file_id"))).select("stem", "ext", "number").distinct()
        if lost.isEmpty():
            return named.select("file_id", "name")
        blocked = blocked.unionByName(lost).distinct()
    raise RuntimeError(f"names still clash after {most_rounds} rounds")


def write_text(rendered: DataFrame, path: str) -> None:
    """One folder a media, written in parallel by Spark."""
    rendered.select("media_id", "content").write.partitionBy("media_id").mode("overwrite").text(path)
