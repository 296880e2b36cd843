"""Window and sequence operators, each within a media.

Groups of consecutive rows are numbered by running sums of change flags, so
Spark needs one shuffle on media_id for a whole chain of these operators.
Chains, sweeps and numbers come from ``scans``, where no task sees a whole media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import label_of
from cuelake.functions.timecode import div, frames
from cuelake.operators.scans import BEFORE_ALL, carried, fold_in_blocks, jump, jumps, lines, next_lines, sweep


def in_order(*order: str):
    return Window.partitionBy("media_id").orderBy(*order)


def _island(changed: Column, window) -> Column:
    return F.sum(F.when(changed, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))


def merge_turns(diar: DataFrame) -> DataFrame:
    """Gap-free speaker turns: each lasts until the next speaker starts."""
    by_start = in_order("start_ms", "ord")
    before = F.lag("speaker").over(by_start)
    islands = diar.withColumn("changed", before.isNull() | (F.col("speaker") != before)).withColumn(
        "island", _island(F.col("changed"), by_start)
    )
    turns = islands.groupBy("media_id", "island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("last_end"),
        F.min_by("speaker", F.struct("start_ms", "ord")).alias("speaker"),
    )
    following = F.lead("start_ms").over(in_order("island"))
    return (
        turns.withColumn("end_ms", F.coalesce(following, F.col("last_end")))
        .filter(F.col("end_ms") > F.col("start_ms"))
        .select("media_id", F.col("island").cast("bigint").alias("ord"), "start_ms", "end_ms", "speaker")
    )


def resolve_overlaps(diar: DataFrame) -> DataFrame:
    """One speaker at a time: in each slice between boundaries the latest to start, then the first listed, wins."""
    pieces = sweep(diar)
    before = carried(pieces, "last", {"before": F.struct("speaker", "end_ms")}, F.col("start_ms"), exclusive=True)
    opens = F.col("before").isNull() | ~F.col("before.speaker").eqNullSafe(F.col("speaker")) | (F.col("before.end_ms") != F.col("start_ms"))
    marked = carried(before.withColumn("opens", opens.cast("bigint")).drop("before"), "sum", {"island": F.col("opens")}, F.col("start_ms"))
    return marked.groupBy("media_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker")
    ).select("media_id", F.col("island").alias("ord"), "start_ms", "end_ms", "speaker")


def merge_silence(chunks: DataFrame, gap_ms: int = 100) -> DataFrame:
    """Silences of overlapping chunks in list order: a row joins while it starts within the gap of the furthest end."""
    listed = in_order("chunk_no", "ord")
    reach = F.max("end_ms").over(listed.rowsBetween(Window.unboundedPreceding, -1))
    islands = chunks.withColumn("opens", reach.isNull() | (F.col("start_ms") >= reach + gap_ms)).withColumn(
        "island", _island(F.col("opens"), listed)
    )
    return islands.groupBy("media_id", "island").agg(
        F.min_by("start_ms", F.struct("chunk_no", "ord")).alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("type", F.struct("chunk_no", "ord")).alias("type"),
    ).select("media_id", F.col("island").cast("bigint").alias("ord"), "start_ms", "end_ms", "type")


def dedupe_chunks(chunks: DataFrame, slack_ms: int = 100) -> DataFrame:
    """Speech of overlapping chunks: a row stays if it starts no earlier than the end of the last row that stayed, less the slack.

    A row without a start goes, one without an end ends at its start.
    """
    timed = chunks.select("media_id", "chunk_no", "ord", "start_ms", F.coalesce("end_ms", "start_ms", F.lit(0)).alias("until_ms"), "end_ms", "text")

    def kept(state, rows):
        (threshold,) = state
        for chunk_no, ord_, start, until, end, text in rows:
            if start is not None and start >= threshold:
                threshold = until - slack_ms
                yield chunk_no, ord_, start, end, text

    return fold_in_blocks(
        timed, ("chunk_no", "ord"), ("start_ms", "until_ms"), ("chunk_no", "ord", "start_ms", "until_ms", "end_ms", "text"), [BEFORE_ALL],
        lambda rows: jumps(rows, slack_ms), jump, kept, "chunk_no bigint, ord bigint, start_ms bigint, end_ms bigint, text string",
    )


def same_speaker_ranges(segments: DataFrame) -> DataFrame:
    """Runs of one speaker as single ranges, the end being the furthest."""
    listed = in_order("ord")
    before = F.lag("speaker").over(listed)
    runs = segments.withColumn("island", _island(before.isNull() | (before != F.col("speaker")), listed))
    return runs.groupBy("media_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker")
    ).select("media_id", F.col("island").cast("bigint").alias("ord"), "start_ms", "end_ms", "speaker")


def group_turns(diar: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Segments from speaker turns alone: joined while the speaker stays and the gap is short; the end is the last one's."""
    by_start = in_order("start_ms", "ord")
    opens = F.lag("ord").over(by_start).isNull() | (F.lag("speaker").over(by_start) != F.col("speaker"))
    opens = opens | (F.col("start_ms") - F.lag("end_ms").over(by_start) >= gap_ms)
    runs = diar.withColumn("island", _island(opens, by_start))
    place = F.struct("start_ms", "ord")
    return runs.groupBy("media_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", place).alias("end_ms"), F.min_by("speaker", place).alias("speaker")
    ).select("media_id", F.col("island").cast("bigint").alias("ord"), "start_ms", "end_ms", "speaker")


def turn_clips(turns: DataFrame, media: DataFrame) -> DataFrame:
    """The whole timeline cut midway between turns."""
    by_start = in_order("start_ms", "ord")
    joined = turns.join(media.select("media_id", "duration_ms"), "media_id")
    middle = lambda a, b: div(a + b, 2)
    before, after = F.lag("end_ms").over(by_start), F.lead("start_ms").over(by_start)
    return joined.select(
        "media_id",
        "ord",
        "speaker",
        F.coalesce(middle(before, F.col("start_ms")), F.lit(0)).cast("bigint").alias("start_ms"),
        F.coalesce(middle(F.col("end_ms"), after), F.col("duration_ms")).alias("end_ms"),
    )


def kept_ranges(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """What is left of [0, duration) without the cuts; the whole timeline if nothing is."""
    closed = cuts.select("media_id", "start_ms", "end_ms").unionByName(
        media.select("media_id", F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    )
    reach = F.max("end_ms").over(in_order("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1))
    gaps = (
        closed.withColumn("begin_ms", F.greatest(F.lit(0), F.coalesce(reach, F.lit(0))).cast("bigint"))
        .filter(F.col("start_ms") > F.col("begin_ms"))
        .select("media_id", F.col("begin_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    )
    bounded = gaps.join(media.select("media_id", "duration_ms"), "media_id", "right")
    nothing = F.col("start_ms").isNull()
    return bounded.select(
        "media_id",
        F.when(nothing, F.lit(0)).otherwise(F.col("start_ms")).cast("bigint").alias("start_ms"),
        F.when(nothing, F.col("duration_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
    ).filter(F.col("end_ms") > F.col("start_ms"))


def kept_clips(segments: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """By speakers where a media has labelled speech, else what the cuts leave."""
    labelled = segments.filter((F.col("type") == "speech") & F.col("speaker").isNotNull())
    spoken = turn_clips(same_speaker_ranges(labelled), media).select("media_id", "start_ms", "end_ms", "speaker")
    silent = media.join(labelled.select("media_id").distinct(), "media_id", "left_anti")
    plain = kept_ranges(cuts.join(silent.select("media_id"), "media_id", "left_semi"), silent)
    return spoken.unionByName(plain.withColumn("speaker", F.lit(None).cast("string")))


def timeline(kept: DataFrame, fps: int = 30) -> DataFrame:
    """Clips one after another in frames: source in and out, place in the output."""
    order = in_order("start_ms", "end_ms")
    cut = kept.withColumn("in_frame", frames(F.col("start_ms"), fps)).withColumn("out_frame", frames(F.col("end_ms"), fps))
    length = F.col("out_frame") - F.col("in_frame")
    start = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return cut.withColumn("clip_no", F.row_number().over(order).cast("bigint")).withColumn("out_start", start).withColumn("out_end", start + length)


def close_gaps(clips: DataFrame, tol_ms: int = 20) -> DataFrame:
    """Ripple: from the first gap over the tolerance on, each clip follows its predecessor at once.  For disjoint clips."""
    order = in_order("start_ms", "ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) > tol_ms, F.lit(False))
    marked = clips.withColumn("moves", F.max(gap).over(upto)).withColumn("length", F.col("end_ms") - F.col("start_ms"))
    anchor = F.max(F.when(~F.col("moves"), F.col("end_ms"))).over(upto)
    ran = F.sum(F.when(F.col("moves"), F.col("length")).otherwise(0)).over(upto)
    end = F.when(F.col("moves"), anchor + ran).otherwise(F.col("end_ms"))
    return marked.withColumn("new_end", end).select(
        "media_id", "ord", (F.col("new_end") - F.col("length")).alias("start_ms"), F.col("new_end").alias("end_ms")
    )


def numbered(segments: DataFrame, name: str = "number", keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Places from 1 by start, then by row."""
    return carried(segments, "sum", {name: F.lit(1).cast("bigint")}, F.col("start_ms"), ("ord",), keys=keys)


def speaker_labels(segments: DataFrame) -> DataFrame:
    """(media_id, speaker, first_ord, pos, label) by first appearance, pos from 0: Speaker A to Z, then numbers."""
    seen = segments.groupBy("media_id", "speaker").agg(F.min("ord").alias("first_ord"))
    placed = seen.withColumn("pos", F.row_number().over(in_order("first_ord", "speaker")) - 1)
    return placed.withColumn("label", label_of(F.col("pos")))


def visible_prefix(aligned: DataFrame) -> DataFrame:
    """Rows up to and including the first without a translation."""
    order = in_order("seg_no")
    missing = F.when(F.coalesce("translation", F.lit("")) == "", 1).otherwise(0)
    before = F.coalesce(F.sum(missing).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return aligned.withColumn("missing_before", before).filter(F.col("missing_before") == 0).withColumn("pending", missing == 1).drop("missing_before")


def word_gaps(words: DataFrame) -> DataFrame:
    """Time since the word before, from 45 to 900 ms."""
    gap = F.col("start_ms") - F.lag("start_ms").over(in_order("seg_no", "word_no"))
    return words.withColumn("gap_ms", F.greatest(F.lit(45), F.least(F.lit(900), F.coalesce(gap, F.lit(0)))).cast("bigint"))


def group_lines(words: DataFrame, sentences: int = 2, most_words: int = 28, force: bool = True) -> DataFrame:
    """Lines of a transcript: closed after so many sentences, or at so many words on a word that ends none.

    force gives what is left at the end as a last line.
    """
    marked = words.select("media_id", "seg_no", "word_no", F.regexp_like("word", F.lit(r"[.!?。？！]\s*$")).alias("hard"))

    def placed(state, rows):
        line, held, ends = state
        for seg_no, word_no, hard in rows:
            held, ends = held + 1, ends + bool(hard)
            closes = ends >= sentences if hard else held >= most_words
            yield seg_no, word_no, line, closes
            if closes:
                line, held, ends = line + 1, 0, 0

    out = fold_in_blocks(
        marked, ("seg_no", "word_no"), ("hard",), ("seg_no", "word_no", "hard"), [1, 0, 0], lambda rows: lines(rows, sentences, most_words),
        lambda state, summary: next_lines(state, summary, sentences), placed, "seg_no bigint, word_no bigint, line_no bigint, closes boolean",
    )
    if not force:
        whole = out.groupBy("media_id", "line_no").agg(F.max("closes").alias("closed")).filter("closed").drop("closed")
        out = out.join(whole.hint("merge"), ["media_id", "line_no"])
    return out.select("media_id", "seg_no", "word_no", "line_no")


def speaker_changes(turns: DataFrame) -> DataFrame:
    order = in_order("start_ms", "ord")
    before = F.lag("speaker").over(order)
    changed = F.col("from_speaker").isNotNull() & (F.col("from_speaker") != F.col("speaker"))
    return turns.withColumn("from_speaker", before).filter(changed).select(
        "media_id", F.col("start_ms").alias("at_ms"), "from_speaker", F.col("speaker").alias("to_speaker"))


def silence_runs(frames_: DataFrame, threshold_db: float = -30.0, min_ms: int = 500, frame_ms: int = 30) -> DataFrame:
    """Runs of level frames under the threshold, of a least length."""
    quiet = frames_.withColumn("quiet", F.col("level_db") < threshold_db)
    island = F.col("frame_no") - F.row_number().over(Window.partitionBy("media_id", "quiet").orderBy("frame_no"))
    runs = quiet.withColumn("island", island).filter("quiet").groupBy("media_id", "island").agg(
        (F.min("frame_no") * frame_ms).alias("start_ms"), ((F.max("frame_no") + 1) * frame_ms).alias("end_ms")
    )
    length = F.col("end_ms") - F.col("start_ms")
    return runs.filter(length >= min_ms).select("media_id", "start_ms", "end_ms", F.when(length < 400, "breath").otherwise("silence").alias("type"))


def batches(segments: DataFrame, size: int = 15) -> DataFrame:
    """Fixed-length batches in order, numbered from 0 in each media."""
    place = F.row_number().over(in_order("ord")) - 1
    return segments.withColumn("batch_no", div(place, size)).withColumn("in_batch", (place % size + 1).cast("bigint"))


def chunk_plan(media: DataFrame, chunk_ms: int = 600_000, overlap_ms: int = 5_000, from_ms: int = 0) -> DataFrame:
    """Chunks that begin each chunk_ms and reach overlap_ms into the next."""
    starts = F.sequence(F.lit(from_ms).cast("bigint"), F.col("duration_ms") - 1, F.lit(chunk_ms).cast("bigint"))
    planned = media.filter(F.col("duration_ms") > from_ms).select("media_id", "duration_ms", F.posexplode(starts).alias("chunk_no", "start_ms"))
    end = F.least(F.col("start_ms") + chunk_ms + overlap_ms, F.col("duration_ms"))
    return planned.select("media_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "start_ms", end.alias("end_ms"))


def window_tags(events: DataFrame, length: str = "605 seconds", step: str = "600 seconds") -> DataFrame:
    """Each event with every overlapping chunk it lies in."""
    return events.select("*", F.window("ts", length, step).alias("chunk"))
