"""Joins on media_id with an interval or position condition.

Interval joins put both sides into time bins, so the join keys are (media_id,
bin) and a very long media spreads over many groups; a pair that shares several
bins is kept in the first only.  Bins are counted before a join, and dense ones
are cut into parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import LANGUAGES, draft_key, word_key
from cuelake.functions.timecode import div, overlap_ms
from cuelake.operators.scans import carried

BIN_MS = 600_000
#: A bin in which more rows begin is cut into parts, so that its rows spread over tasks and meet fewer of each other.
DENSE = 50_000
BROADCAST_ROWS = 200_000


def _as_struct(df: DataFrame, name: str) -> DataFrame:
    return df.select("media_id", F.struct(*df.columns).alias(name))


def dense_bins(starts: list[DataFrame], width: int) -> DataFrame | None:
    """(media_id, bin, part_ms) of the bins in which more than DENSE of the given (media_id, at) rows begin, to be cut into parts; None if there is none.

    A few such bins go to all tasks of the joins that follow, many are joined by shuffles.
    """
    rows = reduce(DataFrame.unionByName, starts).select("media_id", div(F.greatest("at", F.lit(0)), width).alias("bin"))
    parts = F.least(F.lit(width), F.ceil(F.count("*") / DENSE) * 4)
    found = rows.groupBy("media_id", "bin").agg(F.count("*").alias("n"), F.ceil(width / parts).cast("bigint").alias("part_ms")).filter(F.col("n") > DENSE).drop("n")
    few = found.limit(BROADCAST_ROWS + 1).collect()
    if not few:
        return None
    return F.broadcast(rows.sparkSession.createDataFrame(few, found.schema)) if len(few) <= BROADCAST_ROWS else found.hint("merge")


def _binned(df: DataFrame, start: Column, end: Column, width: int, dense: DataFrame | None) -> DataFrame:
    """Rows in each bin, and each part of a dense bin, that they touch.  end: the last millisecond of the row that counts."""
    low, high = F.greatest(start, F.lit(0)), F.greatest(end, start, F.lit(0))
    out = df.withColumn("bin", F.explode(F.sequence(div(low, width), div(high, width))))
    if dense is None:
        return out.withColumns({"part_ms": F.lit(width), "part": F.lit(0).cast("bigint")})
    begin = F.col("bin") * width
    met = out.join(dense, ["media_id", "bin"], "left").withColumn("part_ms", F.coalesce("part_ms", F.lit(width)))
    first, last = div(F.greatest(low - begin, F.lit(0)), F.col("part_ms")), div(F.least(high - begin, F.lit(width - 1)), F.col("part_ms"))
    return met.withColumn("part", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, how: str = "inner", bin_ms: int = BIN_MS) -> DataFrame:
    """(media_id, l, r): pairs of rows that share time; with how='left' rows of l without partner too."""
    ls, rs = _as_struct(left, "l"), _as_struct(right, "r")
    dense = dense_bins([df.select("media_id", F.col("start_ms").alias("at")) for df in (left, right)], bin_ms)
    lb = _binned(ls, F.col("l.start_ms"), F.col("l.end_ms") - 1, bin_ms, dense)
    rb = _binned(rs, F.col("r.start_ms"), F.col("r.end_ms") - 1, bin_ms, dense).drop("part_ms")
    # Of the parts that a pair shares, it is kept in that of the later start.
    later = F.greatest("l.start_ms", "r.start_ms", F.lit(0))
    both = lb.join(rb.hint("merge"), ["media_id", "bin", "part"]).filter(
        (F.col("bin") == div(later, bin_ms))
        & (F.col("part") == div(later - F.col("bin") * bin_ms, F.col("part_ms")))
        & (F.col("l.start_ms") < F.col("r.end_ms"))
        & (F.col("r.start_ms") < F.col("l.end_ms"))
    ).select("media_id", "l", "r")
    if how == "inner":
        return both
    hit = both.select(F.col("media_id").alias("m"), F.col("l.ord").alias("o")).distinct()
    rest = ls.join(hit.hint("merge"), (F.col("media_id") == F.col("m")) & (F.col("l.ord") == F.col("o")), "left_anti")
    return both.unionByName(rest, allowMissingColumns=True)


def point_pairs(points: DataFrame, at: str, intervals: DataFrame, start: Column, end: Column, bin_ms: int = BIN_MS) -> DataFrame:
    """(media_id, l, r): points with the intervals whose [start, end) they lie in.

    start and end are expressions over ``r``.
    """
    ls, rs = _as_struct(points, "l"), _as_struct(intervals, "r")
    dense = dense_bins([points.select("media_id", F.col(at).alias("at")), rs.select("media_id", start.alias("at"))], bin_ms)
    lb = _binned(ls, F.col(f"l.{at}"), F.col(f"l.{at}"), bin_ms, dense).drop("part_ms")
    rb = _binned(rs, start, end - 1, bin_ms, dense).drop("part_ms")
    return lb.join(rb.hint("merge"), ["media_id", "bin", "part"]).filter(
        (F.col(f"l.{at}") >= start) & (F.col(f"l.{at}") < end)
    ).select("media_id", "l", "r")


def _back_to(left: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    return left.join(found.hint("merge"), ["media_id", *keys], "left")


def assign_max_overlap(segments: DataFrame, diar: DataFrame) -> DataFrame:
    """speaker of the largest single overlap, the first listed on ties; UNKNOWN without one."""
    pairs = overlap_pairs(segments.select("media_id", "ord", "start_ms", "end_ms"), diar)
    shared = overlap_ms(*(F.col(c) for c in ("l.start_ms", "l.end_ms", "r.start_ms", "r.end_ms")))
    best = pairs.groupBy("media_id", F.col("l.ord").alias("ord")).agg(
        F.max(F.struct(shared.alias("n"), (-F.col("r.ord")).alias("o"), F.col("r.speaker").alias("speaker")))["speaker"].alias("found")
    )
    return _back_to(segments.drop("speaker"), best, "ord").withColumn("speaker", F.coalesce("found", F.lit("UNKNOWN"))).drop("found")


def assign_dominant(segments: DataFrame, diar: DataFrame) -> DataFrame:
    """speaker of the largest summed overlap, the first to overlap on ties; unchanged without one."""
    pairs = overlap_pairs(segments.select("media_id", "ord", "start_ms", "end_ms"), diar)
    sums = overlap_sums(pairs)
    best = sums.groupBy("media_id", "ord").agg(
        F.max(F.struct("shared_ms", (-F.col("first_ord")).alias("o"), "speaker"))["speaker"].alias("found")
    )
    old = F.col("speaker") if "speaker" in segments.columns else F.lit(None).cast("string")
    return _back_to(segments, best, "ord").withColumn("speaker", F.coalesce(F.col("found"), old)).drop("found")


def overlap_sums(pairs: DataFrame) -> DataFrame:
    """(media_id, ord, speaker): time shared, and the first row that shares it."""
    shared = overlap_ms(*(F.col(c) for c in ("l.start_ms", "l.end_ms", "r.start_ms", "r.end_ms")))
    return pairs.groupBy("media_id", F.col("l.ord").alias("ord"), F.col("r.speaker").alias("speaker")).agg(
        F.sum(shared).alias("shared_ms"), F.min("r.ord").alias("first_ord")
    )


def match_by_start(segments: DataFrame, updates: DataFrame, within_ms: int = 500) -> DataFrame:
    """For each update the first segment in order that starts within the distance; matched_ord is null without one."""
    near = point_pairs(
        updates.select("media_id", "ord", "start_ms"),
        "start_ms",
        segments.select("media_id", "ord", "start_ms"),
        F.col("r.start_ms") - within_ms + 1,
        F.col("r.start_ms") + within_ms,
    )
    first = near.groupBy("media_id", F.col("l.ord").alias("ord")).agg(F.min("r.ord").alias("matched_ord"))
    return _back_to(updates, first, "ord")


def clip_speaker(kept: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """The speaker of the first speech at the middle of each clip, else the media's first speaker."""
    mid = kept.withColumn("mid_ms", div(F.col("start_ms") + F.col("end_ms"), 2))
    hits = point_pairs(mid.select("media_id", "start_ms", "mid_ms"), "mid_ms", segments.select("media_id", "ord", "start_ms", "end_ms", "speaker"), F.col("r.start_ms"), F.col("r.end_ms"))
    first = hits.groupBy("media_id", F.col("l.start_ms").alias("start_ms")).agg(F.min_by("r.speaker", "r.ord").alias("found"))
    default = speakers.filter(F.col("pos") == 0).select("media_id", F.col("speaker").alias("default_speaker"))
    out = _back_to(kept.drop("speaker"), first, "start_ms").join(default.hint("merge"), "media_id", "left")
    return out.withColumn("speaker", F.coalesce("found", "default_speaker")).drop("found", "default_speaker")


def clip_name(clips: DataFrame, ranges: DataFrame, slack_ms: int = 150) -> DataFrame:
    """The first range around the middle of each clip, with slack; null without one."""
    mid = clips.select("media_id", "ord", div(F.col("start_ms") + F.col("end_ms"), 2).alias("mid_ms"))
    hits = point_pairs(mid, "mid_ms", ranges.select("media_id", "ord", "start_ms", "end_ms", "name"), F.col("r.start_ms") - slack_ms, F.col("r.end_ms") + slack_ms)
    first = hits.groupBy("media_id", F.col("l.ord").alias("ord")).agg(F.min_by("r.name", "r.ord").alias("name"))
    return _back_to(clips, first, "ord")


def bucket_segment(segments: DataFrame, media: DataFrame, n: int = 50) -> DataFrame:
    """For n equal buckets, the first listed segment that ends after the bucket's start, if it has begun."""
    buckets = media.select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket")).withColumn(
        "t", div(F.col("bucket") * F.col("duration_ms"), n)
    )
    # The least ord among segments that end after t: ends and times in one order, latest first.
    rows = buckets.select("media_id", "t", "bucket", F.lit(1).alias("is_time"), F.lit(None).cast("bigint").alias("ord")).unionByName(
        segments.select("media_id", F.col("end_ms").alias("t"), F.lit(None).cast("int").alias("bucket"), F.lit(0).alias("is_time"), "ord")
    )
    # A segment that ends at t has not ended after it: at equal t, times come before ends.
    first = carried(rows, "min", {"least": F.col("ord")}, F.col("t"), ("is_time",), descending=True).filter("is_time = 1")
    first = first.select("media_id", "bucket", "t", F.col("least").alias("ord"))
    began = segments.select("media_id", "ord", "start_ms")
    return first.join(began.hint("merge"), ["media_id", "ord"], "left").select(
        "media_id", F.col("bucket").cast("bigint").alias("bucket"), F.when(F.col("start_ms") <= F.col("t"), F.col("ord")).alias("ord")
    )


def segment_at(times: DataFrame, segments: DataFrame, open_ms: int = 30_000) -> DataFrame:
    """For each time the first listed segment around it, else the last one started before."""
    ended = segments.withColumn("end_ms", F.coalesce("end_ms", F.col("start_ms") + open_ms))
    inside = point_pairs(times, "t", ended.select("media_id", "ord", "start_ms", "end_ms"), F.col("r.start_ms"), F.col("r.end_ms"))
    within = inside.groupBy("media_id", F.col("l.t").alias("t")).agg(F.min("r.ord").alias("inside"))
    rows = times.select("media_id", "t", F.lit(1).alias("is_time"), F.lit(None).cast("bigint").alias("ord")).unionByName(
        ended.select("media_id", F.col("start_ms").alias("t"), F.lit(0).alias("is_time"), "ord")
    )
    begun = carried(rows, "last", {"begun": F.col("ord")}, F.col("t"), ("is_time", "ord")).filter("is_time = 1").select("media_id", "t", "begun")
    return _back_to(begun, within, "t").select("media_id", "t", F.coalesce("inside", "begun").alias("ord"))


def skip_map(times: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """Where playback jumps to from a time inside a cut; null outside."""
    hits = point_pairs(times, "t", cuts.select("media_id", "ord", "start_ms", "end_ms"), F.col("r.start_ms") - 20, F.col("r.end_ms") - 50)
    first = hits.groupBy("media_id", F.col("l.t").alias("t")).agg(F.min_by("r.end_ms", "r.ord").alias("cut_end"))
    return _back_to(times, first, "t").join(media.select("media_id", "duration_ms").hint("merge"), "media_id").select(
        "media_id", "t", F.when(F.col("cut_end").isNotNull(), F.least(F.col("cut_end") + 10, F.col("duration_ms"))).alias("jump_to")
    )


def not_fully_cut(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments that no single cut covers."""
    hits = point_pairs(segments.select("media_id", "ord", "start_ms", "end_ms"), "start_ms", cuts.select("media_id", "start_ms", "end_ms"), F.col("r.start_ms"), F.col("r.end_ms") + 1)
    gone = hits.filter(F.col("r.end_ms") >= F.col("l.end_ms")).select("media_id", F.col("l.ord").alias("ord")).distinct()
    return segments.join(gone.hint("merge"), ["media_id", "ord"], "left_anti")


def cut_events(cuts: DataFrame) -> DataFrame:
    """(media_id, t, opens, offset) of each start and end of a cut.

    With n and s the sums of opens and offset up to a time t, the cut time before t is t * n + s.
    """
    start = F.struct(F.col("start_ms").alias("t"), F.lit(1).cast("bigint").alias("opens"), (-F.col("start_ms")).alias("offset"))
    end = F.struct(F.col("end_ms").alias("t"), F.lit(-1).cast("bigint").alias("opens"), F.col("end_ms").alias("offset"))
    return cuts.select("media_id", F.inline(F.array(start, end)))


def removed_before(times: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut time that lies before each time; overlapping cuts count each."""
    none = F.lit(0).cast("bigint")
    rows = times.select("media_id", "t", none.alias("opens"), none.alias("offset"), F.lit(True).alias("asks")).distinct()
    rows = rows.unionByName(cut_events(cuts).withColumn("asks", F.lit(False)))
    both = carried(rows, "sum", {"n": F.col("opens"), "s": F.col("offset")}, F.col("t")).filter("asks")
    return both.select("media_id", "t", (F.col("t") * F.col("n") + F.col("s")).alias("removed_ms"))


def without_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with new_start and new_end: their times less the cut time before them."""
    none, event = F.lit(0).cast("bigint"), F.col("__event")
    asked = rows.withColumns({"__a": F.col("start_ms"), "__b": F.col("end_ms"), "__opens": none, "__offset": none, "__event": F.lit(False)})
    events = cut_events(cuts).select("media_id", F.col("t").alias("__a"), F.col("t").alias("__b"), F.col("opens").alias("__opens"), F.col("offset").alias("__offset"), F.lit(True).alias("__event"))
    both = asked.unionByName(events, allowMissingColumns=True)
    for edge, n, s in (("__a", "__n_a", "__s_a"), ("__b", "__n_b", "__s_b")):
        both = carried(both, "sum", {n: F.col("__opens"), s: F.col("__offset")}, F.col(edge))
    return both.filter(~event).withColumns({
        "new_start": F.col("__a") - F.col("__a") * F.col("__n_a") - F.col("__s_a"), "new_end": F.col("__b") - F.col("__b") * F.col("__n_b") - F.col("__s_b")
    }).drop("__a", "__b", "__opens", "__offset", "__event", "__n_a", "__s_a", "__n_b", "__s_b")


def silent_clips(clips: DataFrame, regions: DataFrame, tol_ms: int = 200) -> DataFrame:
    """Clips that match a region at both edges, or lie in one widened by the tolerance."""
    wide = regions.select("media_id", (F.col("start_ms") - tol_ms).alias("start_ms"), (F.col("end_ms") + tol_ms).alias("end_ms"))
    hits = point_pairs(clips.select("media_id", "ord", "start_ms", "end_ms"), "start_ms", wide, F.col("r.start_ms"), F.col("r.end_ms") + 1)
    found = hits.filter(F.col("l.end_ms") <= F.col("r.end_ms")).select("media_id", F.col("l.ord").alias("ord")).distinct()
    return clips.join(found.hint("merge"), ["media_id", "ord"], "left_semi")


def apply_labels(segments: DataFrame, speakers: DataFrame, renames: DataFrame) -> DataFrame:
    """speaker_label from renames, else from speakers, else Unknown; blank renames count as none."""
    named = renames.select("media_id", "speaker", F.when(F.trim("label") != "", F.trim("label")).alias("renamed"))
    both = speakers.select("media_id", "speaker", "label").join(named, ["media_id", "speaker"], "full")
    return segments.join(both, ["media_id", "speaker"], "left").withColumn(
        "speaker_label", F.coalesce("renamed", "label", F.lit("Unknown"))
    ).drop("renamed", "label")


def languages(spark) -> DataFrame:
    """The fixed dimension of languages."""
    return spark.createDataFrame(list(LANGUAGES), "lang string, lang_name string, model_code string")


def language_names(df: DataFrame, source: str = "source_lang", target: str = "lang") -> DataFrame:
    """target_name, target_code, source_name and source_code; the dimension has a fixed few rows."""
    dim = languages(df.sparkSession)
    t = F.broadcast(dim.select(F.col("lang").alias(target), F.col("lang_name"), F.col("model_code")))
    s = F.broadcast(dim.select(F.col("lang").alias(source), F.col("lang_name").alias("source_lang_name"), F.col("model_code").alias("source_model")))
    auto = F.when(F.col(target) == "vi", "eng_Latn").otherwise("vie_Latn")
    return (
        df.join(t, target, "left")
        .join(s, source, "left")
        .withColumn("target_name", F.coalesce("lang_name", F.col(target)))
        .withColumn("source_name", F.coalesce("source_lang_name", F.col(source)))
        .withColumn("target_code", F.coalesce("model_code", F.lit("eng_Latn")))
        .withColumn("source_code", F.when(F.col(source) == "auto", auto).otherwise(F.coalesce("source_model", F.lit("eng_Latn"))))
        .drop("lang_name", "model_code", "source_model", "source_lang_name")
    )


def align(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with their translation by number; missing is empty."""
    side = translations.select("media_id", "seg_no", "lang", F.col("text").alias("translation"))
    return segments.join(side, ["media_id", "seg_no"], "left").withColumn("translation", F.coalesce("translation", F.lit("")))


def reuse_drafts(finals: DataFrame, drafts: DataFrame) -> DataFrame:
    """Finals with the translation cached for a draft of the same text; null without one.

    Of drafts with one text the earliest counts, as in a stream; without event_ts the least translation.
    """
    key = ["session_id", "index", "lang", "text_key"]
    cached = (
        drafts.filter(F.coalesce("cached", F.lit("")) != "")
        .withColumn("text_key", draft_key(F.col("text")))
        .groupBy(*key)
        .agg(F.min_by("cached", "event_ts" if "event_ts" in drafts.columns else "cached").alias("reused"))
    )
    return finals.withColumn("text_key", draft_key(F.col("text"))).join(cached, key, "left").drop("text_key")


def untranslated(segments: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """Every (segment, language) without a non-empty translation."""
    wanted = segments.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    done = translations.filter(F.coalesce("text", F.lit("")) != "").select("media_id", "seg_no", "lang")
    return wanted.join(done.hint("merge"), ["media_id", "seg_no", "lang"], "left_anti")


def track_drift(video: DataFrame, audio: DataFrame, clips: int = 4) -> DataFrame:
    """The largest start difference of the first clips of two tracks."""
    def first(df, name):
        place = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "ord"))
        return df.withColumn("clip_no", place).filter(F.col("clip_no") <= clips).select("media_id", "clip_no", F.col("start_ms").alias(name))

    both = first(video, "video_ms").join(first(audio, "audio_ms"), ["media_id", "clip_no"])
    return both.groupBy("media_id").agg(F.max(F.abs(F.col("video_ms") - F.col("audio_ms"))).alias("drift_ms"))


def active_speakers(slices: DataFrame, diar: DataFrame) -> DataFrame:
    """How many rows speak in each slice: those that started before its end less those that ended by its start."""
    asked = slices.select("media_id", F.col("end_ms").alias("a"), F.col("start_ms").alias("b"), F.lit(1).alias("asks"))
    rows = asked.unionByName(diar.select("media_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.lit(0).alias("asks")))
    one = (1 - F.col("asks")).cast("bigint")
    # At equal times a slice's end comes before starts, and its start after ends.
    started = carried(rows.withColumn("order", -F.col("asks")), "sum", {"started": one}, F.col("a"), ("order",))
    both = carried(started, "sum", {"ended": one}, F.col("b"), ("asks",)).filter("asks = 1 AND started > ended")
    return both.select("media_id", F.col("b").alias("start_ms"), F.col("a").alias("end_ms"), (F.col("started") - F.col("ended")).alias("active"))


def agreement(hypotheses: DataFrame, within_ms: int = 500) -> DataFrame:
    """How many words at the head of each hypothesis equal the one before, in text and about in time."""
    before = F.lag("words").over(Window.partitionBy("session_id").orderBy("cycle"))
    both = hypotheses.withColumn("before", before)
    same = F.zip_with(
        "words",
        "before",
        lambda a, b: (word_key(a["word"]) == word_key(b["word"])) & (F.abs(a["start_ms"] - b["start_ms"]) <= within_ms),
    )
    first_bad = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    agreed = F.when(F.col("before").isNull(), 0).when(first_bad > 0, first_bad - 1).otherwise(F.size("words"))
    return both.select("session_id", "cycle", agreed.cast("bigint").alias("agreed"))


def palette(speakers: DataFrame, colours: tuple[str, ...], cameras: int = 6) -> DataFrame:
    """A colour and a camera for each speaker by position."""
    return speakers.withColumn(
        "colour", F.element_at(F.array(*[F.lit(c) for c in colours]), (F.col("pos") % len(colours) + 1).cast("int"))
    ).withColumn("camera", (F.col("pos") % cameras + 1).cast("bigint"))


def upsert_translations(translations: DataFrame, patch: DataFrame, mode: str = "partial") -> DataFrame:
    """Patched translations: partial ones replace only where they are non-empty, final ones always."""
    key = ["media_id", "seg_no", "lang"]
    new = patch.select(*key, F.col("text").alias("new_text"))
    used = F.nullif(F.col("new_text"), F.lit("")) if mode == "partial" else F.col("new_text")
    both = translations.select(*key, "text").join(new, key, "full")
    return both.select(*key, F.coalesce(used, F.col("text"), F.lit("")).alias("text"))


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    changes = edits.select("media_id", "ord", F.trim("text").alias("edited"))
    return segments.join(changes, ["media_id", "ord"], "left").withColumn("text", F.coalesce("edited", "text")).drop("edited")
