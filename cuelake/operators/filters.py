"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.timecode import frames, ticks

BREATH_BELOW_MS = 400


def to_public(segments: DataFrame) -> DataFrame:
    """The outward shape: speech rows without words and scores."""
    keep = [c for c in ("media_id", "ord", "start_ms", "end_ms", "text", "language") if c in segments.columns]
    return segments.select(*keep, F.lit("speech").alias("type"))


def by_type(segments: DataFrame, kind: str) -> DataFrame:
    return segments if kind == "all" else segments.filter(F.col("type") == kind)


def speech_nonblank(segments: DataFrame) -> DataFrame:
    """Speech with something to export."""
    return segments.filter((F.col("type") == "speech") & (F.trim("text") != ""))


def speech_nonempty(segments: DataFrame) -> DataFrame:
    """Speech with any text, white space too, as translation takes it."""
    return segments.filter((F.col("type") == "speech") & (F.col("text") != ""))


def confident(raw: DataFrame, mode: str = "speech") -> DataFrame:
    """Decoder rows by their scores; null scores count as 0."""
    bounds = {"speech": (0.6, -1.0), "song": (0.8, -1.5), "live": (0.55, -1.0)}
    if mode == "none":
        return raw
    silent, likely = bounds[mode]
    return raw.filter(
        (F.coalesce("no_speech_prob", F.lit(0.0)) <= silent) & (F.coalesce("avg_logprob", F.lit(0.0)) >= likely)
    )


def drop_blank(segments: DataFrame) -> DataFrame:
    """Rows with blank text go, and blank words of those that stay."""
    out = segments.filter(F.trim("text") != "")
    if "words" in out.columns:
        out = out.withColumn("words", F.filter("words", lambda w: F.trim(w["word"]) != ""))
    return out


def offset(segments: DataFrame, by: Column) -> DataFrame:
    """Move relative times, nested words too."""
    out = segments.withColumn("start_ms", F.col("start_ms") + by).withColumn("end_ms", F.col("end_ms") + by)
    if "words" in out.columns:
        moved = F.transform(
            "words",
            lambda w: w.withField("start_ms", w["start_ms"] + by).withField("end_ms", w["end_ms"] + by),
        )
        out = out.withColumn("words", moved)
    return out


def silence_class(start: Column, end: Column) -> Column:
    return F.when(end - start < BREATH_BELOW_MS, "breath").otherwise("silence")


def cut_points(segments: DataFrame, pad_before: int = 100, pad_after: int = 100, min_silence: int = 500) -> DataFrame:
    """Silences and breaths of a least length, shortened by padding, that are not empty then."""
    long_enough = (F.col("type") != "speech") & (F.col("end_ms") - F.col("start_ms") >= min_silence)
    return (
        segments.filter(long_enough)
        .withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") + pad_before).cast("bigint"))
        .withColumn("end_ms", F.col("end_ms") - pad_after)
        .filter(F.col("end_ms") > F.col("start_ms"))
    )


def drop_subframe(cuts: DataFrame, fps: int = 30) -> DataFrame:
    """Cuts in whole frames, those under one frame gone."""
    return (
        cuts.withColumn("start_frame", frames(F.col("start_ms"), fps))
        .withColumn("end_frame", frames(F.col("end_ms"), fps))
        .filter(F.col("end_frame") - F.col("start_frame") >= 1)
    )


def resume_keep(segments: DataFrame, from_ms: Column) -> DataFrame:
    """Speech that a resumed run need not make again."""
    return segments.filter((F.col("type") == "speech") & (F.col("end_ms") <= from_ms + 500))


def with_duration(media: DataFrame) -> DataFrame:
    return media.filter(F.col("duration_ms") > 0)


def without_language(translations: DataFrame, lang: str) -> DataFrame:
    return translations.filter(F.col("lang") != lang)


def export_flags(segments: DataFrame) -> DataFrame:
    """For each media, whether there is anything to cut and anything said."""
    return segments.groupBy("media_id").agg(
        F.bool_or(F.col("type") != "speech").alias("has_cuts"),
        F.bool_or((F.col("type") == "speech") & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("has_speech"),
    )


def markers(cuts: DataFrame) -> DataFrame:
    return cuts.select(
        "media_id",
        "ord",
        F.when(F.col("type") == "breath", "Breath").otherwise("Silence").alias("name"),
        ticks(F.col("start_ms")).alias("start_ticks"),
        ticks(F.col("end_ms") - F.col("start_ms")).alias("length_ticks"),
    )
