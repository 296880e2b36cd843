"""Aggregations within a media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import bare_token
from cuelake.functions.timecode import div, frames


def cut_stats(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("media_id").agg(
        F.count("*").alias("n_cuts"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed_ms")
    )


def type_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(
        F.count_if(F.col("type") == "silence").alias("n_silence"), F.count_if(F.col("type") == "breath").alias("n_breath")
    )


def distinct_speakers(segments: DataFrame, exact: bool = True) -> DataFrame:
    count = F.count_distinct("speaker") if exact else F.approx_count_distinct("speaker")
    return segments.groupBy("media_id").agg(count.alias("n_speakers"))


def duration(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(F.coalesce(F.max("end_ms"), F.lit(1000)).cast("bigint").alias("duration_ms"))


def peaks(samples: DataFrame, n: int = 800) -> DataFrame:
    """Peak envelope of (media_id, chunk_no, samples): n buckets or fewer, scaled by the largest, to four digits.

    Each chunk is reduced to one peak for each bucket it touches before rows
    move, so the shuffle sees chunks times buckets at most, never samples.
    """
    sizes = samples.groupBy("media_id", "chunk_no").agg(F.sum(F.size("samples")).alias("size"))
    upto = Window.partitionBy("media_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("media_id")
    placed = sizes.withColumn("offset", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("total", F.sum("size").over(every))
    width = F.greatest(F.lit(1), div(F.col("total"), n))
    rows = samples.join(placed.hint("merge"), ["media_id", "chunk_no"]).withColumn("width", width)
    touched = F.sequence(div(F.col("offset"), F.col("width")), div(F.col("offset") + F.size("samples") - 1, F.col("width")))

    def peak(b):
        low = F.greatest(b * F.col("width") - F.col("offset"), F.lit(0)).cast("int")
        high = F.least((b + 1) * F.col("width") - F.col("offset"), F.size("samples")).cast("int")
        part = F.slice("samples", low + 1, high - low)
        return F.struct(b.alias("bucket"), F.array_max(F.transform(part, lambda s: F.abs(s.cast("int")))).alias("peak"))

    parts = rows.filter(F.size("samples") > 0).select("media_id", F.inline(F.transform(touched, peak)))
    by_bucket = parts.groupBy("media_id", "bucket").agg(F.max("peak").alias("peak"))
    most = F.greatest(F.lit(1), F.max("peak").over(every))
    return by_bucket.withColumn("most", most).filter(F.col("bucket") < n).select(
        "media_id", "bucket", F.round(F.col("peak") / F.col("most"), 4).alias("peak")
    )


def mean_probability(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.avg(F.coalesce("prob", F.lit(0.0))).alias("mean_prob"))


def top_share(items: DataFrame, item: str, least: int, *keys: str) -> DataFrame:
    """The share of the most frequent item of each group of at least so many."""
    counts = items.groupBy(*keys, item).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys).agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return sums.select(*keys, F.when(F.col("total") >= least, F.col("top") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def token_share(words: DataFrame, *keys: str) -> DataFrame:
    return top_share(words.withColumn("token", bare_token(F.col("word"))), "token", 5, *keys)


def pair_share(words: DataFrame, *keys: str) -> DataFrame:
    """As token_share, over neighbouring pairs, for groups of at least six tokens."""
    following = F.lead("token").over(Window.partitionBy(*keys).orderBy("word_no"))
    pairs = words.withColumn("token", bare_token(F.col("word"))).withColumn("next", following)
    return top_share(pairs.filter(F.col("next").isNotNull()).withColumn("pair", F.concat_ws(" ", "token", "next")), "pair", 5, *keys)


def frame_totals(kept: DataFrame, fps: int = 30) -> DataFrame:
    """Frames by rounded lengths, and by rounded ends; rounding may tell them apart."""
    return kept.groupBy("media_id").agg(
        F.sum(frames(F.col("end_ms") - F.col("start_ms"), fps)).alias("by_length"),
        F.sum(frames(F.col("end_ms"), fps) - frames(F.col("start_ms"), fps)).alias("by_ends"),
    )


def has_translation(translations: DataFrame) -> DataFrame:
    return translations.groupBy("media_id", "lang").agg(F.bool_or(F.coalesce("text", F.lit("")) != "").alias("has_any"))


def source_language(segments: DataFrame) -> DataFrame:
    """The language of the first speech row that has one."""
    tagged = segments.filter((F.col("type") == "speech") & (F.coalesce("language", F.lit("")) != ""))
    return tagged.groupBy("media_id").agg(F.min_by("language", "ord").alias("language"))


def _ordered_text(text: Column, order: Column, sep: str) -> Column:
    held = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(order.alias("o"), F.trim(text).alias("t")))))
    return F.array_join(F.transform(held, lambda x: x["t"]), sep)


def speaker_blocks(segments: DataFrame) -> DataFrame:
    """Texts of consecutive rows of one speaker, and of their translation where there is one."""
    listed = Window.partitionBy("media_id").orderBy("ord")
    before = F.lag("speaker").over(listed)
    opens = F.when(before.isNull() | (before != F.col("speaker")), 1).otherwise(0)
    blocks = segments.withColumn("block", F.sum(opens).over(listed.rowsBetween(Window.unboundedPreceding, 0)))
    said = [_ordered_text(F.col("text"), F.col("ord"), " ").alias("text")]
    if "translation" in segments.columns:
        said.append(_ordered_text(F.col("translation"), F.col("ord"), " ").alias("translation"))
    return blocks.groupBy("media_id", "block").agg(
        F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *said
    )


def paragraph(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(_ordered_text(F.col("text"), F.col("ord"), " ").alias("text"))


def wide_translations(translations: DataFrame, langs: list[str]) -> DataFrame:
    return translations.groupBy("media_id", "seg_no").pivot("lang", langs).agg(F.first("text"))


def track_gaps(clips: DataFrame, tol_ms: int = 20) -> DataFrame:
    before = F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "ord"))
    return clips.withColumn("away", F.abs(F.col("start_ms") - before) > tol_ms).groupBy("media_id").agg(
        F.count_if(F.coalesce("away", F.lit(False))).alias("n_gaps")
    )


def clip_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clips of each media before and after an edit."""
    states = before.select("media_id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select("media_id", F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    sums = states.groupBy("media_id").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return sums.withColumn("delta", F.col("n_after") - F.col("n_before"))


def progress(rows: DataFrame, chunk: str = "chunk_no") -> DataFrame:
    """Rows by chunk; on a stream this runs in update mode."""
    return rows.groupBy("media_id", chunk).agg(F.count("*").alias("n_rows"), F.max("end_ms").alias("upto_ms"))


def corpus_report(segments: DataFrame) -> DataFrame:
    """Totals over role and speaker, with subtotals."""
    return segments.rollup("role", "speaker").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms")
    )
