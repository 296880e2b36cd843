"""Set operations, order and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_start(segments: DataFrame) -> DataFrame:
    """Order within partitions of whole media; a global order is the sink's to ask for."""
    return segments.repartition("media_id").sortWithinPartitions("media_id", "start_ms", "ord")


def end_first(cuts: DataFrame) -> DataFrame:
    """Cuts numbered from the last, the order in which they can be removed without moving others."""
    return cuts.withColumn("step", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("start_ms"), F.desc("ord"))).cast("bigint"))


def display_order(segments: DataFrame, running: bool) -> DataFrame:
    """Newest first while a session runs, else by time."""
    key = F.desc("start_ms") if running else F.asc("start_ms")
    return segments.withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy(key, "ord")).cast("bigint"))


def first_rows(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def last_characters(segments: DataFrame, n: int = 200) -> DataFrame:
    """The tail of each media's text, as context for what follows.

    Only rows that reach into the last n characters, if only with the space after them, are put together.
    """
    later = Window.partitionBy("media_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(F.length("text") + 1).over(later), F.lit(0))
    near = segments.withColumn("after", after).filter(F.col("after") <= n)
    held = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return near.groupBy("media_id").agg(F.right(F.array_join(F.transform(held, lambda x: x["text"]), " "), F.lit(n)).alias("context"))


def merge_transcript(old: DataFrame, new: DataFrame, resume_ms: Column | None = None) -> DataFrame:
    """New speech with the old rows that are not speech and, on a resumed run, the speech before the resume point."""
    kept = F.col("type") != "speech"
    if resume_ms is not None:
        kept = kept | (F.col("end_ms") <= resume_ms + 500)
    return old.filter(kept).unionByName(new, allowMissingColumns=True)


def replace_silence(segments: DataFrame, silence: DataFrame) -> DataFrame:
    return segments.filter(F.col("type") == "speech").unionByName(silence, allowMissingColumns=True)


def with_sessions(earlier: DataFrame, finals: DataFrame) -> DataFrame:
    """Rows of an earlier session before those of this one."""
    return earlier.withColumn("prev", F.lit(True)).unionByName(finals.withColumn("prev", F.lit(False)))


def boundaries(intervals: DataFrame) -> DataFrame:
    return intervals.select("media_id", F.explode(F.array("start_ms", "end_ms")).alias("t")).distinct()


def distinct_in_order(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Distinct values with the place of the first."""
    return df.groupBy(*keys, value).agg(F.min("ord").alias("first_ord"))


def languages_left(all_langs: DataFrame, taken: DataFrame) -> DataFrame:
    """Languages that are neither the source nor chosen already."""
    return all_langs.select("lang").join(taken.select("lang").distinct(), "lang", "left_anti")
