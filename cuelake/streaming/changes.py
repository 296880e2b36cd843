"""Late rows kept apart, and drafts that supersede each other as changes.

Both write by batch number, so a batch that is repeated replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.streaming.live import long_enough, session_fold

CHANGED = "session_id bigint, index bigint, lang string, text string, cycle bigint, retracted boolean"
DRAFT_KEY = ("session_id", "index", "lang")


def apart_from_late(call: Callable[[DataFrame, int], None], side: str, late_ms: int = 10_000, at: str = "event_ts") -> Callable[[DataFrame, int], None]:
    """A call for ``on_batches`` that passes on rows in time and writes late ones to ``side``.

    The watermark of a batch is the latest time in the batches before it, less
    late_ms; a row before it is late.  Two marks are kept, of this batch and the
    one before, so a repeated batch finds the same one.
    """

    def split(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = _mark(spark, f"{side}/marks/slot={(batch_id - 1) % 2}", batch_id - 1) if batch_id else None
        millis = F.unix_millis(F.col(at))
        latest = rows.agg(F.max(millis)).first()[0]
        marks = [m for m in (before, None if latest is None else latest - late_ms) if m is not None]
        kept = spark.createDataFrame([(batch_id, max(marks) if marks else None)], "batch_id bigint, mark bigint")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{side}/marks/slot={batch_id % 2}")
        if before is None:
            return call(rows, batch_id)
        is_late = F.coalesce(millis < before, F.lit(False))
        rows.filter(is_late).withColumn("watermark_ms", F.lit(before)).write.mode("overwrite").parquet(f"{side}/rows/batch_id={batch_id}")
        call(rows.filter(~is_late), batch_id)

    return split


def _mark(spark: SparkSession, path: str, batch_id: int) -> int | None:
    found = spark.read.schema("batch_id bigint, mark bigint").parquet(path).filter(F.col("batch_id") == batch_id).first()
    if found is None:
        raise RuntimeError(f"no mark of batch {batch_id} in {path}")
    return found["mark"]


def late_rows_kept(spark: SparkSession, side: str, schema: str) -> DataFrame:
    """The late rows of all batches, with the watermark that they missed."""
    return spark.read.schema(f"{schema}, watermark_ms bigint, batch_id bigint").parquet(f"{side}/rows")


def _supersede(key: tuple, rows: pd.DataFrame, held: dict) -> list[tuple]:
    out = []
    for text, cycle in zip(rows["text"].tolist(), rows["cycle"].tolist()):
        if held.get("cycle", -1) >= cycle:
            continue
        if held.get("text") != text:
            if "text" in held:
                out.append((*key, held["text"], held["cycle"], True))
            out.append((*key, text, cycle, False))
            held["text"] = text
            held["cycle"] = cycle
    return out


def draft_changes(drafts: DataFrame, least_words: int = 4) -> DataFrame:
    """CHANGED rows of a stream of drafts: each new text of a line and language, after a retraction of the one it supersedes."""
    return session_fold(long_enough(drafts, least_words).select(*DRAFT_KEY, "text", "cycle"), DRAFT_KEY, "cycle", _supersede, CHANGED, "text string, cycle bigint")


def settled(changes: DataFrame) -> DataFrame:
    """The drafts that stand after all changes: those that were given and not retracted."""
    signed = changes.withColumn("sign", F.when(F.col("retracted"), -1).otherwise(1))
    stands = signed.groupBy(*DRAFT_KEY, "text", "cycle").agg(F.sum("sign").alias("n")).filter(F.col("n") > 0)
    return stands.groupBy(*DRAFT_KEY).agg(F.max_by("text", "cycle").alias("text"))


def upserts(path: str) -> Callable[[DataFrame, int], None]:
    """A call for ``on_batches`` that adds each batch's changes to a table of changes; ``table_of`` reads what stands."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def table_of(spark: SparkSession, path: str) -> DataFrame:
    return settled(spark.read.schema(f"{CHANGED}, batch_id bigint").parquet(path))
