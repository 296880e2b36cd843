"""Timed tables derived from the given ones, and the same in SQL.

A conversation is a media, a turn a segment: 1 s plus 15 ms a character long,
after a gap that its numbers give.  Silences are the gaps; raw speaker turns
are the segments with stretched edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"),
        F.col("turn").alias("ord"),
        "role",
        "text",
        (F.length("text") * 15 + 1000).cast("bigint").alias("dur_ms"),
        ((F.col("turn") * 137 + F.col("conv_id") * 61) % 1500).cast("bigint").alias("gap_ms"),
    )
    before = Window.partitionBy("media_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0)) + F.col("gap_ms")
    return base.withColumn("start_ms", start.cast("bigint")).select(
        "media_id",
        "ord",
        F.col("ord").alias("seg_no"),
        "role",
        "text",
        F.lit("speech").alias("type"),
        F.when(F.col("ord") % 3 == 1, F.lit(None)).otherwise(F.when(F.col("media_id") % 2 == 0, "en").otherwise("fr")).alias("language"),
        F.concat(F.lit("SPEAKER_0"), (F.floor(F.col("ord") / 2).cast("bigint") % 2).cast("string")).alias("speaker"),
        "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        "gap_ms",
    )


def silence(segs: DataFrame) -> DataFrame:
    return segs.filter("gap_ms > 0").select(
        "media_id",
        "ord",
        (F.col("start_ms") - F.col("gap_ms")).alias("start_ms"),
        F.col("start_ms").alias("end_ms"),
        F.when(F.col("gap_ms") < 400, "breath").otherwise("silence").alias("type"),
    )


def diar(segs: DataFrame) -> DataFrame:
    return segs.select(
        "media_id",
        "ord",
        "speaker",
        F.greatest(F.lit(0), F.col("start_ms") - 400 * (F.col("ord") % 2)).cast("bigint").alias("start_ms"),
        (F.col("end_ms") + F.when((F.col("ord") + F.col("media_id")) % 3 == 0, 700).otherwise(0)).alias("end_ms"),
    )


def media(segs: DataFrame) -> DataFrame:
    return segs.groupBy("media_id").agg((F.max("end_ms") + 500).cast("bigint").alias("duration_ms"))


def everything(segs: DataFrame) -> DataFrame:
    """Speech and silence in one table, silences numbered from 1000."""
    quiet = silence(segs).withColumn("ord", F.col("ord") + 1000)
    return segs.select("media_id", "ord", "start_ms", "end_ms", "type", "text", "language", "speaker").unionByName(quiet, allowMissingColumns=True)


def words(segs: DataFrame) -> DataFrame:
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = segs.withColumn("n", F.size(parts)).select("*", F.posexplode(parts).alias("word_no", "word"))
    return rows.select(
        "media_id",
        "seg_no",
        F.col("word_no").cast("bigint").alias("word_no"),
        "word",
        (F.col("start_ms") + F.floor(F.col("word_no") * (F.col("end_ms") - F.col("start_ms")) / F.col("n"))).cast("bigint").alias("start_ms"),
        (((F.col("media_id") * 31 + F.col("seg_no") * 17 + F.col("word_no") * 7) % 100).cast("double") / 100).alias("prob"),
    )


def translations(segs: DataFrame) -> DataFrame:
    """Bracketed texts, missing for a fifth of rows and empty for a seventh, and lower-cased ones for all."""
    mark = F.col("seg_no") + F.col("media_id")
    upper = segs.filter(mark % 5 != 0).select(
        "media_id", "seg_no", F.lit("xx").alias("lang"), F.when(mark % 7 == 0, "").otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("text")
    )
    return upper.unionByName(segs.select("media_id", "seg_no", F.lit("yy").alias("lang"), F.lower("text").alias("text")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as PCM: media by label, chunk by id."""
    from cuelake.functions.timecode import pcm_encode

    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("media_id"), F.col("vec_id").alias("chunk_no"), pcm_encode(F.col("embedding")).alias("samples")
    )


def chunked(rows: DataFrame, media_: DataFrame, overlap_ms: int) -> DataFrame:
    """Rows repeated in each planned chunk (60 s here) that they touch."""
    from cuelake.operators.joins import overlap_pairs
    from cuelake.operators.windows import chunk_plan

    plan = chunk_plan(media_, 60_000, overlap_ms)
    pairs = overlap_pairs(plan, rows)
    return pairs.select(
        "media_id", F.col("l.chunk_no").alias("chunk_no"),
        *[F.col(f"r.{c}").alias(c) for c in rows.columns if c not in ("media_id", "start_ms", "end_ms")],
        F.greatest("l.start_ms", "r.start_ms").alias("start_ms"), F.least("l.end_ms", "r.end_ms").alias("end_ms"),
    )


CTE = r"""
WITH base AS (
  SELECT conv_id AS media_id, turn AS seg_no, role, text,
         CAST(1000 + 15*length(text) AS BIGINT) AS dur_ms,
         CAST((turn*137 + conv_id*61) % 1500 AS BIGINT) AS gap_ms FROM conversations),
segments AS (
  SELECT media_id, seg_no AS ord, seg_no, role, text, 'speech' AS type,
         CASE WHEN seg_no % 3 = 1 THEN NULL WHEN media_id % 2 = 0 THEN 'en' ELSE 'fr' END AS language,
         concat('SPEAKER_0', CAST(CAST(floor(seg_no/2) AS BIGINT) % 2 AS VARCHAR)) AS speaker,
         start_ms, start_ms + dur_ms AS end_ms, gap_ms
  FROM (SELECT *, CAST(coalesce(sum(dur_ms+gap_ms) OVER (PARTITION BY media_id ORDER BY seg_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) + gap_ms AS BIGINT) AS start_ms FROM base) b),
silence AS (
  SELECT media_id, ord, start_ms - gap_ms AS start_ms, start_ms AS end_ms,
         CASE WHEN gap_ms < 400 THEN 'breath' ELSE 'silence' END AS type FROM segments WHERE gap_ms > 0),
diar AS (
  SELECT media_id, ord, speaker, greatest(CAST(0 AS BIGINT), start_ms - 400*(ord % 2)) AS start_ms,
         end_ms + CASE WHEN (ord + media_id) % 3 = 0 THEN 700 ELSE 0 END AS end_ms FROM segments),
media AS (SELECT media_id, CAST(max(end_ms) + 500 AS BIGINT) AS duration_ms FROM segments GROUP BY media_id),
everything AS (
  SELECT media_id, ord, start_ms, end_ms, type, text, language, speaker FROM segments
  UNION ALL SELECT media_id, ord + 1000, start_ms, end_ms, type, NULL, NULL, NULL FROM silence),
cuts AS (
  SELECT media_id, ord, greatest(CAST(0 AS BIGINT), start_ms + 100) AS start_ms, end_ms - 100 AS end_ms, type
  FROM silence WHERE end_ms - start_ms >= 500 AND end_ms - 100 > greatest(0, start_ms + 100)),
word_lists AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM segments),
words AS (
  SELECT media_id, seg_no, CAST(pos AS BIGINT) AS word_no, w AS word,
         start_ms + CAST(floor(pos*(end_ms-start_ms)/n) AS BIGINT) AS start_ms,
         CAST((media_id*31+seg_no*17+pos*7) % 100 AS DOUBLE)/100 AS prob
  FROM (SELECT *, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws,1)-1 AS pos FROM word_lists)),
translations AS (
  SELECT media_id, seg_no, 'xx' AS lang, CASE WHEN (seg_no + media_id) % 7 = 0 THEN '' ELSE concat('[', text, ']') END AS text
  FROM segments WHERE (seg_no + media_id) % 5 <> 0
  UNION ALL SELECT media_id, seg_no, 'yy', lower(text) FROM segments)
"""
