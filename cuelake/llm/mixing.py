"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight (its share of the whole mix) and a schedule (how its
rate rises or falls over training time, 0 to 1).  The integral of the schedule,
scaled to the source's target, is the number of its words wanted up to a time;
inverting it at a document's cumulative word offset gives the document's place
in training.  Documents are then range-sorted by that place.

Everything is a DataFrame expression.  Offsets inside a source come from two
levels of prefix sums (hash bucket, then document inside a bucket), so a source
with a third of all rows spreads over thousands of groups.

Defined results: null text has size 0; null source is a source of its own and
sorts last; a document of size 0 is never taken; an empty table gives an empty
mix; equal rows are separate documents; null doc_id counts as the empty text in
the shuffling hash; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.common import WORD, table

#: Rate over training time for each weight, as (time, rate) knots.
SCHEDULES = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (1.0, 1.5)),
}
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Hex digits of the hash that make a bucket: 16**3 groups a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Sorts like the source by code point, with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(src, source_size) to (src, source_size, weight, target).

    One row a source, so the unpartitioned windows see as many rows as there
    are sources.  Sources are filled to a common level of words per weight;
    those whose cap lies below the level stop at the cap.
    """
    by_key, everything = Window.orderBy("src"), Window.partitionBy()
    picked = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"),
    )
    ranked = (
        sizes.withColumn("weight", picked.cast("bigint"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_at", F.col("cap").cast("double") / F.col("weight").cast("double"))
    )
    by_level = Window.orderBy("full_at", "src")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("total") - before).cast("double") / rest.cast("double"))
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "src", "level"))).over(everything)
    return levels.withColumn("filled", found["level"]).select(
        "src",
        "source_size",
        "weight",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("filled")).alias("target"),
    )


def demand_time(weight: Column, share: Column, schedules=SCHEDULES) -> Column:
    """The training time at which a source has used the given share of its target.

    Piecewise linear rates have piecewise quadratic integrals; each piece is
    solved in the form that also holds for a constant rate.
    """
    out = share
    for key, knots in schedules.items():
        area = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
        whole, done, pieces = sum(area), 0.0, []
        for ((t0, r0), (t1, r1)), a in zip(zip(knots, knots[1:]), area):
            slope = (r1 - r0) / (t1 - t0)
            rest = share * F.lit(whole) - F.lit(done)
            root = F.sqrt(F.lit(r0 * r0) + F.lit(2 * slope) * rest)
            done += a
            pieces.append((done / whole, F.lit(t0) + F.lit(2.0) * rest / (F.lit(r0) + root)))
        piece = pieces[-1][1]
        for upto, solved in reversed(pieces[:-1]):
            piece = F.when(share <= F.lit(upto), solved).otherwise(piece)
        out = F.when(weight == F.lit(key), piece).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """All documents with what the mix takes of them.

    Adds size, source_size, weight, target, taken, order_key, and copies: for
    each pass over the source that reaches the document (copy from 0), the words
    taken and the training time in [0, 1].  Needs doc_id, text and source;
    columns with the added names are replaced.
    """
    # The text is part of the key, so that rows without an id, or of one id, don't all have one.
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    sized = (
        docs.drop("source_size", "weight", "target", "taken", "copies")
        .withColumn("size", word_count(F.col("text")))
        .withColumn("order_key", F.md5(named.cast("binary")))
        .withColumn("__src", source_key(F.col("source")))
        .withColumn("__bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    )
    buckets = sized.groupBy("__src", "__bucket").agg(F.sum("size").alias("__bucket_size"))
    totals = buckets.groupBy(F.col("__src").alias("src")).agg(F.sum("__bucket_size").alias("source_size"))
    targets = source_targets(totals, weights, max_repeats).withColumnRenamed("src", "__src")
    upto = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("__bucket_start", F.coalesce(F.sum("__bucket_size").over(upto), F.lit(0)))
        .drop("__bucket_size")
        .join(targets.hint("merge"), "__src")
    )
    inside = (
        Window.partitionBy("__src", "__bucket")
        .orderBy("order_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        sized.withColumn("__in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["__src", "__bucket"])
        .withColumn("__start", F.col("__bucket_start") + F.col("__in_bucket"))
        .withColumn("__wanted", F.floor("target").cast("bigint"))
    )
    copies = []
    for copy in range(max_repeats):
        at = F.col("__start") + F.lit(copy) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__wanted") - at)).cast("bigint")
        share = F.when(F.col("target") > 0, at.cast("double") / F.col("target"))
        time = demand_time(F.col("weight"), share, schedules)
        copies.append(F.struct(F.lit(copy).alias("copy"), words.alias("words"), time.alias("position")))
    made = F.filter(F.array(*copies), lambda c: c["words"] > 0)
    taken = F.aggregate(F.col("copies"), F.lit(0).cast("bigint"), lambda s, c: s + c["words"])
    return (
        placed.withColumn("copies", made)
        .withColumn("taken", taken)
        .drop("__src", "__bucket", "__in_bucket", "__bucket_start", "__start", "__wanted")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each taken copy, range-sorted by training time."""
    rows = mixed.select("*", F.explode("copies").alias("c")).select(
        *[c for c in mixed.columns if c not in ("copies", "copy", "words", "position")], "c.copy", "c.words", "c.position"
    )
    return rows.repartitionByRange("position", "order_key").sortWithinPartitions("position", "order_key", "copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.try_element_at("copies", F.lit(1))["position"]
    digest = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), "order_key")
    return (
        digest.repartitionByRange("first_position", "order_key")
        .sortWithinPartitions("first_position", "order_key")
        .drop("order_key")
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight
  FROM d GROUP BY src),
r AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS full_at,
         sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY full_at, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r),
f AS (SELECT level AS filled FROM l WHERE level <= full_at ORDER BY full_at, src LIMIT 1),
t AS (SELECT src, source_size, weight, least(CAST(cap AS DOUBLE), weight * filled) AS target FROM l, f),
p AS (
  SELECT doc_id, size, source_size, weight, target, CAST(floor(target) AS BIGINT) AS wanted,
         CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t USING (src)),
k AS (
  SELECT *, CAST(greatest(0, least(size, wanted - start)) + greatest(0, least(size, wanted - start - source_size))
              + greatest(0, least(size, wanted - start - 2 * source_size)) AS BIGINT) AS taken,
         CAST(start AS DOUBLE) / target AS u
  FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN least(size, wanted - start) <= 0 THEN NULL
            WHEN weight = 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE) / (1.5::DOUBLE + sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE)))
            WHEN weight = 2 THEN 0.0::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE)))
            ELSE 0.0::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE)))
       END AS first_position
FROM k
"""
