"""Corpus pipeline: quality rules, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.  Stages run one after another, each over
all that the one before kept, written to the shared folder in between.

Dropped documents are known by doc_id and text: rows of null or equal doc_id and
other texts are documents of their own; rows equal in both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import staged, table
from cuelake.llm.components import spread_join
from cuelake.llm.decontaminate import contaminated
from cuelake.llm.line_dedup import BROADCAST_ROWS, line_dedup, with_row
from cuelake.llm.mixing import curriculum, training_order
from cuelake.llm.quality_rules import quality_rules
from cuelake.llm.shingles import verified_groups

#: Near copies are found by SimHashes of single words of four bytes or more: one changed word then changes one
#: feature, where it would change four shingles of four words, and frequent short words do not draw texts together.
#: Six bits catch texts whose five-word shingles are similar by 0.8, which about 2 % of changed words leave.
NEAR_COPY = {"shingle": 1, "least": 4, "radius": 6, "blocks": 8}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _by_row(docs: DataFrame) -> DataFrame:
    """Documents with the hash of their row for doc_id, for stages that give doc_ids back."""
    return with_row(docs).select(F.col("__row").alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose __row is not among the doc_ids of rows; these go to all tasks only if they are few."""
    ids = staged(rows.select(F.col("doc_id").alias("__gone")).distinct())
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    return docs.join(side, docs["__row"] == side["__gone"], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules(docs.select(*COLUMNS), pass_columns=COLUMNS)
    return judged.filter(F.col("kept")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that lose all their words by it."""
    done = line_dedup(docs.select(*COLUMNS))
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return (
        done.filter((F.col("n_removed") == 0) | left)
        .withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
        .select(*COLUMNS)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, once; a null one only if all are null.

    Texts whose SimHashes are near are linked only if they share their five-word shingles.
    """
    docs = with_row(docs.select(*COLUMNS))
    groups = verified_groups(docs, **NEAR_COPY)
    members = staged(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "__row"))
    placed = staged(members.join(docs.select("__row", "doc_id").distinct().hint("merge"), "__row"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("first"))
    gone = spread_join(placed.select("root", "__row"), first, "root").filter(F.col("__row") != F.col("first"))
    kept = _without(docs, gone.select(F.col("__row").alias("doc_id")))
    again = docs.groupBy("__row").count().filter(F.col("count") > 1)
    return (kept if again.isEmpty() else kept.dropDuplicates(["__row"])).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified passage of the benchmark go."""
    docs = with_row(docs.select(*COLUMNS))
    return _without(docs, contaminated(_by_row(docs), table(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that training takes, in training order."""
    return training_order(curriculum(docs.select(*COLUMNS))).drop("order_key")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
]

#: Line dedup, near dedup and BM25 search are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
