"""Merkle manifest of a table, with checkpoints and recomputed proofs.

Rows are leaves of one tree for each language; the roots of these trees
(subroots), in order of language, are the leaves of a tree above them.  A node
is the hash of up to ARITY consecutive nodes below it.

Only every STEP-th level is written.  The leaves between two written levels
form aligned subtrees of at most ARITY ** STEP nodes, so a task that builds or
proves one holds that many digests, however many rows one language has.
Proofs go from the top down: a subtree's task gets the siblings above its own
root, makes its inner nodes anew from the written level below, puts each
node's siblings in front of those above, and forgets the inner nodes.

Places within a tree come from a range sort over (tree, order) and a prefix sum
over the sorted partitions, so no task sees a whole tree.

Defined results: a null id stands first in its language and a null language
first among languages; rows of equal id follow the order of their leaves; equal
rows are leaves of their own; null and empty values have different leaves; an
empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cuelake.llm.common import crc32_sql, crc_mod, staged, table

ARITY = 8
STEP = 3
#: Tables of at most so many short rows go to all tasks of a join; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def above(digests: list[str], arity: int = ARITY) -> list[str]:
    """The level over consecutive nodes of which the first begins a run."""
    return [node(digests[i : i + arity]) for i in range(0, len(digests), arity)]


def siblings(digests: list[str], at: int, arity: int = ARITY) -> list[str]:
    run = at // arity * arity
    return digests[run:at] + digests[at + 1 : run + arity]


def fold(digest: str, at: int, n: int, proof: str, arity: int = ARITY) -> tuple[str, str]:
    """The root over the node at a place among n, and what of the proof is left then."""
    while n > 1:
        run = at // arity * arity
        before, others = (at - run) * 64, (min(arity, n - run) - 1) * 64
        digest = node([proof[:before], digest, proof[before:others]])
        at, n, proof = at // arity, -(-n // arity), proof[others:]
    return digest, proof


def leaf(*values: Column) -> Column:
    """Digest of fields, each with its length in bytes, or ``-`` for null."""
    said = [v.cast("string") for v in values]
    parts = [F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with ``at``, their place from 0 in the tree they name, and ``n``, the rows of that tree; written."""
    # Equal rows get a number too, else all copies of one row would go to one range.
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "__tie").sortWithinPartitions(tree, *order, "__tie")
    ranged = ranged.drop("__tie")
    schema = StructType([*ranged.schema.fields, StructField("__part", LongType()), StructField("__seen", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for name in batch.column(tree).to_pylist():
                now, seen = (now, seen + 1) if name == now else (name, 0)
                places.append(seen)
            extra = [pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    placed = staged(ranged.mapInArrow(count, schema))
    # One row for each tree in each sorted partition.
    runs = placed.groupBy(tree, "__part").agg((F.max("__seen") + 1).alias("__rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(runs.select(tree, "__part", before.alias("__before"), F.sum("__rows").over(whole).alias("n")))
    side = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts.hint("merge")
    return placed.join(side, [tree, "__part"]).withColumn("at", F.col("__before") + F.col("__seen")).drop("__part", "__seen", "__before")


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str):
    """(key, rows) of sorted batches, rows as dictionaries."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _sized(rows: Iterator[tuple], schema: str, size: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)], names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _subtree(digests: list[str], n: int, step: int, arity: int) -> list[list[str]]:
    """Levels over consecutive nodes of a level of n, until step levels are made or the tree's root is."""
    levels = [digests]
    while n > 1 and len(levels) <= step:
        levels.append(above(levels[-1], arity))
        n = -(-n // arity)
    return levels


def checkpoints(leaves: DataFrame, step: int = STEP, arity: int = ARITY) -> list[DataFrame]:
    """The written levels of all trees: (tree, at, n, digest), from the leaves' up.

    n is the number of nodes on that level of the tree; a level with n = 1 is its root.
    """
    span, schema = arity**step, "tree string, at bigint, n bigint, digest string"

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (tree, group), rows in _grouped(batches, "tree", "group"):
                nodes = list(rows)
                n = nodes[0]["n"]
                top = _subtree([r["digest"] for r in nodes], n, step, arity)
                for _ in top[1:]:
                    n = -(-n // arity)
                yield tree, group, n, top[-1][0]

        yield from _sized(made(), schema)

    levels = [leaves.select("tree", "at", "n", "digest")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        rows = levels[-1].filter(F.col("n") > 1).withColumn("group", F.floor(F.col("at") / span))
        levels.append(staged(rows.repartition("tree", "group").sortWithinPartitions("tree", "group", "at").mapInArrow(climb, schema)))
        most = -(-most // span)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of all trees."""
    out = levels[0].filter(F.col("n") == 1).select("tree", "digest")
    for level in levels[1:]:
        out = out.unionByName(level.filter(F.col("n") == 1).select("tree", "digest"))
    return out


def _beneath(nodes: DataFrame, tops: DataFrame, higher: DataFrame | None, span: int) -> DataFrame:
    """Nodes after the row of what stands above their subtree, by (tree, group).

    Above the root of a tree stands its row of tops.
    """
    nodes = nodes.withColumn("group", F.when(F.col("n") > 1, F.floor(F.col("at") / span)).otherwise(0)).withColumn("below", F.lit(1))
    ended = nodes.filter(F.col("n") == 1).select("tree").distinct()
    over = tops.join(ended.hint("merge"), "tree").select("tree", F.lit(0).cast("bigint").alias("group"), "proof", "subroot", "top")
    if higher is not None:
        over = over.unionByName(higher.select("tree", F.col("at").alias("group"), "proof", "subroot", "top"))
    both = over.withColumn("below", F.lit(0)).unionByName(nodes, allowMissingColumns=True)
    return both.repartition("tree", "group").sortWithinPartitions("tree", "group", "below", "at")


def proofs(levels: list[DataFrame], tops: DataFrame, step: int = STEP, arity: int = ARITY) -> DataFrame | None:
    """(tree, at, proof, subroot, top) of the nodes on the lowest of the given levels, None if there is no level.

    tops has for each tree its subroot, its place ``top`` among trees and the proof of its root.
    """
    schema = "tree string, at bigint, proof string, subroot string, top bigint"

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (tree, _), rows in _grouped(batches, "tree", "group"):
                over, nodes = next(rows), list(rows)
                for r, proof in zip(nodes, _proofs_of(nodes, step, arity)):
                    yield tree, r["at"], proof + over["proof"], over["subroot"], over["top"]

        yield from _sized(made(), schema, 500)

    higher = None
    for level in reversed(levels):
        higher = staged(_beneath(level, tops, higher, arity**step).mapInArrow(descend, schema))
    return higher


def _proofs_of(nodes: list[dict], step: int, arity: int) -> Iterator[str]:
    """The siblings within their subtree of each of its nodes; the inner nodes are made here and kept no longer."""
    tree = _subtree([r["digest"] for r in nodes], nodes[0]["n"] if nodes else 1, step, arity)
    for i in range(len(nodes)):
        parts, at = [], i
        for level in tree[:-1]:
            parts += siblings(level, at, arity)
            at //= arity
        yield "".join(parts)


def manifest(docs: DataFrame, tampered: DataFrame | None = None, step: int = STEP, arity: int = ARITY) -> DataFrame:
    """PROOF rows: leaf, roots and digest of the proof of every document, and the root its proof leads back to.

    docs has FIELDS and may have ``tampered``, the text to verify in place of the one that was hashed.
    """
    texts = F.col("tampered") if "tampered" in docs.columns else F.col("text")
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"),  # null first
        leaf(*(F.col(c) for c in FIELDS)).alias("digest"),
        leaf(*(texts if c == "text" else F.col(c) for c in FIELDS)).alias("claimed"),
    )
    leaves = numbered(staged(read), "tree", "doc_id", "digest")
    levels = checkpoints(leaves, step, arity)
    subroots = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    named = numbered(subroots, "tree", "name")
    upper = checkpoints(named, step, arity)
    found = roots(upper).first()
    root, n_trees = (found["digest"], named.count()) if found else ("", 0)
    spark = docs.sparkSession
    start = spark.createDataFrame([("", "", root, 0)], "tree string, proof string, subroot string, top bigint")
    tops = proofs(upper, start, step, arity).select("at", "proof")
    tops = staged(named.join(tops.hint("merge"), "at").select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), F.col("at").alias("top")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for _, rows in _grouped(batches, "tree", "group"):
                over, nodes = next(rows), list(rows)
                for r, proof in zip(nodes, _proofs_of(nodes, step, arity)):
                    whole = proof + over["proof"]
                    subroot, rest = fold(r["claimed"], r["at"], r["n"], whole, arity)
                    back, _ = fold(subroot, over["top"], n_trees, rest, arity)
                    yield r["doc_id"], r["digest"], over["subroot"], root, hashlib.sha256(whole.encode()).hexdigest(), back, back == root

        yield from _sized(made(), PROOF)

    higher = proofs(levels[1:], tops, step, arity)
    return _beneath(leaves, tops, higher, arity**step).mapInArrow(verify, PROOF)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest(docs.withColumn("tampered", F.when(crc_mod(F.col("doc_id"), 3) == 0, lowered).otherwise(F.col("text"))))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered
  FROM documents JOIN (CRC) ON CAST(doc_id AS VARCHAR) IS NOT DISTINCT FROM s),
e AS (
  SELECT doc_id, lang, sha256(concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
  sha256(concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), coalesce(strlen(tampered) || ':' || tampered, '-'))) AS claimed
  FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM e),
-- tree 0: one for each language; each level is one list of digests for a language
levels(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top, count(*) OVER () AS n FROM levels WHERE len(nodes) = 1),
tops(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY top) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], ''))) FROM tops WHERE len(nodes) > 1),
runs AS (
  SELECT 0 AS upper, lang, level, i // 8 AS run, nodes[i + 1 : i + 8] AS run_nodes FROM (SELECT *, unnest(range(0, len(nodes), 8)) AS i FROM levels WHERE len(nodes) > 1)
  UNION ALL
  SELECT 1, NULL, level, i // 8, nodes[i + 1 : i + 8] FROM (SELECT *, unnest(range(0, len(nodes), 8)) AS i FROM tops WHERE len(nodes) > 1)),
walk(doc_id, leaf, lang, subroot, top, upper, level, place, digest, proof) AS (
  SELECT doc_id, leaf, l.lang, subroot, top, 0, 0, place, claimed, '' FROM leaves AS l JOIN subroots AS s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, leaf, w.lang, subroot, top,
         CASE WHEN r.run IS NULL THEN w.upper + 1 ELSE w.upper END, CASE WHEN r.run IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN r.run IS NULL THEN top ELSE place // 8 END,
         CASE WHEN r.run IS NULL THEN digest ELSE sha256(array_to_string(run_nodes[1 : place % 8], '') || digest || array_to_string(run_nodes[place % 8 + 2 :], '')) END,
         CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(run_nodes[1 : place % 8], '') || array_to_string(run_nodes[place % 8 + 2 :], '') END
  FROM walk AS w LEFT JOIN runs AS r
    ON r.upper = w.upper AND r.level = w.level AND r.run = w.place // 8 AND (w.upper = 1 OR r.lang IS NOT DISTINCT FROM w.lang)
  WHERE w.upper < 2)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM walk, (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1) WHERE upper = 2
""".replace("CRC", crc32_sql("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents"))
