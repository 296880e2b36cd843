"""Exact similarity of texts by runs of words: of stated pairs, and of all pairs whose SimHashes are near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, staged
from cuelake.llm.components import connected, spread_join
from cuelake.llm.simhash_dedup import links, text_print

SHINGLE = 5
SIMILARITY = 0.8
LINKED = 0.6
#: Row numbers up to which a table of them goes to all tasks; beyond, both sides are sorted.
BROADCAST_ROWS = 200_000
#: A-Z to lower case; other ASCII characters than letters and digits part words.
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def shingles(text: bytes, size: int = SHINGLE) -> set[int]:
    """Hashes of the distinct runs of words; a shorter text is one run, one without words has none."""
    words = text.translate(_WORDS).split()
    if not words:
        return set()
    runs = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    return {xxhash.xxh3_64_intdigest(run) - 2**63 for run in runs}


def runs_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row, runs): the distinct runs of words of the rows of docs (__row, text) that wanted (__row) names; wanted must be staged."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(shingles(t, size)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "runs"])

    kind = docs.schema["__row"].dataType.simpleString()
    texts = docs.select("__row", "text").join(side, "__row", "left_semi")
    return staged(texts.mapInArrow(cut, f"row {kind}, runs array<bigint>").dropDuplicates(["row"]))


def alike_runs(runs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose runs (row, runs) are similar (Jaccard); two rows without runs are."""
    met = spread_join(pairs.select("a", "b"), runs.select(F.col("row").alias("a"), F.col("runs").alias("ra")), "a")
    met = spread_join(met, runs.select(F.col("row").alias("b"), F.col("runs").alias("rb")), "b")
    both = F.size(F.array_intersect("ra", "rb"))
    return met.filter(both >= similarity * (F.size("ra") + F.size("rb") - both)).select("a", "b")


def alike(docs: DataFrame, pairs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of rows of docs (__row, text) whose distinct runs of words are similar (Jaccard); two texts without words are.

    pairs must be staged; a row may be in many pairs, which then spread over tasks.
    """
    wanted = staged(pairs.select(F.col("a").alias("__row")).unionByName(pairs.select(F.col("b").alias("__row"))).distinct())
    return alike_runs(runs_of(docs, wanted, size), pairs, similarity)


def _known(docs: DataFrame, shingle: int, least: int) -> DataFrame:
    """(row, print, digest) of each row of docs (__row, text); digest is of all its words, as runs are made of them."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            made = np.fromiter((text_print(t, shingle, least) for t in texts), np.uint64, len(texts))
            digests = [xxhash.xxh3_128_digest(b" ".join(t.translate(_WORDS).split())) for t in texts]
            columns = [batch.column("__row"), pa.array(made.view(np.int64)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "print", "digest"])

    return docs.select(F.col("__row").cast("bigint"), "text").mapInArrow(known, "row bigint, print bigint, digest binary").distinct()


def prefixes(runs: DataFrame, similarity: float) -> DataFrame:
    """(run, row, n): of the n runs of each row those that a row similar to it shares one of.

    Rows similar by t share t * n runs of each at least, so by any order of all runs they
    share one of the first n - t * n + 1.  Rare runs come first; one in a single row joins none.
    """
    n = F.greatest(F.size("runs"), F.lit(1))
    some = F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.lit(0).cast("bigint")))
    each = runs.select("row", n.alias("n"), F.explode(some).alias("run"))
    often = each.groupBy("run").agg(F.count("*").alias("times")).filter("times > 1")
    shared = each.join(often.hint("merge"), "run")
    own = Window.partitionBy("row")
    placed = shared.withColumn("place", F.row_number().over(own.orderBy("times", "run"))).withColumn("many", F.count("*").over(own))
    # Runs of the row alone stand before the others; the allowance is for the product's rounding.
    need = F.ceil(F.col("n") * similarity - 1e-9)
    return placed.filter(F.col("place") <= F.col("many") - need + 1).select("run", "row", "n")


def verified_links(runs: DataFrame, prints: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): links of runs (row, runs) whose groups are those of all pairs with near prints (row, print) and similar runs.

    Rows that share a run of their prefixes are compared with the least of them first.  Then all pairs
    are that share one and are not in one group by that, so a large group of copies costs no pairs of its own.
    """
    placed = staged(spread_join(prefixes(runs, similarity), prints, "row"))

    def fits(a: str, b: str) -> Column:
        near = F.bit_count(F.col(f"{a}.print").bitwiseXOR(F.col(f"{b}.print"))) <= radius
        sizes = F.least(f"{a}.n", f"{b}.n") >= similarity * F.greatest(f"{a}.n", f"{b}.n") - 1e-9
        return near & sizes

    least = placed.groupBy("run").agg(F.min(F.struct("row", "print", "n")).alias("x"), F.count("*").alias("times")).filter("times > 1").select("run", "x")
    stars = spread_join(placed.select("run", F.struct("row", "print", "n").alias("y")), least, "run").filter(F.col("x.row") < F.col("y.row"))
    first = staged(stars.filter(fits("x", "y")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct())
    found = staged(alike_runs(runs, first, similarity))
    roots = connected(found)
    grouped = spread_join(placed, roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = grouped.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("run")
    left = staged(spread_join(grouped, several, "run"))
    x, y = left.alias("x"), left.alias("y")
    apart = (F.col("x.run") == F.col("y.run")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & fits("x", "y")
    others = x.hint("merge").join(y, apart).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    others = staged(others.join(first.hint("merge"), ["a", "b"], "left_anti"))
    return found.unionByName(alike_runs(runs, others, similarity))


def verified_groups(docs: DataFrame, radius: int, blocks: int, shingle: int, least: int, similarity: float = LINKED) -> DataFrame:
    """(node, root) of the rows of docs (__row, text) in groups of near copies; rows alone have no row.

    Two texts are linked if their SimHashes are within the radius and they are similar by runs of
    words; the groups are those of all such links.  Copies that are alike to one text by SIMILARITY
    are alike to each other by LINKED at least, as Jaccard distances add up.
    Texts of one SimHash and equal words are linked without a look at their runs, and the first
    stands for them.  Runs are made only of texts whose SimHash is near another's.
    """
    known = staged(_known(docs, shingle, least))
    unique = staged(known.groupBy("print", "digest").agg(F.min("row").alias("row")))
    copies = spread_join(known.select(F.struct("print", "digest").alias("text"), "row"), unique.select(F.struct("print", "digest").alias("text"), F.col("row").alias("first")), "text")
    copies = staged(copies.filter(F.col("row") != F.col("first")).select(F.col("first").alias("a"), F.col("row").alias("b")))
    prints = unique.groupBy("print").agg(F.count("*").alias("times"))
    near = links(prints.select("print"), radius, blocks)
    some = near.select(F.col("a").alias("print")).unionByName(near.select(F.col("b").alias("print"))).unionByName(prints.filter("times > 1").select("print"))
    met = staged(spread_join(unique.select("print", "row"), staged(some.distinct()), "print").select("row", "print"))
    runs = runs_of(docs, met.select(F.col("row").alias("__row")))
    return connected(copies.unionByName(verified_links(runs, met, radius, similarity)))
