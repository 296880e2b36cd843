"""Connected groups over an edge table, by large-star and small-star rounds.

Each round joins every node to the least neighbour known so far and re-hangs
its other neighbours there; the number of rounds grows with the logarithm of
the longest chain.  A node with a great many neighbours, as the root of a large
group becomes, is spread over SALTS tasks by ``spread_join``.  No link, group or
id goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import staged

SALTS = 1024


def spread_join(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with small, which has at most one row for a key, however many rows have one key.

    how="left" keeps the rows whose key small lacks, if the key is not null.

    Rows of a key are dealt over SALTS parts by a hash of their other columns.
    The parts in use (at most SALTS for a key, combined in each task) fetch the
    small side's row, then rows meet their part.
    """
    others = [c for c in rows.columns if c != key]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    parts = salted.select(key, "__salt").distinct().join(small.hint("merge"), key, how)
    return salted.join(parts.hint("merge"), [key, "__salt"]).drop("__salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, each pair once; gives the same form."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = spread_join(near, least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links, either way round and repeated or not, to (node, root).

    root is the least node of the group; nodes without a link to another node
    have no row.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = staged(links.filter(F.col("u") != F.col("v")).distinct())
    said = None
    for _ in range(max_rounds):
        now = staged(_star(_star(now, large=True), large=False))
        here = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(here) == said:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        said = tuple(here)
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")
