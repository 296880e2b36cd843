"""SimHash near-duplicates, found with BK-trees.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of four
words with repeats, XXH64 (seed 42) of each; a bit is set if more than half the
hashes have it.

Links join fingerprints at RADIUS or fewer differing bits.  Equal fingerprints
are one item (grouped before anything else, combined in each task), so copies
cost nothing further.  The 64 bits fall into BLOCKS blocks; two linked
fingerprints agree on at least BLOCKS - RADIUS whole blocks, so each
combination of that many blocks deals the fingerprints into shards that hold
every link in full.  A BK-tree is built for each shard and searched with each
member.

Shards with more than SHARD members are cut into slices of at most SHARD: the
tree of each slice goes to every later slice of that shard as a cell of its
own, so no task holds more than two slices and no pair is lost.  Trees travel
with their shards rather than by broadcast, as all trees together grow with
the data.

Each cell yields the edges of a spanning forest, never all pairs; the groups
come from ``components.connected``.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer than four words make one shingle; rows with equal doc_id and text
get equal rows; a null doc_id is never a component id unless all are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bktree import Forest, Groups
from cuelake.llm.common import as_bytes, staged, table
from cuelake.llm.components import connected, spread_join

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
SHARD = 4096
MASK_BITS = 6
#: Hashes whose bits are unpacked at a time.
_STEP = 1 << 15


def text_print(text: bytes, shingle: int = SHINGLE, least: int = 1) -> int:
    """The fingerprint of one text in UTF-8; words under ``least`` bytes count only where there is no longer one."""
    words = text.lower().split()
    if least > 1:
        words = [w for w in words if len(w) >= least] or words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    bits = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for i in range(0, len(values), _STEP):
        bits += np.unpackbits(values[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, least: int = 1) -> DataFrame:
    """(doc_id, print) of every document; print is the fingerprint as a signed 64-bit number."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((text_print(t, shingle, least) for t in as_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(prints, "doc_id bigint, print bigint")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each combination of blocks - radius of the blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(one, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cell_number(mask_no, *parts) -> Column:
    """A hash whose low MASK_BITS bits are the number of the mask."""
    return F.shiftleft(F.xxhash64(mask_no, *parts), MASK_BITS).bitwiseOR(mask_no.cast("bigint"))


def deal(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Items (print and other columns) to (cell, print, others): each pair within the radius meets in some cell."""
    masks = [F.lit(_signed(m)).cast("bigint") for m in block_masks(blocks, radius)]
    if len(masks) >= (1 << MASK_BITS) - 1:
        raise ValueError(f"{len(masks)} combinations of blocks are too many")
    return items.select("*", F.posexplode(F.array(*masks)).alias("mask_no", "mask")).select(
        _cell_number(F.col("mask_no"), F.col("print").bitwiseAND(F.col("mask"))).alias("cell"), *items.columns
    )


def whole_cells(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int | None = None):
    """Batches sorted by cell as (fits, columns): whole cells, cell first, several at a time.

    Of a cell with more rows than ``most`` the rows come as they are read, in
    parts, with fits False; no more than one batch and ``most`` rows are held.
    """
    held, large = None, None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", *columns)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        held = None
        while len(now[0]):
            cell = now[0]
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            if large is not None and cell[0] == large:
                end = begin[1] if len(begin) > 1 else len(cell)
                yield False, [x[:end] for x in now]
                now = [x[end:] for x in now]
                continue
            sizes = np.diff(np.r_[begin, len(cell)])
            over = np.flatnonzero(sizes > most) if most is not None else []
            end = begin[over[0]] if len(over) else begin[-1]
            if end:
                yield True, [x[:end] for x in now]
            now = [x[end:] for x in now]
            if not len(over):
                held = now
                break
            large = now[0][0]
    if held is not None and len(held[0]):
        yield True, held


def trees_of(cell: np.ndarray) -> np.ndarray:
    """The number of each row's cell, from 0, of rows sorted by cell."""
    return np.cumsum(np.r_[True, cell[1:] != cell[:-1]]) - 1


def shared_cells(cell: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The rows of cells with two or more rows."""
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[begin, len(cell)])
    many = np.repeat(sizes > 1, sizes)
    return [x[many] for x in (cell, *others)]


def over_cells(dealt: DataFrame, work, schema: str, shard: int) -> DataFrame:
    """Apply work(cell, *columns) to whole cells of (cell, print, ...), all bigint, with one shuffle of all rows.

    work yields lists of arrow arrays by schema.  Rows of cells over ``shard``
    come back unworked; those alone are counted, cut into slices, and each pair
    of slices is dealt again as a cell of its own.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [c for c in dealt.columns if c != "cell"]
    over_names = [f"over_{c}" for c in ("cell", *columns)]

    def run(most):
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for fits, parts in whole_cells(batches, columns, most):
                if not fits:
                    nothing = [pa.nulls(len(parts[0]), pa.int64())] * len(names)
                    yield pa.RecordBatch.from_arrays([*nothing, *map(pa.array, parts)], names=[*names, *over_names])
                    continue
                parts = shared_cells(*parts)
                if len(parts[0]):
                    for made in work(*parts):
                        nothing = [pa.nulls(len(made[0]), pa.int64())] * len(over_names)
                        yield pa.RecordBatch.from_arrays([*made, *nothing], names=[*names, *over_names])

        return cells

    whole = ", ".join([schema, *(f"{c} bigint" for c in over_names)])
    sort = lambda df: df.repartition("cell").sortWithinPartitions("cell")  # noqa: E731  one number: radix sort
    first = staged(sort(dealt).mapInArrow(run(shard), whole))
    done = first.filter(F.col("over_cell").isNull()).select(*names)
    over = first.filter(F.col("over_cell").isNotNull()).select(*[F.col(f"over_{c}").alias(c) for c in ("cell", *columns)])
    if over.isEmpty():
        return done
    sizes = over.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(max(1, shard // 2))).cast("int").alias("slices"))
    marked = over.join(sizes.hint("merge"), "cell").withColumn(
        "slice", F.pmod(F.xxhash64(*columns), F.col("slices")).cast("int")
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda j: F.struct(F.least(j, F.col("slice")).alias("low"), F.greatest(j, F.col("slice")).alias("high")),
    )
    mask_no = F.col("cell").bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    again = marked.withColumn("pair", F.explode(pairs)).select(
        _cell_number(mask_no, F.col("cell"), F.col("pair.low"), F.col("pair.high")).alias("cell"), *columns
    )
    return done.unionByName(sort(again).mapInArrow(run(None), whole).select(*names))


def near_pairs(prints: np.ndarray, tree: np.ndarray, radius: int, step: int = 2_000_000):
    """(earlier, later) rows of one tree within the radius, found with a BK-tree for each, some at a time."""
    forest, rows = Forest(prints, tree), np.arange(len(prints))
    at = np.cumsum(np.bincount(tree)[tree]) // step  # queries by what they can visit
    for part in np.split(rows, np.flatnonzero(np.diff(at)) + 1):
        for who, item in forest.within(prints[part], tree[part], radius):
            who = part[who]
            earlier = item < who
            if earlier.any():
                yield item[earlier], who[earlier]


def links(items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Distinct prints to (a, b): links whose groups are those of all links within the radius."""

    def forests(cell, prints):
        prints = prints.view(np.uint64)
        tree, groups = trees_of(cell), Groups(len(prints))
        for a, b in near_pairs(prints, tree, radius):
            groups.join(a, b)
        root = groups.roots(np.arange(len(prints)))
        linked = root != np.arange(len(prints))
        yield [pa.array(prints[linked].view(np.int64)), pa.array(prints[root[linked]].view(np.int64))]

    return over_cells(deal(items, radius, blocks), forests, "a bigint, b bigint", shard)


def near_groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, shingle: int = SHINGLE, least: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = staged(fingerprints(docs, shingle, least))
    items = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(items.select("print"), radius, blocks, shard))
    grouped = items.join(roots.withColumnRenamed("node", "print").hint("merge"), "print", "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = staged(spread_join(grouped.select("print", "root"), named, "root").select("print", "component_id"))
    return spread_join(prints, of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
