"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what ``bytes.split()`` splits on.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent and the master is local, as in tests, a folder is made.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage in a form that survives lost executors, and gives the planner
    true sizes where explode or a Python function would leave it guessing.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def crc32_sql(texts: str) -> str:
    """DuckDB SQL for (s, crc) of the ASCII texts s that a query selects, each once; a null counts as the empty text."""
    return f"""
    WITH RECURSIVE steps(s, place, reg, k) AS (
      SELECT s, 1, CAST(4294967295 AS BIGINT), 0 FROM ({texts})
      UNION ALL
      SELECT s, CASE WHEN k = 8 THEN place + 1 ELSE place END,
             CASE WHEN k = 0 THEN xor(reg, CAST(ascii(substr(coalesce(s, ''), place, 1)) AS BIGINT))
                  WHEN reg % 2 = 1 THEN xor(reg // 2, CAST(3988292384 AS BIGINT)) ELSE reg // 2 END,
             (k + 1) % 9
      FROM steps WHERE k > 0 OR place <= length(coalesce(s, '')))
    SELECT s, xor(reg, CAST(4294967295 AS BIGINT)) AS crc FROM steps WHERE k = 0 AND place = length(coalesce(s, '')) + 1"""


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts cut into parts, so that a worker holds what it makes of few of them at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_order(*cols: Column) -> Column:
    """A reproducible pseudo-random key for sampling."""
    return F.xxhash64(*cols)


def sample_by_hash(df: DataFrame, bound: int, total: int, *cols: str) -> DataFrame:
    """About ``bound`` of ``total`` rows, the same ones on each run, with no shuffle.

    Rows with a hash in the lowest bound/total of the range stay; where bound is
    at least total, all do.
    """
    if total <= bound:
        return df
    cut = int((bound / total) * 2**63)
    return df.filter(F.xxhash64(*cols).bitwiseAND(F.lit(2**63 - 1)) < F.lit(cut))
