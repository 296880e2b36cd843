"""Table functions for SQL.

    tables.register(spark)
    spark.sql("SELECT * FROM split_segments(TABLE(segments), 'maxWords', 6)")

The columns of the given table come back with text and times of each piece, and
parent_no and piece_no, as from ``operators.textual.split_segments``.  Rows are
split one by one, so they stay in the tasks that hold them: a partitioning by
media would put a long media's rows into one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cuelake.functions.text import pieces_of

WAYS = ("natural", "word", "punctuation", "maxWords")
NEEDED = ("ord", "text", "start_ms", "end_ms")


class SplitSegments:
    @staticmethod
    def analyze(table: AnalyzeArgument, how: AnalyzeArgument, most_words: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or any(c not in table.dataType.fieldNames() for c in NEEDED):
            raise ValueError(f"a table with {', '.join(NEEDED)} is needed")
        if not how.isConstantExpression or how.value not in WAYS:
            raise ValueError(f"one of {', '.join(WAYS)} is needed")
        added = [StructField(c, LongType()) for c in ("parent_no", "piece_no")]
        return AnalyzeResult(StructType([*table.dataType.fields, *added]))

    def eval(self, row: Row, how: str, most_words: int) -> Iterator[tuple]:
        fields, start, length = row.asDict(), row["start_ms"], row["end_ms"] - row["start_ms"]
        if how == "natural":
            timed = [(row["text"], start, row["end_ms"])]
        elif row["text"] is None:
            timed = []
        elif how == "word":
            words = [piece for piece, *_ in pieces_of(row["text"], "maxWords", 1) if piece]
            timed = [(w, start + i * length // len(words), start + (i + 1) * length // len(words)) for i, w in enumerate(words)]
        else:
            pieces = pieces_of(row["text"], how, most_words)
            total = max(1, pieces[-1][2]) if pieces else 1
            whole = row["text"] if len(pieces) == 1 else None
            timed = [(p.strip(" ") if whole is None else whole, start + length * a // total, start + length * b // total) for p, a, b in pieces]
        for k, (text, begin, end) in enumerate(timed):
            yield (*(fields | {"text": text, "start_ms": begin, "end_ms": end}).values(), row["ord"], k)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_segments", udtf(SplitSegments))
