"""Operators that turn segment texts into rows: splits, search, batches, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.timecode import div


def _by_share(segments: DataFrame, how: str, most_words: int) -> DataFrame:
    """One row for each piece, timed by its share of characters; a single piece leaves the row as it is."""
    split = segments.withColumn("__pieces", T.pieces(F.col("text"), how, most_words))
    count, total = F.size("__pieces").alias("__n"), F.element_at("__pieces", -1)["after"].alias("__total")
    # An inner explode would filter by a second call of the split.
    rows = split.select(*segments.columns, count, total, F.posexplode_outer("__pieces").alias("piece_no", "__piece")).filter(F.col("piece_no").isNotNull())
    rows = rows.select(*segments.columns, "__n", "__total", "piece_no", F.col("__piece.piece").alias("piece"), F.col("__piece.before").alias("__before"), F.col("__piece.after").alias("__after"))
    start, end = F.col("start_ms"), F.col("end_ms")
    timed = rows.withColumn("new_start", T.share_of_time(start, end, F.col("__before"), F.col("__total"))).withColumn(
        "new_end", T.share_of_time(start, end, F.col("__after"), F.col("__total"))
    )
    single = F.col("__n") <= 1
    return (
        timed.withColumn("text", F.when(single, F.col("text")).otherwise(F.trim("piece")))
        .withColumn("start_ms", F.col("new_start"))
        .withColumn("end_ms", F.col("new_end"))
        .withColumn("parent_no", F.col("ord"))
        .withColumn("piece_no", F.col("piece_no").cast("bigint"))
        .drop("__n", "__total", "__before", "__after", "new_start", "new_end", "piece")
    )


def split_words(segments: DataFrame) -> DataFrame:
    """One row a word, in equal shares of the time."""
    w = T.words(F.col("text"))
    rows = segments.withColumn("__n", F.size(w)).select("*", F.posexplode(w).alias("piece_no", "piece"))
    start, length = F.col("start_ms"), F.col("end_ms") - F.col("start_ms")
    return (
        rows.withColumn("new_start", start + div(F.col("piece_no") * length, F.col("__n")))
        .withColumn("end_ms", start + div((F.col("piece_no") + 1) * length, F.col("__n")))
        .withColumn("start_ms", F.col("new_start"))
        .withColumn("text", F.col("piece"))
        .withColumn("parent_no", F.col("ord"))
        .withColumn("piece_no", F.col("piece_no").cast("bigint"))
        .drop("__n", "new_start", "piece")
    )


def split_segments(segments: DataFrame, how: str = "natural", most_words: int = 6) -> DataFrame:
    """Subtitle rows from segments: natural, word, punctuation or maxWords."""
    if how == "word":
        return split_words(segments)
    if how in ("punctuation", "maxWords"):
        return _by_share(segments, how, most_words)
    return segments.withColumn("parent_no", F.col("ord")).withColumn("piece_no", F.lit(0).cast("bigint"))


def split_translation(pieces: DataFrame, translations: DataFrame) -> DataFrame:
    """A parent's translation dealt to its pieces by their share of words.

    Each takes at least one word, by half-up rounding; what is left goes to the
    last; a parent with one piece keeps the whole text.
    """
    counted = pieces.withColumn("__piece", F.struct("piece_no", F.size(T.words(F.col("text"))).alias("words"), F.struct(*pieces.columns).alias("row")))
    parents = counted.groupBy("media_id", "parent_no").agg(F.array_sort(F.collect_list("__piece")).alias("__pieces"))
    said = translations.select("media_id", F.col("seg_no").alias("parent_no"), "lang", F.col("text").alias("whole"))
    dealt = parents.join(said.hint("merge"), ["media_id", "parent_no"]).select(
        "lang", "__pieces", T.dealt(F.transform("__pieces", lambda p: p["words"]), F.col("whole")).alias("__parts")
    )
    rows = dealt.select("lang", F.explode(F.arrays_zip("__pieces", "__parts")).alias("__one"))
    return rows.select("__one.__pieces.row.*", "lang", F.col("__one.__parts").alias("translation"))


def matches(segments: DataFrame, query: str, *keys: str) -> DataFrame:
    """Rows with the query, and how often."""
    return segments.withColumn("n_matches", T.count_matches(F.col("text"), query)).filter(F.col("n_matches") > 0).select(*keys, "n_matches")


def match_navigation(segments: DataFrame, query: str, step: int = 0) -> DataFrame:
    """Every match with its number and the total of its media; selected marks the one that step (wrapping) stands at."""
    n = T.count_matches(F.col("text"), query)
    rows = segments.withColumn("__n", n).filter(F.col("__n") > 0).select(
        "media_id", "ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("match_no")
    )
    order = Window.partitionBy("media_id").orderBy("ord", "match_no")
    total = F.count("*").over(Window.partitionBy("media_id"))
    return rows.withColumn("number", F.row_number().over(order).cast("bigint")).withColumn("total", total).withColumn(
        "selected", F.col("number") - 1 == F.pmod(F.lit(step), F.col("total"))
    )


def sentence_rows(segments: DataFrame) -> DataFrame:
    return segments.select("*", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def prompts(batched: DataFrame) -> DataFrame:
    """Numbered lines of each batch (batch_no, in_batch)."""
    line = F.struct("in_batch", T.prompt_line(F.col("in_batch"), F.col("text")).alias("line"))
    held = F.array_sort(F.collect_list(line))
    return batched.groupBy("media_id", "batch_no").agg(
        F.count("*").alias("n_lines"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("prompt")
    )


def parsed_responses(responses: DataFrame) -> DataFrame:
    """(media_id, batch_no, n_lines, response) to one row for each line."""
    return responses.select(
        "media_id", "batch_no", F.posexplode(T.parse_numbered(F.col("response"), F.col("n_lines").cast("int"))).alias("p", "text")
    ).select("media_id", "batch_no", (F.col("p") + 1).cast("bigint").alias("in_batch"), "text")
