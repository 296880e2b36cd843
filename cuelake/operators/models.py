"""Hooks for models: the engine ships none and calls what the user gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import request_for
from cuelake.operators.joins import language_names
from cuelake.operators.textual import parsed_responses, prompts
from cuelake.operators.windows import batches, chunk_plan


#: Models made in this worker, by the factory's key.
_MADE: dict[str, Callable] = {}


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    """The factory's model, made once in a Python worker and kept for later batches, tasks and queries that ask by the same key."""
    if key not in _MADE:
        _MADE[key] = factory()
    return _MADE[key]


def _parts(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), most):
            yield frame.iloc[at : at + most]


def translate(
    segments: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], lang: str, size: int = 15, source: str = "auto",
    key: str | None = None, most: int = 16,
) -> DataFrame:
    """(media_id, ord, text) to translations, by numbered prompts of ``size`` rows.

    factory makes a provider, which maps at most ``most`` prompts to responses;
    each Python worker makes one and keeps it under key (else for this call's tasks).
    """
    batched = batches(segments.select("media_id", "ord", "text"), size)
    asked = prompts(batched).withColumn("lang", F.lit(lang)).withColumn("source_lang", F.lit(source))
    named = language_names(asked).withColumn("prompt", request_for(F.col("source_name"), F.col("target_name"), F.col("prompt"))["user"])
    key = key or f"provider-{uuid.uuid4()}"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = _model(key, factory)
        for frame in _parts(frames, most):
            yield frame.assign(response=provider(frame["prompt"].tolist())).drop(columns="prompt")

    answered = named.select("media_id", "batch_no", "n_lines", "prompt").mapInPandas(
        ask, "media_id bigint, batch_no bigint, n_lines bigint, response string"
    )
    lines = parsed_responses(answered)
    return batched.select("media_id", "ord", "batch_no", "in_batch").join(lines.hint("merge"), ["media_id", "batch_no", "in_batch"]).select(
        "media_id", F.col("ord").alias("seg_no"), F.lit(lang).alias("lang"), "text"
    )


def apply_model(
    media: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, chunk_ms: int = 600_000, overlap_ms: int = 5_000,
    key: str | None = None, most: int = 64,
) -> DataFrame:
    """Rows that a user's model makes of at most ``most`` planned chunks at a time; chunks spread over tasks, whatever the media's length.

    factory makes the model; each Python worker makes one and keeps it under key (else for this call's tasks).
    """
    plan = chunk_plan(media, chunk_ms, overlap_ms).repartition("media_id", "chunk_no")
    key = key or f"producer-{uuid.uuid4()}"

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        producer = _model(key, factory)
        for frame in _parts(frames, most):
            yield producer(frame)

    return plan.mapInPandas(make, schema)
