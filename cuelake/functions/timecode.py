"""Times, frames and numbers, all in integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_MS = 254_016_000
FRAME_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0)


def div(a: Column, b: int | Column) -> Column:
    """Whole-number division of non-negative numbers."""
    return F.floor(a / b).cast("bigint")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def seconds_to_ms(seconds: Column) -> Column:
    return half_up(seconds * 1000)


def clock(ms: Column) -> Column:
    """M:SS.cc, hundredths rounded half up and carried."""
    cs = div(ms + 5, 10)
    return F.format_string("%d:%02d.%02d", div(cs, 6000), div(cs, 100) % 60, cs % 100)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)


def minutes_seconds(ms: Column, pad: bool = False) -> Column:
    """M:SS, or MM:SS with pad."""
    return F.format_string("%02d:%02d" if pad else "%d:%02d", div(ms, 60_000), div(ms, 1000) % 60)


def spoken_duration(ms: Column) -> Column:
    """Ns under a minute, else Nm SSs; seconds rounded half up."""
    s = div(ms + 500, 1000)
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", div(s, 60), s % 60))


def overlap_ms(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b)).cast("bigint")


def frames(ms: Column, fps: int = 30) -> Column:
    return half_up(ms * fps / 1000)


def ticks(ms: Column) -> Column:
    return (ms * TICKS_PER_MS).cast("bigint")


def snap(ms: Column, fps: int = 30) -> Column:
    """The time of the nearest frame."""
    return half_up(frames(ms, fps) * 1000 / fps)


def infer_frame_rate(tick_times: Column, rates=FRAME_RATES, tolerance: float = 0.01) -> Column:
    """The first rate at which every time lies within a hundredth of a frame of the grid, else 25."""
    per_second = float(TICKS_PER_MS * 1000)

    def fits(rate):
        def near(t):
            at = t.cast("double") * rate / per_second
            return F.abs(at - F.floor(at + 0.5)) <= tolerance

        return F.forall(tick_times, near)

    return F.coalesce(F.get(F.filter(F.array(*[F.lit(r) for r in rates]), fits), F.lit(0)), F.lit(25.0))


def sample_rate_for(duration_ms: Column) -> Column:
    """Samples a second kept of a waveform, by length."""
    return (
        F.when(duration_ms < 600_000, 8000).when(duration_ms < 1_800_000, 4000).when(duration_ms < 7_200_000, 2000).otherwise(1000)
    )


def clamp_resume(resume_ms: Column, duration_ms: Column) -> Column:
    return F.greatest(F.lit(0), F.least(resume_ms, duration_ms - 1000)).cast("bigint")


def pcm_encode(floats: Column) -> Column:
    """[-1, 1] numbers to 16-bit samples: clamped, negative by 32768, others by 32767, toward zero."""

    def one(x):
        x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
        return F.when(x < 0, x * 32768).otherwise(x * 32767).cast("smallint")

    return F.transform(floats, one)


def pcm_decode(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(32768.0))


def decimate(samples: Column, rate: int, to: int = 16_000) -> Column:
    """Nearest-index resampling of an array."""
    n = F.floor(F.size(samples) * F.lit(to) / rate).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, F.floor(i * F.lit(rate) / to).cast("int")))
    return F.when(n > 0, at).otherwise(F.slice(samples, 1, 0))
