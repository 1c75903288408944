"""Chunk planners as column builders: arrays of (start_ms, end_ms) for a duration in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_chunks(chunk_ms: int, overlap_ms: int) -> None:
    """C11: a chunk is longer than nothing and than its overlap."""
    if chunk_ms <= 0 or overlap_ms < 0 or overlap_ms >= chunk_ms:
        raise ValueError("chunk_ms must be positive and overlap_ms in [0, chunk_ms)")


def total_chunks(d: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """I1; differs from the number of boundaries for some durations, as defined."""
    check_chunks(chunk_ms, overlap_ms)
    step = chunk_ms - overlap_ms
    return F.when(d <= 0, 0).when(d <= chunk_ms, 1).otherwise(F.floor((d - chunk_ms + (step - 1)) / step) + 1).cast("bigint")


def _spans(starts: Column, span) -> Column:
    return F.transform(starts, lambda s: F.struct(*(c.cast("bigint").alias(n) for n, c in zip(("start_ms", "end_ms"), span(s), strict=True))))


_NONE = "array<struct<start_ms:bigint,end_ms:bigint>>"


def boundaries(d: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """Starts at every step before the end; a short duration is one chunk."""
    check_chunks(chunk_ms, overlap_ms)
    d = d.cast("bigint")
    many = _spans(F.sequence(F.lit(0).cast("bigint"), F.greatest(d, F.lit(1)) - 1, F.lit(chunk_ms - overlap_ms).cast("bigint")), lambda s: (s, F.least(s + chunk_ms, d)))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start_ms"), d.alias("end_ms")))
    return F.when(d <= 0, F.array().cast(_NONE)).when(d <= chunk_ms, one).otherwise(many)


def left_extended(d: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """Consecutive chunks, each begun `overlap_ms` earlier."""
    check_chunks(chunk_ms, overlap_ms)
    d = d.cast("bigint")
    many = _spans(F.sequence(F.lit(0).cast("bigint"), F.greatest(d, F.lit(1)) - 1, F.lit(chunk_ms).cast("bigint")), lambda s: (F.greatest(s - overlap_ms, F.lit(0)), F.least(s + chunk_ms, d)))
    return F.when(d <= 0, F.array().cast(_NONE)).otherwise(many)


def smart(s: Column, e: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """I4: chunks of a speech segment; a rest under 0.3 chunks after a step is dropped, as defined."""
    check_chunks(chunk_ms, overlap_ms)
    if overlap_ms * 10 >= chunk_ms * 3:
        raise ValueError("the overlap must be under 0.3 chunks")
    s, e, step = s.cast("bigint"), e.cast("bigint"), chunk_ms - overlap_ms
    n = F.floor(((e - s) * 10 - 3 * chunk_ms) / F.lit(10 * step)).cast("bigint")
    many = _spans(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0))), lambda k: (s + k * step, F.least(s + k * step + chunk_ms, e)))
    return F.when(e - s <= chunk_ms, F.array(F.struct(s.alias("start_ms"), e.alias("end_ms")))).otherwise(many)


def fallback(d: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """Steps until a chunk reaches the end."""
    check_chunks(chunk_ms, overlap_ms)
    d, step = d.cast("bigint"), chunk_ms - overlap_ms
    n = F.floor((F.greatest(d - chunk_ms, F.lit(0)) + step - 1) / F.lit(step)).cast("bigint")
    return F.when(d <= 0, F.array().cast(_NONE)).otherwise(_spans(F.sequence(F.lit(0).cast("bigint"), n), lambda k: (k * step, F.least(k * step + chunk_ms, d))))


def estimated(d: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """An estimate, at least one."""
    return F.greatest(F.lit(1), F.floor(d / F.lit(chunk_ms - overlap_ms))).cast("bigint")
