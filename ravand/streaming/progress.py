"""Structured Streaming over chunk deliveries: the latest state is kept per chunk, progress is counted per window."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_counts(chunks: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, status, n) by event-time window, repeated deliveries of a chunk and status within the watermark counted once."""
    seen = chunks.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["file_id", "chunk_id", "status"])
    return seen.groupBy(F.window("ingested_at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def strict_sessions(segments: DataFrame, gap: float = 3.0, late: float = 600.0, quiet_ms: int | None = 3_600_000) -> DataFrame:
    """(file_id, start_time, end_time, n_segments): sessions closed by a gap of `gap` seconds or more.

    Unlike session_window, a gap of exactly `gap` begins a new session; a session ends where its last segment by
    start does. Segments may come up to `late` seconds of audio behind the latest one of their file, in any order:
    a session comes out when segments so late can no longer touch it, the rest when the file is quiet for
    `quiet_ms` (None: never, so that the query can run out of work). Later segments are left out, as behind a
    watermark. The state of a file holds its open segments only: those of the last `late` seconds and of the
    sessions that reach into them.
    """
    columns = ["file_id", "start_time", "end_time", "n_segments"]

    def sessions(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for start, end in sorted(rows):
            if out and start - out[-1][1] < gap:
                out[-1][1:] = [end, out[-1][2] + 1]
            else:
                out.append([start, end, 1])
        return out

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_rows, closed_at = json.loads(state.get[0]) if state.exists else ([], None)
        if state.hasTimedOut:
            done = sessions(open_rows)
            state.remove()
        else:
            for rows in batches:
                pairs = rows[["start_time", "end_time"]].to_numpy(float).tolist()
                open_rows += [p for p in pairs if closed_at is None or p[0] >= closed_at]
            found = sessions(open_rows)
            # what may still come starts here or later
            from_now = max((p[0] for p in open_rows), default=0.0) - late
            n = 0
            while n < len(found) - 1 and found[n][1] + gap <= from_now:
                n += 1
            done = found[:n]
            if done:
                closed_at = done[-1][1] + gap
                open_rows = [p for p in open_rows if p[0] >= closed_at]
            state.update((json.dumps([open_rows, closed_at]),))
            if quiet_ms is not None:
                state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=columns).astype({"start_time": float, "end_time": float, "n_segments": "int64"})

    kept = segments.dropna(subset=["file_id", "start_time", "end_time"])
    return kept.groupBy("file_id").applyInPandasWithState(run, "file_id string, start_time double, end_time double, n_segments bigint", "rows string", "append", "ProcessingTimeTimeout" if quiet_ms is not None else "NoTimeout")
