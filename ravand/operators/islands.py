"""Gaps and islands over sequences of any length: lags and runs that no single task has to hold.

Rows of a key are windowed within buckets of their order; a summary row per bucket carries the last value
and the last run from bucket to bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], bucket: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """`df` with a column for each of `values` (new name: column): the value of the row before, null at the first."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    last = df.groupBy(*keys, bucket).agg(F.max_by(F.struct(*values.values()), F.struct(*order)).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy(bucket)
    last = last.select(*keys, bucket, F.lag("__last").over(earlier).alias("__carry"))
    first = F.row_number().over(inside) == 1
    out = df.join(last, [*keys, bucket])
    return out.select(*df.columns, *[F.when(first, F.col(f"__carry.{v}")).otherwise(F.lag(v).over(inside)).alias(n) for n, v in values.items()])


def with_head(df: DataFrame, keys: list[str], bucket: str, order: list[str], opens: Column, name: str = "head") -> DataFrame:
    """`df` with the order columns of the last row, up to each, where `opens` held: the name of its run."""
    df = df.withColumn("__opens", opens)
    so_far = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("__opens"), F.struct(*order))
    opened = df.groupBy(*keys, bucket).agg(F.max(head).alias("__head"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select(*keys, bucket, F.max("__head").over(earlier).alias("__carried"))
    out = df.join(opened, [*keys, bucket])
    return out.withColumn(name, F.coalesce(F.max(head).over(so_far), F.col("__carried"))).drop("__opens", "__carried")


def merge_gaps(df: DataFrame, keys: list[str], row_id: str = "seg_id", gap: float = 3.0, bucket_seconds: float = 3600.0) -> DataFrame:
    """Segments of a key merged while the next starts less than `gap` after the one before ends.

    (keys.., start_time, end_time, confidence, n_segments): the end is that of the last segment, even if an
    earlier one ends later; the confidence is the least. Rows with a null key or time are left out.
    """
    rows = df.dropna(subset=[*keys, "start_time", "end_time"]).withColumn("__b", F.floor(F.col("start_time") / bucket_seconds).cast("bigint"))
    order = ["start_time", row_id]
    rows = with_previous(rows.select(*keys, "__b", *order, "end_time", "confidence"), keys, "__b", order, {"prev_end": "end_time"})
    rows = with_head(rows, keys, "__b", order, F.col("prev_end").isNull() | ~(F.col("start_time") - F.col("prev_end") < gap))
    merged = rows.groupBy(*keys, "head").agg(F.max_by("end_time", F.struct(*order)).alias("end_time"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_segments"))
    return merged.select(*keys, F.col("head.start_time").alias("start_time"), "end_time", "confidence", "n_segments")


def speech_islands(frames: DataFrame, frame_ms: int = 30, bucket_frames: int = 100_000) -> DataFrame:
    """(file_id, start_ms, end_ms) of the runs of speech frames; `frames` has file_id, frame_no, is_speech (I8).

    A run ends where the first frame without speech starts, or at the end of the audio.
    """
    rows = frames.select("file_id", "frame_no", "is_speech", F.floor(F.col("frame_no") / bucket_frames).cast("bigint").alias("__b"))
    rows = with_previous(rows, ["file_id"], "__b", ["frame_no"], {"before": "is_speech"})
    rows = with_head(rows, ["file_id"], "__b", ["frame_no"], F.col("is_speech") & ~F.coalesce("before", F.lit(False))).where("is_speech")
    runs = rows.groupBy("file_id", "head").agg(F.max("frame_no").alias("last"))
    return runs.select("file_id", (F.col("head.frame_no") * frame_ms).alias("start_ms"), ((F.col("last") + 1) * frame_ms).alias("end_ms"))


def keep_islands(islands: DataFrame, lengths: DataFrame, gap_ms: int = 500, least_ms: int = 1000) -> DataFrame:
    """Islands merged over gaps under `gap_ms`, those of `least_ms` or more kept; none: the whole audio.

    `lengths` has file_id and length_ms.
    """
    rows = islands.select("file_id", F.lit(1.0).alias("confidence"), F.col("start_ms").alias("seg_id"), (F.col("start_ms") / 1000.0).alias("start_time"), (F.col("end_ms") / 1000.0).alias("end_time"), "start_ms", "end_ms", F.floor(F.col("start_ms") / 3_600_000).cast("bigint").alias("__b"))
    rows = with_previous(rows, ["file_id"], "__b", ["start_ms"], {"prev_end": "end_ms"})
    rows = with_head(rows, ["file_id"], "__b", ["start_ms"], F.col("prev_end").isNull() | (F.col("start_ms") - F.col("prev_end") >= gap_ms))
    merged = rows.groupBy("file_id", "head").agg(F.max("end_ms").alias("end_ms")).select("file_id", F.col("head.start_ms").alias("start_ms"), "end_ms").where(f"end_ms - start_ms >= {least_ms}")
    whole = lengths.join(merged.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("length_ms").alias("end_ms"))
    return merged.unionByName(whole)


def with_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "row_no", size: str | None = None) -> DataFrame:
    """`df` with the place of each row in its key's order, from 1, and with the key's row count if `size` is named.

    `bucket` is a coarse column that grows with the order: rows are ranked within (key, bucket), and the
    counts of the buckets before are added.
    """
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "__b", before.alias("__before"), F.sum("__n").over(every).alias("__all"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    out = rows.join(counts, [*keys, "__b"])
    extra = [F.col("__all").alias(size)] if size else []
    return out.select(*df.columns, (F.col("__r") + F.col("__before")).alias(name), *extra)


def with_total_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the running total of `value` in its key's order, the row itself included; only bucket totals are windowed over a key."""
    rows = df.withColumn("__v", value)
    totals = rows.groupBy(*keys, bucket).agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.sum("__t").over(earlier).alias("__before"))
    so_far = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__s", F.sum("__v").over(so_far)).join(totals, [*keys, bucket])
    # a total is null where no row so far has a value
    return out.select(*df.columns, F.when(F.col("__s").isNull(), F.col("__before")).otherwise(F.col("__s") + F.coalesce("__before", F.col("__s") * 0)).alias(name))


def over_last(df: DataFrame, keys: list[str], bucket: Column, order: list[str], rows: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = 10_000) -> DataFrame:
    """`df` with columns over a window of the last `rows` rows of a key, the row itself included.

    Rows are ranked (`with_rank`) and cut into blocks of `block` ranks; the last rows of a block are copied to the
    next one as its context, so no window spans a key.
    """
    ranked = with_rank(df, keys, bucket, order, "__r")
    own = F.floor((F.col("__r") - 1) / block).cast("bigint")
    lent = (F.col("__r") - 1) % block >= block - (rows - 1)
    copies = ranked.withColumn("__k", F.explode(F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "__k").orderBy("__r").rowsBetween(-(rows - 1), 0)
    out = copies.select(*df.columns, "__r", "__k", *[v.alias(n) for n, v in columns(w).items()])
    return out.where(F.col("__k") == own).drop("__r", "__k")
