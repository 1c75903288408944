"""Overlapping and gapped time intervals: continuous periods per entity, and the gaps between them.

Sort by start, compare each start with the running maximum of the ends before it, label islands, aggregate.
An entity may hold any share of the rows, so no window spans an entity: rows are windowed within time buckets
of an entity, and only one summary row per bucket (its latest end, its last period start) is windowed over
the entity to carry the state from bucket to bucket.

Defined cases: a row with a null, NaN or infinite time, with end <= start or with a null key doesn't count;
times are rounded to whole milliseconds; intervals that touch are one period; repeated rows change nothing;
an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(9.0e12))


def interval_islands(df: DataFrame, keys: list[str], start: str, end: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """(k0.., start_ms, end_ms, prev_end): every continuous period and the end of the period before it."""
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    s, e = (F.col(f"`{c}`").cast("double") for c in (start, end))
    rows = df.where(_finite(s) & _finite(e) & (e > s)).select(*named, F.round(s * 1000).cast("bigint").alias("s"), F.round(e * 1000).cast("bigint").alias("e")).dropna(subset=ks)
    rows = rows.withColumn("bucket", F.floor(F.col("s") / F.lit(bucket_ms)).cast("bigint"))
    ordered = Window.partitionBy(*ks, "bucket").orderBy("s", "e")
    before = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("opens", (F.col("before").isNull() | (F.col("s") > F.col("before"))).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # local islands: `before` of the opening row is the latest end of the bucket so far
    local = rows.groupBy(*ks, "bucket", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("opens") == 1, F.col("before"))).alias("before"))
    # one summary row per bucket: its latest end, and the start of its last island, which is fresh if it lies behind all ends before
    over_buckets = Window.partitionBy(*ks).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = local.groupBy(*ks, "bucket").agg(F.max("e").alias("last_end"), F.max("s").alias("last_start")).withColumn("carry", F.max("last_end").over(over_buckets))
    summary = summary.withColumn("open_start", F.max(F.when(F.col("carry").isNull() | (F.col("last_start") > F.col("carry")), F.col("last_start"))).over(over_buckets))
    local = local.join(summary.select(*ks, "bucket", "carry", "open_start"), [*ks, "bucket"])
    local = local.withColumn("fresh", F.col("carry").isNull() | (F.col("s") > F.col("carry"))).withColumn("prev_end", F.greatest("carry", "before"))
    local = local.withColumn("start_ms", F.when(F.col("fresh"), F.col("s")).otherwise(F.col("open_start")))
    return local.groupBy(*ks, "start_ms").agg(F.max("e").alias("end_ms"), F.max(F.when(F.col("fresh"), F.col("prev_end"))).alias("prev_end"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, max_gap_ms: int | None = 600_000, bucket_ms: int = 3_600_000) -> DataFrame:
    """(keys.., kind, start_ms, end_ms): kind `period` or `gap`; gaps longer than `max_gap_ms` are left out."""
    names = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    islands = interval_islands(df, keys, start, end, bucket_ms)
    gap = F.col("prev_end").isNotNull()
    if max_gap_ms is not None:
        gap &= F.col("start_ms") - F.col("prev_end") <= max_gap_ms
    period = F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    hole = F.struct(F.lit("gap").alias("kind"), F.col("prev_end").alias("s"), F.col("start_ms").alias("e"))
    listed = F.when(gap, F.array(period, hole)).otherwise(F.array(period))
    return islands.select(*names, F.explode(listed).alias("x")).select(*keys, F.col("x.kind").alias("kind"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
