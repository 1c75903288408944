"""Train, validation and test by a seeded shuffle, and by the head of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def check_ratios(*ratios: float) -> None:
    """Split ratios sum to one."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"split ratios sum to {sum(ratios)}, not 1")


def shuffle_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def global_rank(df: DataFrame, key: str, tie: str) -> DataFrame:
    """`df` with row_no from 1 in the order of (key, tie): ranks within prefixes of the key plus the counts before.

    `key` is a hexadecimal hash, so its first three characters are 4096 even groups; only their counts are
    ranked over the whole table.
    """
    df = df.withColumn("__g", F.substring(key, 1, 3))
    counts = df.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__g", F.coalesce(F.sum("n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__g").orderBy(key, tie))
    return df.withColumn("__r", inside).join(F.broadcast(before), "__g").withColumn("row_no", F.col("__r") + F.col("__before")).drop("__g", "__r", "__before")


def shuffled_split(df: DataFrame, row_id: str, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """(row_id, split): int(n * train) rows, then int(n * validation), then the rest, by the order of a seeded hash (L1)."""
    n = df.count()
    ranked = global_rank(df.select(row_id, shuffle_key(row_id, seed).alias("__k")), "__k", row_id)
    a, b = int(n * train), int(n * train) + int(n * validation)
    return ranked.select(row_id, F.when(F.col("row_no") <= a, "train").when(F.col("row_no") <= b, "validation").otherwise("test").alias("split"))
