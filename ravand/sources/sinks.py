"""Writers of transcripts, data sets and their descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravand.functions.text import fixed2, words

FORMATS = ("parquet", "json", "csv")


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A data set in one folder per split."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode("overwrite").partitionBy("split")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def export_columns(name: Column, text: Column) -> dict[str, Column]:
    """A transcript as plain text, Markdown and JSON."""
    info = F.struct(name.alias("filename"), text.alias("content"), F.size(words(text)).alias("word_count"), F.length(text).alias("character_count"))
    return {"txt": text, "md": F.concat(F.lit("# Transcription: "), name, F.lit("\n\n"), text), "json": F.to_json(info)}


def write_exports(df: DataFrame, name: str, text: str, path: str, formats: tuple[str, ...] = ("txt", "md", "json")) -> None:
    """One folder per format with a row for each transcript."""
    columns = export_columns(F.col(name), F.col(text))
    for fmt in formats:
        df.select(F.col(name), columns[fmt].alias("value")).write.mode("overwrite").parquet(f"{path}/{fmt}")


def speaker_line() -> Column:
    return F.concat(F.lit("[Speaker "), F.col("speaker_id"), F.lit("] ("), fixed2(F.col("start_time")), F.lit("-"), fixed2(F.col("end_time")), F.lit("): "), F.trim("text"))


def write_speaker_lines(segments: DataFrame, path: str) -> None:
    """Labelled lines and the segments as JSON, ordered within each part by start time."""
    ordered = segments.sortWithinPartitions("file_id", "start_time")
    ordered.select(speaker_line().alias("value")).write.mode("overwrite").text(f"{path}/lines")
    ordered.write.mode("overwrite").json(f"{path}/segments")


def dataset_metadata(df: DataFrame, split: str, duration: str, text: str) -> DataFrame:
    """One JSON value with the counts, lengths and durations of each split."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(duration).alias("mean_duration"), F.sum(duration).alias("total_duration"), F.min(F.length(text)).alias("min_length"), F.max(F.length(text)).alias("max_length"))
    return g.select(F.to_json(F.struct(F.col(split).alias("split"), "n", "mean_duration", "total_duration", "min_length", "max_length")).alias("metadata"))


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """`current` with the rows of `updates`, which win over those of the same key (S21). Both have the same columns."""
    return current.join(updates.select(key), key, "left_anti").select(*current.columns).unionByName(updates.select(*current.columns))
