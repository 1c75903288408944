"""Audio files and transcripts joined by file stem: the exact stem, else one stem inside the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts_of(stem: Column, lengths: list[int]) -> Column:
    """All distinct parts of a stem that have one of the lengths."""
    n = F.length(stem)
    fit = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= n)
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(stem, i, k)))))


def lengths_of(stems: DataFrame, column: str) -> list[int]:
    """The lengths that stems have; file systems bound them, so they are few."""
    return sorted(r[0] for r in stems.select(F.length(column)).distinct().collect())


def match_stems(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(audio_id, transcript_id, kind) of the first transcript of each audio file.

    `audio` has audio_id and stem, `transcripts` transcript_id and stem. `exact` where a stem is the same; only
    the files left over are matched by containment, either way round, the first by transcript_id. Containment is
    an equi-join of the longer stem's parts with the shorter one, so nothing is compared pair by pair; only parts
    of lengths that the other side has are made, as many for each of them as the stem has places.
    """
    a, t = audio.select("audio_id", F.col("stem").alias("s")).where("s is not null and s <> ''"), transcripts.select("transcript_id", "stem").where("stem is not null and stem <> ''")
    exact = a.join(t, F.col("s") == F.col("stem")).groupBy("audio_id").agg(F.min("transcript_id").alias("transcript_id"))
    rest = a.join(exact, "audio_id", "left_anti")
    inside_audio = rest.select("audio_id", F.explode(parts_of(F.col("s"), lengths_of(t, "stem"))).alias("stem")).join(t, "stem").select("audio_id", "transcript_id")
    inside_text = t.select("transcript_id", F.explode(parts_of(F.col("stem"), lengths_of(rest, "s"))).alias("s")).join(rest, "s").select("audio_id", "transcript_id")
    loose = inside_audio.unionByName(inside_text).groupBy("audio_id").agg(F.min("transcript_id").alias("transcript_id"))
    return exact.withColumn("kind", F.lit("exact")).unionByName(loose.withColumn("kind", F.lit("contains")))
