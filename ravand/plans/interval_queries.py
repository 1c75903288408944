"""Queries of the interval and sequence operators (I), with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravand.functions import chunks
from ravand.operators.islands import keep_islands, merge_gaps, speech_islands
from ravand.plans.registry import query, table

T_MS, O_MS = 20_000, 200
STEP = T_MS - O_MS
DURATIONS = "(select o_orderkey as file_id, cast(floor(o_totalprice) as bigint) as d from orders)"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.floor("o_totalprice").cast("bigint").alias("d"))


def planned(name: str, plan, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return durations(spark, sf_dir).select("file_id", F.posexplode(plan(F.col("d"))).alias("chunk_index", "x")).select("file_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "x.start_ms", "x.end_ms")

    query(name, sql)(run)


@query("i01_total_chunks", f"select file_id, case when d <= 0 then 0 when d <= {T_MS} then 1 else (d - {T_MS} + {STEP - 1}) // {STEP} + 1 end as total, greatest(1, d // {STEP}) as estimated from {DURATIONS}")
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts and the estimate."""
    d = F.col("d")
    return durations(spark, sf_dir).select("file_id", chunks.total_chunks(d, T_MS, O_MS).alias("total"), chunks.estimated(d, T_MS, O_MS).alias("estimated"))


planned("i02_boundaries", lambda d: chunks.boundaries(d, T_MS, O_MS), f"with s as (select file_id, d, unnest(case when d <= {T_MS} then [0] else range(0, d, {STEP}) end) as s from {DURATIONS} where d > 0) select file_id, row_number() over (partition by file_id order by s) - 1 as chunk_index, s as start_ms, least(s + {T_MS}, d) as end_ms from s")
planned("i03_left_extended", lambda d: chunks.left_extended(d, T_MS, O_MS), f"with s as (select file_id, d, unnest(range(0, d, {T_MS})) as s from {DURATIONS} where d > 0) select file_id, s // {T_MS} as chunk_index, greatest(0, s - {O_MS}) as start_ms, least(s + {T_MS}, d) as end_ms from s")
planned(
    "i04_smart_chunks",
    lambda d: chunks.smart(F.lit(0), d, T_MS, O_MS),
    f"with recursive c as (select file_id, d, 0 as k, 0::bigint as s, least({T_MS}, d) as e from {DURATIONS} union all select file_id, d, k + 1, e - {O_MS}, least(e - {O_MS} + {T_MS}, d) from c where d > {T_MS} and e - {O_MS} < d and d - (e - {O_MS}) >= {T_MS} * 0.3) select file_id, k as chunk_index, s as start_ms, e as end_ms from c",
)
planned(
    "i05_fallback_chunks",
    lambda d: chunks.fallback(d, T_MS, O_MS),
    f"with recursive c as (select file_id, d, 0 as k, 0::bigint as s, least({T_MS}, d) as e from {DURATIONS} where d > 0 union all select file_id, d, k + 1, e - {O_MS}, least(e - {O_MS} + {T_MS}, d) from c where e < d) select file_id, k as chunk_index, s as start_ms, e as end_ms from c",
)


def _gap_sql(gap: str) -> str:
    return f"""
      with r as (select * from speaker_segment where file_id is not null and speaker_id is not null and start_time is not null and end_time is not null),
           p as (select *, lag(end_time) over (partition by file_id, speaker_id order by start_time, seg_id) as prev_end from r),
           g as (select *, sum(case when prev_end is null or not (start_time - prev_end < {gap}) then 1 else 0 end) over (partition by file_id, speaker_id order by start_time, seg_id) as g from p)
      select file_id, speaker_id, arg_min(start_time, (start_time, seg_id)) as start_time, arg_max(end_time, (start_time, seg_id)) as end_time, min(confidence) as confidence, count(*) as n_segments from g group by file_id, speaker_id, g"""


@query("i07_gap_merge", _gap_sql("3.0e0"))
def i07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_gaps(table(spark, sf_dir, "speaker_segment"), ["file_id", "speaker_id"], gap=3.0)


@query("i07_gap_merge_short", _gap_sql("2.0e0"))
def i07b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_gaps(table(spark, sf_dir, "speaker_segment"), ["file_id", "speaker_id"], gap=2.0)


FRAMES = "(select user_id as file_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_no, value > 60e0 as is_speech from events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 30 ms from the events of each user."""
    table(spark, sf_dir, "events").createOrReplaceTempView("ravand_events")
    return spark.sql(f"select * from {FRAMES.replace('events', 'ravand_events')}")


_ISLANDS = f"""f as (select * from {FRAMES}), b as (select *, lag(is_speech) over (partition by file_id order by frame_no) as before from f),
      g as (select *, sum(case when is_speech and not coalesce(before, false) then 1 else 0 end) over (partition by file_id order by frame_no) as g from b),
      i as (select file_id, min(frame_no) * 30 as start_ms, (max(frame_no) + 1) * 30 as end_ms from g where is_speech group by file_id, g)"""


@query("i08_speech_islands", f"with {_ISLANDS} select * from i")
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech_islands(frames(spark, sf_dir))


def kept(name: str, gap_ms: int, least_ms: int) -> None:
    sql = f"""with {_ISLANDS}, p as (select *, lag(end_ms) over (partition by file_id order by start_ms) as pe from i), h as (select *, sum(case when pe is null or start_ms - pe >= {gap_ms} then 1 else 0 end) over (partition by file_id order by start_ms) as h from p),
        m as (select file_id, min(start_ms) as start_ms, max(end_ms) as end_ms from h group by file_id, h having max(end_ms) - min(start_ms) >= {least_ms})
        select * from m union all select file_id, 0, (max(frame_no) + 1) * 30 from f where file_id not in (select file_id from m) group by file_id"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = frames(spark, sf_dir)
        return keep_islands(speech_islands(f), f.groupBy("file_id").agg(((F.max("frame_no") + 1) * 30).alias("length_ms")), gap_ms, least_ms)

    query(name, sql)(run)


kept("i09_kept_islands", 500, 1000)
kept("i09_small_gaps", 90, 600)


@query("i11_coverage", "select file_id, floor(sum(cast(round((end_time - start_time) * 1000) as bigint)) * 100.0e0 / max(cast(round(end_time * 1000) as bigint)) * 1e6 + 0.5) as coverage_e6, sum(cast(round((end_time - start_time) * 1000) as bigint)) * 100.0e0 / max(cast(round(end_time * 1000) as bigint)) < 20 as use_fallback from speaker_segment where end_time > start_time group by file_id")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a file that its segments cover, overlaps counted twice; under 20 per cent falls back."""
    ms = lambda c: F.round(c * 1000).cast("bigint")
    g = table(spark, sf_dir, "speaker_segment").where("end_time > start_time").groupBy("file_id").agg((F.sum(ms(F.col("end_time") - F.col("start_time"))) * 100.0 / F.max(ms(F.col("end_time")))).alias("c"))
    return g.select("file_id", F.floor(F.col("c") * 1e6 + 0.5).cast("double").alias("coverage_e6"), (F.col("c") < 20).alias("use_fallback"))


@query("i14_positive_chunks", "select row_id, duration from chunk_info where end_time - start_time > 0")
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_info").where("end_time - start_time > 0").select("row_id", "duration")


@query("i15_time_estimate", "select row_id, (progress * 1000.0e0) / 10 as start_estimate, ((progress * 10 + 1) / 10) * 1000.0e0 as end_estimate from chunk_info where progress is not null")
def i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a chunk estimated from its share of the whole."""
    p = F.col("progress")
    return table(spark, sf_dir, "chunk_info").where("progress is not null").select("row_id", ((p * 1000.0) / 10).alias("start_estimate"), (((p * 10 + 1) / 10) * 1000.0).alias("end_estimate"))
