"""Queries of the general data-preparation operators (rejects, periods)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravand.operators.periods import periods_and_gaps
from ravand.operators.rejects import load_manifest
from ravand.plans.registry import query, table


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_manifest(table(spark, sf_dir, "manifest_raw")).where("reason is not null").select("line_id", "reason")


@query("p1_loaded")
def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_manifest(table(spark, sf_dir, "manifest_raw")).where("reason is null").drop("reason")


def _periods_sql(name: str, keys: str, speaker: str) -> str:
    return f"""
      select '{name}' as table_name, file_id, {speaker} as speaker_id, kind, start_ms, end_ms from (
        with r as (select {keys}, cast(round(start_time * 1000) as bigint) as s, max(cast(round(end_time * 1000) as bigint)) as e
                   from {name} where end_time > start_time and isfinite(start_time) and isfinite(end_time) group by {keys}, cast(round(start_time * 1000) as bigint)),
             m as (select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as before from r),
             i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by {keys} order by s, e rows between unbounded preceding and current row) as island from m),
             p as (select {keys}, island, min(s) as s, max(e) as e from i group by {keys}, island),
             g as (select *, lag(e) over (partition by {keys} order by island) as last_end from p)
        select {keys}, 'period' as kind, s as start_ms, e as end_ms from g
        union all
        select {keys}, 'gap', last_end, s from g where s - last_end <= 600000)
      where file_id is not null{"" if speaker == "''" else " and speaker_id is not null"}"""


@query("p4_found", _periods_sql("chunk_info", "file_id", "''") + " union all " + _periods_sql("speaker_segment", "file_id, speaker_id", "speaker_id"))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = periods_and_gaps(table(spark, sf_dir, "chunk_info"), ["file_id"], "start_time", "end_time").withColumn("speaker_id", F.lit(""))
    segments = periods_and_gaps(table(spark, sf_dir, "speaker_segment"), ["file_id", "speaker_id"], "start_time", "end_time")
    both = chunks.withColumn("table_name", F.lit("chunk_info")).unionByName(segments.withColumn("table_name", F.lit("speaker_segment")))
    return both.select("table_name", "file_id", "speaker_id", "kind", "start_ms", "end_ms")
