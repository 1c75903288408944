"""Queries of the aggregations, votes and scalar helpers (AG, V, Q5, C, O3), with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from ravand.functions import text as T
from ravand.operators.islands import over_last, with_head, with_previous, with_rank, with_total_before
from ravand.plans.registry import query, table
from ravand.plans.text_queries import s_words
from ravand.session import spread

c, lit, when = F.col, F.lit, F.when


def _e6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5).cast("double")


def _s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)"


_MS = "cast(round(duration * 1000) as bigint)"


@query("ag1_audio_stats", f"select count(*) as n, {_s6(f'avg({_MS})')} as mean_e6, {_s6(f'stddev_pop({_MS})')} as std_e6, min({_MS}) as min_ms, max({_MS}) as max_ms, {_s6(f'sum({_MS}) / 3600000.0e0')} as hours_e6 from chunk_info where duration is not null")
def ag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.round(c("duration") * 1000).cast("bigint")
    return table(spark, sf_dir, "chunk_info").where("duration is not null").agg(F.count(lit(1)).alias("n"), _e6(F.avg(ms)).alias("mean_e6"), _e6(F.stddev_pop(ms)).alias("std_e6"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), _e6(F.sum(ms) / 3600000.0).alias("hours_e6"))


_W = f"len({s_words('text')})"


@query("ag2_text_stats", f"select {_s6('avg(length(text))')} as mean_e6, {_s6('stddev_pop(length(text))')} as std_e6, min(length(text)) as min_length, max(length(text)) as max_length, {_s6(f'avg({_W})')} as words_mean_e6, {_s6(f'stddev_pop({_W})')} as words_std_e6, min({_W}) as min_words, max({_W}) as max_words from documents where text is not null")
def ag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("n"), F.size(T.words(c("text"))).alias("w"))
    return d.agg(_e6(F.avg("n")).alias("mean_e6"), _e6(F.stddev_pop("n")).alias("std_e6"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), _e6(F.avg("w")).alias("words_mean_e6"), _e6(F.stddev_pop("w")).alias("words_std_e6"), F.min("w").alias("min_words"), F.max("w").alias("max_words"))


@query("ag3_split_counts", "select coalesce(split, case when grouping(split) = 1 then 'total' else 'none' end) as split, count(*) as n from asr_manifest group by rollup(split)")
def ag3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "asr_manifest").rollup("split").agg(F.count(lit(1)).alias("n"), F.grouping("split").alias("g"))
    return g.select(F.coalesce("split", when(c("g") == 1, "total").otherwise("none")).alias("split"), "n")


_EXT = "lower(regexp_extract(audio_path, '\\.[^./]*$'))"


@query("ag4_extensions", f"select {_EXT} as extension, count(*) as n, count(*) filter (text is not null) as successful, count(*) filter (text is not null) * 1.0e0 / count(*) as success_rate from asr_manifest group by 1")
def ag4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, and how many have a text (AG4, AG5)."""
    ext = F.lower(F.regexp_extract("audio_path", r"\.[^./]*$", 0)).alias("extension")
    return table(spark, sf_dir, "asr_manifest").groupBy(ext).agg(F.count(lit(1)).alias("n"), F.count("text").alias("successful"), (F.count("text") * 1.0 / F.count(lit(1))).alias("success_rate"))


@query("ag5_augmentation_report", "select count(*) as total, count(*) filter (n > 1) as successful, count(*) filter (n <= 1) as failed, avg(n) as avg_per_file from (select audio_path, count(*) as n from asr_manifest where audio_path is not null group by audio_path)")
def ag5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "asr_manifest").where("audio_path is not null").groupBy("audio_path").agg(F.count(lit(1)).alias("n"))
    return n.agg(F.count(lit(1)).alias("total"), F.count_if(c("n") > 1).alias("successful"), F.count_if(c("n") <= 1).alias("failed"), F.avg("n").alias("avg_per_file"))


@query("ag7_top_word", f"with e as (select doc_id, unnest({s_words('text')}) as w, unnest(range(1, {_W} + 1)) as i from documents), g as (select doc_id, w, count(*) as n, min(i) as first from e group by doc_id, w) select doc_id, arg_max(w, (n, -first)) as word, max(n) as n from g group by doc_id")
def ag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent word of a text, the first seen of equals (AG7)."""
    e = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.words(c("text"))).alias("i", "w"))
    g = e.groupBy("doc_id", "w").agg(F.count(lit(1)).alias("n"), F.min("i").alias("first"))
    return g.groupBy("doc_id").agg(F.max(F.struct("n", (-c("first")).alias("f"), "w")).alias("x")).select("doc_id", c("x.w").alias("word"), c("x.n").alias("n"))


@query("ag8_progress", "select file_id, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'transcribing') as transcribing, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'completed') * 100.0e0 / count(*) as progress from chunk_info group by file_id")
def ag8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {s: F.count_if(c("status") == s) for s in ("completed", "transcribing", "pending", "failed")}
    return table(spark, sf_dir, "chunk_info").groupBy("file_id").agg(*[v.alias(k) for k, v in n.items()], (n["completed"] * 100.0 / F.count(lit(1))).alias("progress"))


_MEM = "(select user_id as host_id, ts, event_id, cast(floor(value * 20e0) as bigint) as used from events)"


def _memory(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(c("user_id").alias("host_id"), "ts", "event_id", F.floor(c("value") * 20.0).cast("bigint").alias("used"), *more)


_TREND = "case when count(*) over w < 2 then 0.0e0 else (last_value(used) over w - first_value(used) over w) / cast(count(*) over w as double) end"


def _last_ten(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Memory samples with the trend and mean of the last ten of their host."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        n = F.count(lit(1)).over(w)
        return {"trend": when(n < 2, 0.0).otherwise((F.last("used").over(w) - F.first("used").over(w)) / n), "avg_usage": when(n < 2, 0.0).otherwise(F.avg("used").over(w)), "samples": n}

    return over_last(_memory(spark, sf_dir, *more), ["host_id"], F.to_date("ts"), ["ts", "event_id"], 10, columns)


@query("ag9_memory_trend", f"select event_id, {_TREND} as trend, case when count(*) over w < 2 then 0.0e0 else avg(used) over w end as avg_usage, count(*) over w as samples from {_MEM} window w as (partition by host_id order by ts, event_id rows between 9 preceding and current row)")
def ag9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend and mean of the last ten samples (AG9)."""
    return _last_ten(spark, sf_dir).select("event_id", "trend", "avg_usage", "samples")


@query("ag10_ring_buffer", f"select event_id from (select event_id, row_number() over (partition by host_id order by ts desc, event_id desc) as r from {_MEM}) where r <= 100")
def ag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred samples of each host (AG10), by their place and the host's count."""
    return with_rank(_memory(spark, sf_dir), ["host_id"], F.to_date("ts"), ["ts", "event_id"], "r", "n").where("n - r < 100").select("event_id")


@query("ag11_memory_level", f"select event_id, case when used > 3072 then 'emergency' when used > 2048 then 'critical' when used > 1024 then 'warning' else 'normal' end as level, used > 2048 * 0.8e0 as too_large, least(512.0e0, 2048 * 0.3e0) as tightened from {_MEM}")
def ag11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of a memory sample, whether it fits, the tightened threshold (AG11, AG18)."""
    u = c("used")
    return _memory(spark, sf_dir).select("event_id", when(u > 3072, "emergency").when(u > 2048, "critical").when(u > 1024, "warning").otherwise("normal").alias("level"), (u > 2048 * 0.8).alias("too_large"), F.least(lit(512.0), lit(2048 * 0.3)).alias("tightened"))


def needs_cleanup(used: Column, seconds_since: Column, cleanups: Column, trend: Column, threshold_mb: int = 512, interval_seconds: int = 30) -> Column:
    """Whether memory is to be cleaned up (AG13): over the threshold, the interval gone by, never cleaned up yet, or a trend of over 50 MB a sample."""
    return (used > threshold_mb) | F.coalesce(seconds_since > interval_seconds, lit(False)) | (cleanups == 0) | (trend > 50)


@query(
    "ag13_should_cleanup",
    f"""with m as (select host_id, ts, event_id, used, {_TREND} as trend, count(*) filter (event_type = 'click') over before as cleanups, max(case when event_type = 'click' then ts end) over before as last_one
                   from (select user_id as host_id, ts, event_id, event_type, cast(floor(value * 20e0) as bigint) as used from events)
                   window w as (partition by host_id order by ts, event_id rows between 9 preceding and current row), before as (partition by host_id order by ts, event_id rows between unbounded preceding and 1 preceding))
        select event_id, used > 512 or coalesce(epoch_us(ts) - epoch_us(last_one) > 30000000, false) or cleanups = 0 or trend > 50 as should_cleanup from m""",
)
def ag13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sample calls for a clean-up; the clean-ups of a host are its clicks before."""
    m = _last_ten(spark, sf_dir, "event_type").withColumn("day", F.to_date("ts"))
    click = c("event_type") == "click"
    order = ["ts", "event_id"]
    m = with_total_before(m, ["host_id"], "day", order, click.cast("bigint"), "clicks").withColumn("cleanups", c("clicks") - click.cast("bigint"))
    m = with_previous(with_head(m, ["host_id"], "day", order, click), ["host_id"], "day", order, {"last_one": "head"})
    since = (F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(c("last_one.ts").cast("timestamp"))) / 1e6
    return m.select("event_id", needs_cleanup(c("used"), since, c("cleanups"), c("trend")).alias("should_cleanup"))


@query("ag12_thresholds", "select o_orderkey, case when m < 4096 then m * 0.3e0 when m < 8192 then 1024.0e0 else 2048.0e0 end as warning, case when m < 4096 then m * 0.5e0 when m < 8192 then 2048.0e0 else 4096.0e0 end as critical, case when m < 4096 then m * 0.7e0 when m < 8192 then 3072.0e0 else 6144.0e0 end as emergency, case when m < 4096 then m * 0.2e0 when m < 8192 then 512.0e0 else 1024.0e0 end as cleanup from (select o_orderkey, cast(floor(o_totalprice / 32) as bigint) as m from orders)")
def ag12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by total memory (AG12)."""
    m = F.floor(c("o_totalprice") / 32).cast("bigint")
    tier = lambda share, mid, high: when(m < 4096, m * share).when(m < 8192, mid).otherwise(high)
    return table(spark, sf_dir, "orders").select("o_orderkey", tier(0.3, 1024.0, 2048.0).alias("warning"), tier(0.5, 2048.0, 4096.0).alias("critical"), tier(0.7, 3072.0, 6144.0).alias("emergency"), tier(0.2, 512.0, 1024.0).alias("cleanup"))


@query(
    "ag14_performance",
    f"""with g as (select host_id, cast(date_diff('second', min(ts), max(ts)) as double) as duration, count(*) as chunks, sum(used) as mem, count(*) * 20.0e0 as audio, cast(sum(event_id % 100) as double) / count(*) as cpu from {_MEM} group by host_id),
             s as (select *, case when duration = 0 then 0.0e0 else chunks / duration end as chunks_per_second, case when duration = 0 then 0.0e0 else audio / duration end as speedup, mem / cast(chunks as double) as avg_memory from g)
        select host_id, duration, chunks_per_second, speedup, avg_memory, case when duration = 0 then 0.0e0 else {_s6("least(100.0e0, speedup * 10) * 0.5e0 + greatest(0.0e0, 100 - avg_memory / 100) * 0.3e0 + (100 - abs(cpu - 80)) * 0.2e0")} end as efficiency_e6 from s""",
)
def ag14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, memory and efficiency of a run (AG14, AG15)."""
    g = _memory(spark, sf_dir).groupBy("host_id").agg(F.timestamp_diff("SECOND", F.date_trunc("second", F.min("ts")), F.date_trunc("second", F.max("ts"))).cast("double").alias("duration"), F.count(lit(1)).alias("chunks"), F.sum("used").alias("mem"), (F.sum(c("event_id") % 100).cast("double") / F.count(lit(1))).alias("cpu"))
    none = c("duration") == 0
    s = g.select("host_id", "duration", when(none, 0.0).otherwise(c("chunks") / c("duration")).alias("chunks_per_second"), when(none, 0.0).otherwise(c("chunks") * 20.0 / c("duration")).alias("speedup"), (c("mem") / c("chunks")).alias("avg_memory"), "cpu")
    score = F.least(lit(100.0), c("speedup") * 10) * 0.5 + F.greatest(lit(0.0), 100 - c("avg_memory") / 100) * 0.3 + (100 - F.abs(c("cpu") - 80)) * 0.2
    return s.select("host_id", "duration", "chunks_per_second", "speedup", "avg_memory", when(none, 0.0).otherwise(_e6(score)).alias("efficiency_e6"))


@query("ag16_capabilities", "select o_custkey, count(*) filter (o_orderstatus <> 'F' and o_orderkey % 3 = 0) = 0 as success, string_agg(case when o_orderstatus <> 'F' and o_orderkey % 3 = 0 then cast(o_orderkey as varchar) end, ',' order by o_orderkey) as errors, count(*) filter (o_orderstatus <> 'F' and o_orderkey % 3 <> 0) as warnings from orders group by o_custkey")
def ag16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success where no required capability is missing; errors and warnings otherwise (AG16)."""
    missing, required = c("o_orderstatus") != "F", c("o_orderkey") % 3 == 0
    errors = F.array_sort(F.collect_list(when(missing & required, c("o_orderkey"))))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count_if(missing & required) == 0).alias("success"), errors.alias("e"), F.count_if(missing & ~required).alias("warnings"))
    return g.select("o_custkey", "success", when(F.size("e") > 0, F.array_join(F.transform("e", lambda x: x.cast("string")), ",")).alias("errors"), "warnings")


# Models with their weights, and the weights without the third one.
WITHOUT_THIRD = {"whisper": 0.6, "wav2vec2": 0.4}
MODELS = (("whisper", 0, 0.4), ("wav2vec2", 1, 0.3), ("fastconformer", 2, 0.3))
_VOTES = """(select doc_id as utt_id, m.model, m.priority, m.weight, case when doc_id % 7 = 2 or (doc_id % 7 <= 1 and m.priority >= 1) or (doc_id + m.priority) % 4 = 0 then ' ' else m.model || cast(doc_id as varchar) end as text, ((doc_id * 37 + m.priority * 11) % 100) / 100e0 as confidence
             from documents cross join (values ('whisper', 0, 0.4e0), ('wav2vec2', 1, 0.3e0), ('fastconformer', 2, 0.3e0)) as m(model, priority, weight))"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.explode(F.array(*[F.struct(lit(n).alias("model"), lit(p).alias("priority"), lit(w).alias("weight")) for n, p, w in MODELS]))
    v = table(spark, sf_dir, "documents").select(c("doc_id").alias("utt_id"), m.alias("m")).select("utt_id", "m.*")
    i, p = c("utt_id"), c("priority")
    blank = (i % 7 == 2) | ((i % 7 <= 1) & (p >= 1)) | ((i + p) % 4 == 0)
    return v.select("utt_id", "model", "priority", "weight", when(blank, " ").otherwise(F.concat("model", i.cast("string"))).alias("text"), (((i * 37 + p * 11) % 100) / 100.0).alias("confidence"))


@query(
    "v1_ensemble_vote",
    f"""with v as (select *, count(*) over (partition by utt_id) as n, row_number() over (partition by utt_id order by weight * confidence desc, priority) as r from {_VOTES} where trim(text) <> '')
        select u.utt_id, coalesce(v.text, '') as text, coalesce(case when n = 1 then confidence else weight * confidence end, 0.0e0) as confidence from (select distinct utt_id from {_VOTES}) u left join v on u.utt_id = v.utt_id and r = 1""",
)
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_votes(spark, sf_dir))


def _best(votes: DataFrame) -> DataFrame:
    """Best of the results that are not blank by weight times confidence, the first of equals; a single one keeps its own confidence (V1, O3)."""
    ok = F.trim("text") != ""
    g = votes.groupBy("utt_id").agg(F.count_if(ok).alias("n"), F.max(when(ok, F.struct((c("weight") * c("confidence")).alias("s"), (-c("priority")).alias("p"), "text", "confidence"))).alias("b"))
    return g.select("utt_id", F.coalesce("b.text", lit("")).alias("text"), F.coalesce(when(c("n") == 1, c("b.confidence")).otherwise(c("b.s")), lit(0.0)).alias("confidence"))


@query(
    "v3_missing_model",
    f"""with v as (select utt_id, model, priority, text, confidence, case when utt_id % 2 = 0 then weight when model = 'whisper' then 0.6e0 else 0.4e0 end as weight from {_VOTES} where utt_id % 2 = 0 or model <> 'fastconformer'),
             k as (select *, count(*) over (partition by utt_id) as n, row_number() over (partition by utt_id order by weight * confidence desc, priority) as r from v where trim(text) <> '')
        select u.utt_id, coalesce(k.text, '') as text, coalesce(case when n = 1 then confidence else weight * confidence end, 0.0e0) as confidence from (select distinct utt_id from v) u left join k on u.utt_id = k.utt_id and r = 1""",
)
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote where the third model could not be loaded for every other utterance: the first two weigh 0.6 and 0.4 then (V3)."""
    third = c("utt_id") % 2 == 0
    fallback = F.create_map(*[x for n, w in WITHOUT_THIRD.items() for x in (lit(n), lit(w))])
    v = _votes(spark, sf_dir).withColumn("weight", when(third, c("weight")).otherwise(F.try_element_at(fallback, c("model"))))
    return _best(v.where("weight is not null"))


@query("v2_ensemble_metadata", f"select utt_id, string_agg(model || '=' || printf('%.2f', confidence), ',' order by priority) as confidences, count(*) filter (trim(text) <> '') as n_results from {_VOTES} group by utt_id")
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of all models as a map, written in order of the models (V2)."""
    g = _votes(spark, sf_dir).groupBy("utt_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "confidence"))).alias("m"), F.count_if(F.trim("text") != "").alias("n_results"))
    line = F.concat_ws(",", *[F.concat(lit(n + "="), T.fixed2(F.try_element_at("m", lit(n)))) for n, _, _ in MODELS])
    return g.select("utt_id", line.alias("confidences"), "n_results")


@query("q05_confidence", f"select utt_id, {_s6('sum(confidence * weight) / sum(weight)')} as confidence_e6 from {_VOTES} group by utt_id")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted confidence over the weights of all models (Q5)."""
    return _votes(spark, sf_dir).groupBy("utt_id").agg(_e6(F.sum(c("confidence") * c("weight")) / F.sum("weight")).alias("confidence_e6"))


_S = "cast(floor(start_time) as bigint)"


@query("c7_format_time", f"select row_id, cast({_S} // 3600 as varchar) || ':' || lpad(cast({_S} % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast({_S} % 60 as varchar), 2, '0') as clock, case when duration < 60 then printf('%.2f', duration) || 's' when duration < 3600 then printf('%.1f', duration / 60) || 'm' else printf('%.1f', duration / 3600) || 'h' end as lasted from chunk_info where start_time >= 0 and start_time < 86400 and duration is not null")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock time and duration with its unit."""
    s = F.floor("start_time").cast("bigint")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    clock = F.concat(F.floor(s / 3600).cast("string"), lit(":"), two(F.floor(s % 3600 / 60)), lit(":"), two(s % 60))
    one = lambda x, unit: F.concat(F.replace(F.format_number(x, 1), lit(","), lit("")), lit(unit))
    d = c("duration")
    lasted = when(d < 60, F.concat(T.fixed2(d), lit("s"))).when(d < 3600, one(d / 60, "m")).otherwise(one(d / 3600, "h"))
    return table(spark, sf_dir, "chunk_info").where("start_time >= 0 and start_time < 86400 and duration is not null").select("row_id", clock.alias("clock"), lasted.alias("lasted"))


@query("c8_progress_bar", "select row_id, case when status = 'transcribing' then repeat('█', cast(floor(least(greatest(progress, 0), 1) * 10) as int)) || repeat('░', 10 - cast(floor(least(greatest(progress, 0), 1) * 10) as int)) else '' end as bar from chunk_info where progress is not null")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.least(F.greatest("progress", lit(0.0)), lit(1.0)) * 10).cast("int")
    return table(spark, sf_dir, "chunk_info").where("progress is not null").select("row_id", when(c("status") == "transcribing", F.concat(F.repeat(lit("█"), n), F.repeat(lit("░"), 10 - n))).otherwise("").alias("bar"))


@query("c9_display_mode", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'rtl_rich' when o_orderkey % 2 = 0 then 'rtl_plain' when o_orderkey % 3 = 0 then 'ltr_rich' when o_orderkey % 5 = 0 then 'ltr_plain' else 'fallback' end as mode from orders")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display mode from three capabilities."""
    rtl, rich, uni = (c("o_orderkey") % k == 0 for k in (2, 3, 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", when(rtl & rich, "rtl_rich").when(rtl, "rtl_plain").when(rich, "ltr_rich").when(uni, "ltr_plain").otherwise("fallback").alias("mode"))
