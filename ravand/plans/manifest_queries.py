"""Queries of the manifest operators: scans and sinks as values (S), projections (P), filters (F), joins (J), splits (L), order (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravand.functions import text as T
from ravand.operators.islands import with_rank
from ravand.operators.split import shuffled_split
from ravand.operators.stems import match_stems
from ravand.plans.registry import query, table
from ravand.plans.text_queries import s_strip, s_words

c, lit, when = F.col, F.lit, F.when


@query("s06_transcript_text", f"""with j as (select doc_id, case when doc_id % 5 = 0 then json_object('text', text) when doc_id % 5 = 1 then json_object('transcript', text) when doc_id % 5 = 2 then json_object('caption', text, 'text', null) when doc_id % 5 = 3 then json_object('caption', text) else json_object('other', 1) end as j from documents where text is not null)
       select doc_id, {s_strip("case when json_exists(j, '$.text') then j->>'$.text' when json_exists(j, '$.transcript') then j->>'$.transcript' when json_exists(j, '$.caption') then j->>'$.caption' else '' end")} as text from j""")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a JSON transcript: text, else transcript, else caption; a present null stays null."""
    t = c("text")
    d = table(spark, sf_dir, "documents").where("text is not null")
    keep = {"ignoreNullFields": "false"}
    j = when(c("doc_id") % 5 == 0, F.to_json(F.struct(t.alias("text")))).when(c("doc_id") % 5 == 1, F.to_json(F.struct(t.alias("transcript")))).when(c("doc_id") % 5 == 2, F.to_json(F.struct(t.alias("caption"), lit(None).cast("string").alias("text")), keep)).when(c("doc_id") % 5 == 3, F.to_json(F.struct(t.alias("caption")))).otherwise(lit('{"other":1}'))
    keys = F.json_object_keys("j")
    found = when(F.array_contains(keys, "text"), F.get_json_object("j", "$.text")).when(F.array_contains(keys, "transcript"), F.get_json_object("j", "$.transcript")).when(F.array_contains(keys, "caption"), F.get_json_object("j", "$.caption")).otherwise("")
    return d.select("doc_id", j.alias("j")).select("doc_id", T.strip(found).alias("text"))


@query("s08_materialize_counts", f"select dataset, split, count(*) filter ({s_strip('text')} <> '' and audio_path is not null) as written, count(*) filter (not coalesce({s_strip('text')} <> '' and audio_path is not null, false)) as skipped from asr_manifest group by dataset, split")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a split writes and skips."""
    ok = F.coalesce((T.strip(c("text")) != "") & c("audio_path").isNotNull(), lit(False))
    return table(spark, sf_dir, "asr_manifest").groupBy("dataset", "split").agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"))


@query("s13_exports", f"""select doc_id, '# Transcription: doc_' || doc_id || chr(10) || chr(10) || text as md, '{{"filename":"doc_' || doc_id || '","word_count":' || len({s_words("text")}) || ',"character_count":' || length(text) || '}}' as json from documents where text is not null""")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown and JSON forms of a transcript."""
    name = F.concat(lit("doc_"), c("doc_id").cast("string"))
    info = F.to_json(F.struct(name.alias("filename"), F.size(T.words(c("text"))).alias("word_count"), F.length("text").alias("character_count")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(lit("# Transcription: "), name, lit("\n\n"), c("text")).alias("md"), info.alias("json"))


@query("s15_file_info", f"select doc_id, text is not null and text <> '' as exists, coalesce(octet_length(encode(text)), 0) as bytes, coalesce(length(text), 0) as chars, coalesce(len({s_words('text')}), 0) as words from documents")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = lambda x: F.coalesce(x, lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", (c("text").isNotNull() & (c("text") != "")).alias("exists"), z(F.octet_length("text")).alias("bytes"), z(F.length("text")).alias("chars"), z(F.size(T.words(c("text")))).alias("words"))


_VERSIONS = "select dataset, rec_id % 3 as version, count(*) as num_items, max(rec_id) as last_id from asr_manifest where dataset is not null group by dataset, rec_id % 3"


@query("s21_upsert", f"select dataset, version, num_items, (select count(distinct dataset) from asr_manifest) as total_datasets from (select *, row_number() over (partition by dataset order by version desc, last_id desc) as r from ({_VERSIONS})) where r = 1")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry for each key, and how many keys there are."""
    v = table(spark, sf_dir, "asr_manifest").where("dataset is not null").groupBy("dataset", (c("rec_id") % 3).alias("version")).agg(F.count(lit(1)).alias("num_items"), F.max("rec_id").alias("last_id"))
    latest = v.groupBy("dataset").agg(F.max(F.struct("version", "last_id", "num_items")).alias("x"))
    return latest.select("dataset", "x.version", "x.num_items").crossJoin(F.broadcast(latest.agg(F.count(lit(1)).alias("total_datasets"))))


@query("s22_registry_stats", "select count(*) as total, count(split_column) as with_split, count(*) filter (train_ratio >= 0.8) as large_train, sum(sampling_rate) as rates from dataprep_config")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataprep_config").agg(F.count(lit(1)).alias("total"), F.count("split_column").alias("with_split"), F.count_if(c("train_ratio") >= 0.8).alias("large_train"), F.sum("sampling_rate").alias("rates"))


def s_filled(t: str) -> str:
    return f"nullif({s_strip(t)}, '')"


@query("pr2_select_text", f"select rec_id, coalesce({s_filled('text')}, {s_filled('uid')}, {s_filled('audio_path')}) as text from asr_manifest")
def pr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field that is not blank, stripped."""
    b = lambda x: F.nullif(T.strip(c(x)), lit(""))
    return table(spark, sf_dir, "asr_manifest").select("rec_id", F.coalesce(b("text"), b("uid"), b("audio_path")).alias("text"))


@query("pr3_uid_chain", "select rec_id, coalesce(nullif(uid, ''), nullif(audio_path, ''), cast(row_number() over (partition by dataset order by rec_id) - 1 as varchar)) as uid from asr_manifest where dataset is not null")
def pr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uid, else the path, else the row's place in its dataset."""
    rows = with_rank(table(spark, sf_dir, "asr_manifest").where("dataset is not null"), ["dataset"], F.floor(c("rec_id") / 100_000), ["rec_id"])
    place = (c("row_no") - 1).cast("string")
    return rows.select("rec_id", F.coalesce(F.nullif("uid", lit("")), F.nullif("audio_path", lit("")), place).alias("uid"))


@query("pr4_prefix", "select rec_id, '/data/root' || '/' || audio_path as path, coalesce(text, '') as text, 'fa' as language from asr_manifest where audio_path is not null")
def pr4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root prefix, null text as empty, literal language."""
    return table(spark, sf_dir, "asr_manifest").where("audio_path is not null").select("rec_id", F.concat_ws("/", lit("/data/root"), "audio_path").alias("path"), F.coalesce("text", lit("")).alias("text"), lit("fa").alias("language"))


@query("pr6_nonblank", f"select row_id, {s_strip('text')} as text from chunk_info where {s_strip('text')} <> ''")
def pr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_info").select("row_id", T.strip(c("text")).alias("text")).where("text <> ''")


@query("f01_duration_range", "select row_id, duration from chunk_info where duration between 1.0 and 15.0")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_info").where(c("duration").between(1.0, 15.0)).select("row_id", "duration")


@query("f02_audio_valid", "select doc_id, n_chars / 200e0 as duration, n_chars * 40 as file_size from documents where n_chars / 200e0 between 1 and 30 and n_chars * 40 between 1024 and 104857600")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration and size within bounds, both ends included (F2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", (c("n_chars") / 200.0).alias("duration"), (c("n_chars") * 40).alias("file_size"))
    return d.where("duration between 1 and 30 and file_size between 1024 and 104857600")


@query("f03_text_valid", "select doc_id, left(text, 500) as text, case when length(text) < 3 then '' else left(text, 1000) end as normalizer_text from documents where length(text) >= 3")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three characters or more, cut to 500; the normaliser's bound of 1000."""
    return table(spark, sf_dir, "documents").where(F.length("text") >= 3).select("doc_id", F.substring("text", 1, 500).alias("text"), T.bounded_text(c("text")).alias("normalizer_text"))


@query("f05_peak_guard", "select vec_id from embeddings where list_max(list_transform(embedding, lambda x: abs(x))) <= 0.3 and len(embedding) between 16 and 1024")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where((F.array_max(F.transform("embedding", F.abs)) <= 0.3) & F.size("embedding").between(16, 1024)).select("vec_id")


@query("f06_split_filter", "select rec_id from asr_manifest where split = 'train'")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asr_manifest").where("split = 'train'").select("rec_id")


STEM = "'audio_' || lpad(cast({0} as varchar), 6, '0')"
_TRANSCRIPTS = f"(select item_id as transcript_id, case when item_id % 3 = 0 then {STEM.format('item_id')} when item_id % 3 = 1 then 'transcript_' || {STEM.format('item_id')} else 'other_' || lpad(cast(item_id as varchar), 6, '0') end as stem from eval_items)"


def _stem(x) -> F.Column:
    return F.concat(lit("audio_"), F.lpad(x.cast("string"), 6, "0"))


@query(
    "j01_stem_join",
    f"""with a as (select doc_id as audio_id, {STEM.format("doc_id")} as stem from documents), t as (select * from {_TRANSCRIPTS}),
             e as (select audio_id, min(transcript_id) as transcript_id from a join t using (stem) group by audio_id),
             l as (select audio_id, min(transcript_id) as transcript_id from a join t on contains(a.stem, t.stem) or contains(t.stem, a.stem) where audio_id not in (select audio_id from e) group by audio_id)
        select *, 'exact' as kind from e union all select *, 'contains' from l""",
)
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = table(spark, sf_dir, "documents").select(c("doc_id").alias("audio_id"), _stem(c("doc_id")).alias("stem"))
    i = c("item_id")
    stem = when(i % 3 == 0, _stem(i)).when(i % 3 == 1, F.concat(lit("transcript_"), _stem(i))).otherwise(F.concat(lit("other_"), F.lpad(i.cast("string"), 6, "0")))
    return match_stems(audio, table(spark, sf_dir, "eval_items").select(i.alias("transcript_id"), stem.alias("stem")))


@query(
    "j04_data_pairs",
    f"""select doc_id, item_id, d.n_chars / 200e0 as duration, left(i.text, 500) as transcript from documents d join eval_items i on {STEM.format("doc_id")} = {STEM.format("item_id")}
        where d.n_chars / 200e0 between 1 and 30 and d.n_chars * 40 between 1024 and 104857600 and length(i.text) >= 3""",
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid audio with valid transcripts of the same stem (J4 over F2, F3)."""
    a = table(spark, sf_dir, "documents").where("n_chars / 200.0 between 1 and 30 and n_chars * 40 between 1024 and 104857600").select("doc_id", _stem(c("doc_id")).alias("stem"), (c("n_chars") / 200.0).alias("duration"))
    t = table(spark, sf_dir, "eval_items").where("length(text) >= 3").select("item_id", _stem(c("item_id")).alias("stem"), F.substring("text", 1, 500).alias("transcript"))
    return a.join(t, "stem").select("doc_id", "item_id", "duration", "transcript")


@query("j05_zip_labels", "select vec_id, i, embedding[i] as x, (label + i) % 3 as speaker from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences zipped by position."""
    labels = F.transform(F.sequence(lit(1), F.size("embedding")), lambda i: (c("label") + i) % 3)
    z = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(c("embedding").alias("x"), labels.alias("speaker"))).alias("p", "z"))
    return z.select("vec_id", (c("p") + 1).cast("bigint").alias("i"), c("z.x").alias("x"), c("z.speaker").cast("bigint").alias("speaker"))


@query("l01_shuffled_split", "with r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= cast(floor(n * 0.8e0) as bigint) then 'train' when r <= cast(floor(n * 0.8e0) as bigint) + cast(floor(n * 0.1e0) as bigint) then 'validation' else 'test' end as split from r")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_split(table(spark, sf_dir, "documents"), "doc_id")


@query("l02_head_split", "with r as (select file_name, line_id, row_number() over (partition by file_name order by line_no) as r, count(*) over (partition by file_name) as n from manifest_raw) select line_id, case when r <= greatest(1, n * 98 // 100) then 'train' else 'validation' end as split from r")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 98 per cent of each manifest file, at least one row, and the rest (L2)."""
    r = with_rank(table(spark, sf_dir, "manifest_raw").select("line_id", "file_name", "line_no"), ["file_name"], F.floor(c("line_no") / 100_000), ["line_no"], "r", "n")
    return r.select("line_id", when(c("r") <= F.greatest(lit(1), F.expr("n * 98 div 100")), "train").otherwise("validation").alias("split"))


@query("l03_limit_per_split", f"select rec_id, split, r from (select rec_id, split, text, row_number() over (partition by split order by rec_id) as r from asr_manifest where split is not null) where r <= 50 and {s_strip('coalesce(text, ' + chr(39) * 2 + ')')} <> ''")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first k input rows of each split, skipped ones included in the count (L3, L4)."""
    r = table(spark, sf_dir, "asr_manifest").where("split is not null").withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy("rec_id")))
    return r.where((c("r") <= 50) & (T.strip(F.coalesce("text", lit(""))) != "")).select("rec_id", "split", "r")


@query("l05_first_words", f"select doc_id, array_to_string({s_words('text')}[1:5], ' ') as first from documents where text is not null")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(T.words(c("text")), 1, 5), " ").alias("first"))


@query("o01_sorted_segments", "select file_id, seg_id, row_number() over (partition by file_id order by start_time, seg_id) as place from speaker_segment where start_time is not null and file_id is not null")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of a segment by start time within its file (O1); ranked within hours, whose counts are added up."""
    s = table(spark, sf_dir, "speaker_segment").where("start_time is not null and file_id is not null").select("file_id", "seg_id", "start_time")
    return with_rank(s, ["file_id"], F.floor(c("start_time") / 3600), ["start_time", "seg_id"], "place").select("file_id", "seg_id", "place")


@query("o02_newest_chunks", f"select row_id, text from (select row_id, text from chunk_info order by ingested_at desc, row_id desc limit 20) where {s_strip('coalesce(text, ' + chr(39) * 2 + ')')} <> ''")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest chunks, blank ones dropped afterwards (O2)."""
    return table(spark, sf_dir, "chunk_info").orderBy(c("ingested_at").desc(), c("row_id").desc()).limit(20).where(T.strip(F.coalesce("text", lit(""))) != "").select("row_id", "text")
