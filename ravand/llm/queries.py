"""Queries of the text-corpus operators, whole tables each."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravand.llm.group_split import assign_splits, spread_uids
from ravand.llm.leakage import exact_leaks, leaked_passages
from ravand.llm.lookalikes import lookalike_pairs, normalized_texts
from ravand.llm.overlap import cross_split_pairs, overlap_report, record_coverage
from ravand.llm.sentences import sentence_units
from ravand.llm.tokenize import encode_corpus
from ravand.llm.turns import speaker_turns, turn_lines

TOKENIZER = os.environ.get("RAVAND_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(_table(spark, sf_dir, "asr_manifest"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(_table(spark, sf_dir, "asr_manifest"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_coverage(_table(spark, sf_dir, "asr_manifest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_uids(_table(spark, sf_dir, "asr_manifest"))


def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(_table(spark, sf_dir, "asr_manifest"), _table(spark, sf_dir, "dataprep_config"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(_table(spark, sf_dir, "chunk_info"))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_lines(_table(spark, sf_dir, "chunk_info"))


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"asr_manifest": (_table(spark, sf_dir, "asr_manifest"), "rec_id", "text"), "chunk_info": (_table(spark, sf_dir, "chunk_info"), "row_id", "text")}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_texts(spark, sf_dir))


def p6_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_texts(_texts(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_report, p2_coverage, p3_found, p3_assigned, p5_found, p5_lines, p6_found, p6_normalized, p7_ids, p8_found, p8_near, p9_found)}
_TRIM = "nullif(regexp_replace({}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g'), '')"

SQL: dict[str, str] = {
    "p3_found": f"""
      with r as (select lower({_TRIM.format("uid")}) as uid, lower({_TRIM.format("split")}) as s from asr_manifest),
           n as (select uid, case s when 'training' then 'train' when 'dev' then 'validation' when 'valid' then 'validation' else s end as s from r where uid is not null and s is not null)
      select uid from n group by uid having count(distinct s) > 1""",
}
