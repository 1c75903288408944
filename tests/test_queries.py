"""Registered queries against their SQL on the smallest tables, where they are there."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "p4_found", "t02_word_runs", "t08_paragraphs", "t14_space_marks", "t16_capitalize", "t17_context", "t19_text_quality", "t30_statistics", "t32_merge_chunks", "t38_word_error_rate", "q02_sentence_fluency", "q09_overall", "i04_smart_chunks", "i07_gap_merge", "i09_kept_islands",
    "i10_energy_islands", "a05_signal_quality", "j01_stem_join", "l01_shuffled_split", "l02_head_split", "ag9_memory_trend", "ag14_performance", "v1_ensemble_vote", "x11_sessions", "x12_as_of",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p1_found", "p4_found", "t01_words", "x16_above_average"} <= set(entry.queries())
