import random
import time
import unicodedata

import pyarrow as pa

from ravand.llm import codepoints as cp
from ravand.llm.lookalikes import lookalike_pairs, normalize_look


def look(*texts):
    return cp.encode(*cp.look(*cp.decode(pa.array(texts, pa.string())))).to_pylist()


def test_round_trip():
    texts = ["", "a", None, "سلام 🎙️", "x" * 100_000]
    a = pa.array(texts)
    assert cp.encode(*cp.decode(a), valid=a.is_valid().to_numpy(zero_copy_only=False)).to_pylist() == texts
    assert cp.encode(*cp.decode(a.slice(3, 2))).to_pylist() == texts[3:]


def test_equal_to_canonical_composition():
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x41, 0x50), *range(0x300, 0x330), 0x1E69, 0xAC00, 0xAC01, 0x1100, 0x1161, 0x11A8, 0x5D0, 0x5B0, 0x5BC]]
    for _ in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        nfd = unicodedata.normalize("NFD", s)
        expected = unicodedata.normalize("NFC", "".join(c for c in nfd if ord(c) not in cp.INVISIBLE))
        assert look("x", unicodedata.normalize("NFC", s), "́b", nfd, s)[1::1][0] == expected
        assert look("x", s, "́b", nfd)[1] == look("x", s, "́b", nfd)[3] == expected


def test_what_looks_the_same():
    same = [
        ("résumé", "résumé"), ("كتاب ي", "کتاب ی"), ("ｐｏｄｃａｓｔ", "podcast"), ("ﺁﺭﺷﯿﻮ", "آرشیو"), ("manifest", "mаnifеst"), ("می‌‌کرد", "می‌کرد"), ("a b", "a b"), ("a b", "a b"),
        ("د­ر", "در"), ("﻿در​", "در"), ("٣", "۳"), ("مدرسۀ", "مدرسهٔ"), ("یٔ", "ئ"), ("آ", "آ"), ("ﻻ", "لا"),
    ]
    differ = [("تازه", "تَازه"), ("٤", "۴"), ("۴", "4"), ("می‌کرد", "میکرد"), ("a b", "a  b"), ("کرد.", "کرد"), ("A", "a"), ("۰", "0"), ("и", "u")]
    for a, b in same:
        assert look(a) == look(b), (a, b)
    for a, b in differ:
        assert look(a) != look(b), (a, b)


def test_operator(spark):
    df = spark.createDataFrame([(1, "كتاب", "x"), (2, None, "y"), (3, "", None)], "id bigint, t string, norm_text string")
    assert {r["id"]: r["norm_text"] for r in normalize_look(df, "t").collect()} == {1: "کتاب", 2: None, 3: ""}
    assert normalize_look(df.where("false"), "t").count() == 0


def test_pairs(spark):
    rows = [(1, "كتاب"), (2, "کتاب"), (3, "کتاب"), (4, "..."), (5, ".​.."), (6, None), (7, ""), (8, "تازه"), (9, "تَازه"), (10, "ab"), (11, "а​b" + " " * 0)]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "'clash' as k1", "0 as raw")
    found = lookalike_pairs({"t": (df, "id", "text"), "u": (df.where("false"), "id", "text")})
    assert sorted((r["table_name"], r["id_a"], r["id_b"]) for r in found.collect()) == [("t", 1, 2), ("t", 1, 3), ("t", 10, 11)]


def test_every_text_of_both_tables_comes_out(spark, tmp_path):
    from ravand.llm.queries import p6_normalized

    spark.createDataFrame([(1, "كتاب"), (2, None), (3, "..."), (3, "...")], "rec_id bigint, text string").write.parquet(f"{tmp_path}/asr_manifest.parquet")
    spark.createDataFrame([(1, "ｐｏｄ"), (7, "")], "row_id bigint, text string").write.parquet(f"{tmp_path}/chunk_info.parquet")
    found = sorted((tuple(r) for r in p6_normalized(spark, str(tmp_path)).select("table_name", "id", "norm_text").collect()), key=str)
    assert found == sorted([("asr_manifest", 1, "کتاب"), ("asr_manifest", 2, None), ("asr_manifest", 3, "..."), ("asr_manifest", 3, "..."), ("chunk_info", 1, "pod"), ("chunk_info", 7, "")], key=str)


def test_many_copies_meet_only_the_variant(spark):
    rows = spark.range(100_000).selectExpr("id", "'کتاب تازه' as text").union(spark.createDataFrame([(-1, "كتاب تازه"), (None, "كتاب تازه")], "id bigint, text string"))
    began = time.perf_counter()
    found = lookalike_pairs({"t": (rows, "id", "text")})
    assert found.count() == 100_000 and found.where("id_a <> -1").count() == 0
    assert time.perf_counter() - began < 60
