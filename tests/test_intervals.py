import random

import pytest
from pyspark.sql import functions as F

from ravand.functions import chunks
from ravand.operators.islands import keep_islands, merge_gaps, over_last, speech_islands, with_rank, with_total_before
from ravand.operators.periods import periods_and_gaps


def plan(spark, f, ds):
    rows = spark.createDataFrame([(d,) for d in ds], "d bigint").select("d", f(F.col("d")).alias("x")).collect()
    return {r["d"]: [(c["start_ms"], c["end_ms"]) for c in r["x"]] for r in rows}


def test_chunk_planners(spark):
    assert plan(spark, lambda d: chunks.boundaries(d, 10, 2), [17, 5, 0])[17] == [(0, 10), (8, 17), (16, 17)]
    one = spark.range(1).select(chunks.total_chunks(F.lit(17), 10, 2).alias("n")).first()["n"]
    assert one == 2
    smart = plan(spark, lambda d: chunks.smart(F.lit(0), d, 20000, 200), [25000, 26000])
    assert smart == {25000: [(0, 20000)], 26000: [(0, 20000), (19800, 26000)]}
    with pytest.raises(ValueError):
        chunks.smart(F.lit(0), F.lit(1), 10, 3)
    with pytest.raises(ValueError):
        chunks.check_chunks(10, 10)


def test_fallback_against_brute_force(spark):
    def steps(d, t, o):
        out, at = [], 0
        while at < d:
            out.append((at, min(at + t, d)))
            if out[-1][1] == d:
                break
            at = out[-1][1] - o
        return out

    ds = list(range(0, 60))
    assert plan(spark, lambda d: chunks.fallback(d, 10, 3), ds) == {d: steps(d, 10, 3) for d in ds}


def brute_periods(rows, most):
    out = []
    for key in sorted({r[0] for r in rows}):
        spans = sorted((round(a * 1000), round(b * 1000)) for k, a, b in rows if k == key)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged]
        out += [(key, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:], strict=False) if q[0] - p[1] <= most]
    return sorted(out)


@pytest.mark.parametrize("bucket", [700, 5_000, 10_000_000])
def test_periods_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for _ in range(400):
        a = rng.randint(0, 40_000) / 1000
        rows.append((rng.choice("ab"), a, a + rng.choice([0.05, 0.3, 2.0, 9.0])))
    rows += rows[:20]
    dirty = rows + [("a", None, 1.0), ("a", 5.0, 5.0), ("b", 9.0, 2.0), (None, 0.0, 1.0), ("a", float("nan"), 1.0), ("a", 0.0, float("inf"))]
    df = spark.createDataFrame(dirty, "file string, s double, e double").withColumn("kind", F.lit("clash"))
    found = periods_and_gaps(df, ["file"], "s", "e", 1500, bucket)
    assert sorted((r["file"], r["kind"], r["start_ms"], r["end_ms"]) for r in found.collect()) == brute_periods(rows, 1500)


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, s double, e double"), ["k"], "s", "e").count() == 0


def test_merge_gaps_is_strict_and_ends_with_the_last(spark):
    rows = [(1, "f", "s", 0.0, 5.0, 0.9), (2, "f", "s", 1.0, 2.0, 0.5), (3, "f", "s", 5.0, 6.0, 0.8), (4, "f", "s", 7.9, 8.0, 0.7), (5, "f", None, 0.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "seg_id int, file_id string, speaker_id string, start_time double, end_time double, confidence double")
    for bucket in (1.0, 3600.0):
        found = sorted((r["start_time"], r["end_time"], r["confidence"], r["n_segments"]) for r in merge_gaps(df, ["file_id", "speaker_id"], gap=3.0, bucket_seconds=bucket).collect())
        assert found == [(0.0, 2.0, 0.5, 2), (5.0, 8.0, 0.7, 2)]


def test_speech_islands(spark):
    speech = "0110111100"
    df = spark.createDataFrame([("f", i, c == "1") for i, c in enumerate(speech)], "file_id string, frame_no bigint, is_speech boolean")
    for bucket in (2, 100):
        found = speech_islands(df, 30, bucket)
        assert sorted((r["start_ms"], r["end_ms"]) for r in found.collect()) == [(30, 90), (120, 240)]
    lengths = spark.createDataFrame([("f", 300), ("g", 50)], "file_id string, length_ms bigint")
    kept = keep_islands(found, lengths, gap_ms=31, least_ms=200)
    assert sorted(tuple(r) for r in kept.collect()) == [("f", 30, 240), ("g", 0, 50)]


def test_rank_across_buckets(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 7)], "k string, i bigint")
    rows = with_rank(df, ["k"], F.floor(F.col("i") / 9), ["i"], size="n").collect()
    assert all(r["row_no"] == (r["i"] + 1 if r["k"] == "a" else 1) and r["n"] == (50 if r["k"] == "a" else 1) for r in rows)


def test_windows_cut_by_buckets(spark):
    """Last rows and running totals against lists; one key holds most rows, blocks and buckets are small."""
    rng = random.Random(8)
    rows = [(i, "a" if rng.random() < 0.8 else rng.choice("bc"), rng.randint(0, 400), rng.choice([None, *range(5)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long").withColumn("b", F.floor(F.col("t") / 40))
    last = over_last(df, ["k"], F.col("b"), ["t", "id"], 10, lambda w: {"n": F.count(F.lit(1)).over(w), "s": F.sum("v").over(w), "first": F.first("id").over(w)}, block=25)
    found = {r["id"]: (r["n"], r["s"], r["first"]) for r in last.collect()}
    totals = {r["id"]: r["total"] for r in with_total_before(df, ["k"], "b", ["t", "id"], F.col("v"), "total").collect()}
    assert len(found) == len(totals) == len(rows)
    add = lambda values: sum(x for x in values if x is not None) if any(x is not None for x in values) else None
    for key in "abc":
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(own):
            part = own[max(0, i - 9) : i + 1]
            assert found[r[0]] == (len(part), add([x[3] for x in part]), part[0][0])
            assert totals[r[0]] == add([x[3] for x in own[: i + 1]])
