import random

from pyspark.sql import functions as F

from ravand.llm.group_split import assign_splits, spread_uids

CONFIG = "dataset string, train_ratio double, validation_ratio double, test_ratio double"


def records(spark, rng, n=3000):
    rows = [(i, rng.choice(["hot"] * 3 + [f" U{rng.randint(0, 200)} ", f"u{rng.randint(0, 200)}", None, "  "]), rng.choice(["a", "a", "b", None]), rng.choice(["train", "dev", " TEST", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rec_id bigint, uid string, dataset string, split string").selectExpr("*", "'x' as component", "'y' as new_split")


def test_components_stay_whole_and_ratios_hold(spark):
    rows, df = records(spark, random.Random(1))
    config = spark.createDataFrame([("a", 0.8, 0.1, 0.1), ("b", 0.7, 0.15, 0.15)], CONFIG)
    out = assign_splits(df, config).cache()
    assert out.count() == len(rows) and out.select("rec_id").distinct().count() == len(rows)
    assert out.where("uid is not null").groupBy("uid").agg(F.countDistinct("new_split").alias("n")).where("n > 1").count() == 0
    share = {(r["dataset"], r["new_split"]): r["s"] for r in out.groupBy("dataset", "new_split").agg(F.count("*").alias("n")).selectExpr("dataset", "new_split", "n / sum(n) over (partition by dataset) as s").collect()}
    assert abs(share["a", "train"] - 0.8) < 0.03 and abs(share["b", "test"] - 0.15) < 0.03 and abs(share[None, "train"] - 0.8) < 0.05


def test_spread(spark):
    rows, df = records(spark, random.Random(2), 400)
    name = {"train": "train", "dev": "validation", " TEST": "test"}
    seen = {}
    for _, uid, _, split in rows:
        if uid and uid.strip() and split:
            seen.setdefault(uid.strip().lower(), set()).add(name[split])
    assert sorted(r["uid"] for r in spread_uids(df).collect()) == sorted(u for u, s in seen.items() if len(s) > 1)


def test_empty(spark):
    _, df = records(spark, random.Random(3), 5)
    config = spark.createDataFrame([], CONFIG)
    assert assign_splits(df.where("false"), config).count() == 0 and spread_uids(df.where("false")).count() == 0
    assert assign_splits(df, config).count() == 5


def test_present_splits_are_the_start(spark):
    """Where speakers already stand apart in the given proportions nothing moves; a dataset without a split column starts by hash."""
    rows = [(i, f"u{i // 4}", "own", ("train", "train", "train", "dev", "TEST ")[i // 4 % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id bigint, uid string, dataset string, split string")
    name = {"train": "train", "dev": "validation", "TEST ": "test"}
    for column, stays in (("split", True), (None, False)):
        config = spark.createDataFrame([("own", 0.6, 0.2, 0.2, column)], CONFIG + ", split_column string")
        found = {r["rec_id"]: r["new_split"] for r in assign_splits(df, config).collect()}
        assert len(found) == len(rows) and all(found[i] == name[s] for i, _, _, s in rows) is stays
