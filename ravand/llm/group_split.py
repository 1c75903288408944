"""Splits that keep related records together, by component swap search.

A component is all records of one uid (trimmed, lower case); a record without uid is a component of its own.
Components are counted per dataset with map-side aggregation, so a uid may hold any share of the rows. A component
starts in the split that most of its records of datasets with a split of their own (a `split_column`) stand in now,
all others by hash. From there, moves and exchanges of whole components lower the deviation of every dataset's splits from
its ratios under simulated annealing. The components are spread over shards by hash and annealed in parallel
on the workers; the best of several runs of a shard is kept. Components too large for a shard's
quotas (more than `LARGE` of a dataset's rows: at most 1 / LARGE for each dataset, whatever the size of the
data) are annealed first, together, on the driver; the shards aim at what they leave.

Defined cases: null or blank uid: the record stands alone; null dataset: a dataset of its own under default
ratios, as is one that the configuration lacks; null split: counts towards no present split; repeated rows
count as often as they come.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravand.session import materialize

SPLITS = ("train", "validation", "test")
LARGE = 0.002
SHARD = 20_000
DEFAULT_RATIOS = (0.8, 0.1, 0.1)
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at either end; blank becomes null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def split_name(c: Column) -> Column:
    """train, validation or test, however written; any other name in lower case; null where blank."""
    name = F.lower(trimmed(c))
    return F.when(name == "training", "train").when(name.isin("dev", "valid"), "validation").otherwise(name)


def components(df: DataFrame, uid: str = "uid", split: str = "split") -> DataFrame:
    """(uid, n_records, n_splits) of every uid, with the number of splits its records stand in now.

    Records without uid or split don't count towards n_splits.
    """
    rows = df.select(F.lower(trimmed(F.col(f"`{uid}`"))).alias("uid"), split_name(F.col(f"`{split}`")).alias("split")).where("uid is not null")
    counts = rows.groupBy("uid", "split").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("uid").agg(F.sum("n").alias("n_records"), F.count("split").alias("n_splits"))


def spread_uids(df: DataFrame, uid: str = "uid", split: str = "split") -> DataFrame:
    """(uid) of the components whose records are spread over several splits."""
    return components(df, uid, split).where("n_splits > 1").select("uid")


def anneal(sizes: np.ndarray, start: np.ndarray, targets: np.ndarray, weight: np.ndarray, seed: int, steps: int, runs: int = 3) -> tuple[np.ndarray, float]:
    """The best assignment found. sizes: components x datasets, targets: splits x datasets, weight: by dataset."""
    best, best_cost = start, math.inf
    held = [[(int(d), float(row[d])) for d in np.flatnonzero(row)] for row in sizes]
    w = weight.tolist()
    for run in range(runs):
        rng = np.random.default_rng(seed + run)
        now = start.copy()
        load = np.zeros_like(targets, float)
        np.add.at(load, now, sizes)
        gap = (load - targets).tolist()
        cost = sum(w[d] * g * g for row in gap for d, g in enumerate(row))
        low, low_cost = now.tolist(), cost
        heat = max(cost / max(len(sizes), 1), 1e-12)
        cool = (1e-4) ** (1 / max(steps, 1))
        picks = rng.integers(0, len(sizes), (steps, 2)).tolist()
        turns = rng.integers(1, len(SPLITS), steps).tolist()
        chances = rng.random(steps).tolist()
        place = now.tolist()
        for (a, b), turn, chance in zip(picks, turns, chances, strict=True):
            moves = [(a, place[a], (place[a] + turn) % len(SPLITS))]
            if chance < 0.5 and place[b] != place[a]:  # exchange two components, else move one
                moves = [(a, place[a], place[b]), (b, place[b], place[a])]
            change: dict[tuple[int, int], float] = {}
            for c, old, new in moves:
                for d, n in held[c]:
                    change[old, d] = change.get((old, d), 0.0) - n
                    change[new, d] = change.get((new, d), 0.0) + n
            delta = sum(w[d] * x * (2 * gap[s][d] + x) for (s, d), x in change.items())
            if delta <= 0 or math.exp(-delta / heat) > chance:
                better = cost + delta < low_cost - 1e-9
                if low is None and not better:  # the best so far is left: keep it
                    low = place.copy()
                for (s, d), x in change.items():
                    gap[s][d] += x
                for c, _, new in moves:
                    place[c] = new
                cost += delta
                if better:
                    low_cost, low = cost, None
            heat *= cool
        final = place if low is None else low  # moves that gain nothing are not kept
        final_cost = _cost(sizes, np.array(final), targets, weight)
        if final_cost < best_cost:
            best, best_cost = np.array(final), final_cost
    return best, best_cost


def _cost(sizes: np.ndarray, place: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> float:
    load = np.zeros_like(targets, float)
    np.add.at(load, place, sizes)
    return float((weight * (load - targets) ** 2).sum())


def _hashed(keys: list[str], ratios: tuple[float, ...]) -> np.ndarray:
    """The hashed start: a component's split follows from its key alone."""
    import xxhash

    x = np.array([xxhash.xxh3_64_intdigest(k) / 2**64 for k in keys])
    return np.minimum(np.searchsorted(np.cumsum(ratios) / sum(ratios), x, side="right"), len(ratios) - 1)


def _starts(keys: list[str], votes: np.ndarray, ratios: tuple[float, ...]) -> np.ndarray:
    """The split with most votes of each component (the first of equals), that of its hash where there are none."""
    return np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), _hashed(keys, ratios)) if keys else np.zeros(0, int)


def assign_splits(records: DataFrame, config: DataFrame, row_id: str = "rec_id", uid: str = "uid", dataset: str = "dataset", split: str = "split", seed: int = 7) -> DataFrame:
    """(row_id, uid, dataset, new_split) of every record; `config` has dataset, the three ratios and, if any has one, split_column, a row each.

    The configuration is read on the driver: one row for each dataset. A dataset whose split_column is null, or
    that the configuration lacks, has no split of its own: what its records say doesn't count.
    """
    key = F.lower(trimmed(F.col(f"`{uid}`")))
    settings = config.collect()
    carries = {r["dataset"] for r in settings if "split_column" in config.columns and r["split_column"] is not None}
    present = F.when(F.col(f"`{dataset}`").isin(*carries), split_name(F.col(f"`{split}`"))) if carries else F.lit(None).cast("string")
    rows = records.select(F.col(f"`{row_id}`").alias("row_id"), key.alias("uid"), F.col(f"`{dataset}`").alias("dataset"), present.alias("present"))
    rows = rows.withColumn("component", F.when(F.col("uid").isNotNull(), F.concat(F.lit("u:"), F.col("uid"))).otherwise(F.concat(F.lit("r:"), F.col("row_id").cast("string"))))
    rows = rows.withColumn("ds", F.coalesce("dataset", F.lit("\0")))
    counts = materialize(rows.groupBy("component", "ds").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("present") == s).alias(s) for s in SPLITS]))
    totals = {r["ds"]: (r["n"], r["k"]) for r in counts.groupBy("ds").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    names = sorted(totals)
    if not names:
        return rows.select("row_id", "uid", "dataset", F.lit(None).cast("string").alias("new_split"))
    at = {d: i for i, d in enumerate(names)}
    given = {r["dataset"]: (r["train_ratio"], r["validation_ratio"], r["test_ratio"]) for r in settings}
    ratios = np.array([[x or 0.0 for x in given.get(d, DEFAULT_RATIOS)] for d in names])
    ratios /= np.maximum(ratios.sum(axis=1, keepdims=True), 1e-12)
    total = np.array([totals[d][0] for d in names], float)
    weight = 1.0 / np.maximum(total, 1) ** 2
    mean = tuple((ratios * total[:, None]).sum(axis=0) / total.sum())
    targets = (ratios * total[:, None]).T

    spark = records.sparkSession
    limits = spark.createDataFrame([(d, max(2.0, LARGE * totals[d][0])) for d in names], "ds string, most double")
    large = counts.join(F.broadcast(limits), "ds").where("n > most").select("component").distinct()
    big = counts.join(large, "component", "left_semi").collect()  # at most 1 / LARGE for each dataset
    keys = sorted({r["component"] for r in big})
    sizes, votes = np.zeros((len(keys), len(names))), np.zeros((len(keys), len(SPLITS)))
    where = {k: i for i, k in enumerate(keys)}
    for r in big:
        sizes[where[r["component"]], at[r["ds"]]] = r["n"]
        votes[where[r["component"]]] += [r[s] for s in SPLITS]
    placed = np.zeros(0, int)
    if keys:
        # the small components can fill what is left, so the large ones aim at their own share
        placed, _ = anneal(sizes, _starts(keys, votes, mean), ratios.T * sizes.sum(axis=0), weight, seed, min(200_000, 400 * len(keys)))
        load = np.zeros_like(targets)
        np.add.at(load, placed, sizes)
        rest = np.maximum(targets - load, 0)
        small = total - sizes.sum(axis=0)
        targets = rest * (small / np.maximum(rest.sum(axis=0), 1e-12))
    left = np.maximum(targets.sum(axis=0), 1e-12)
    goal = targets / left  # the share of each split in what the shards hold

    shards = max(1, math.ceil(sum(k for _, k in totals.values()) / SHARD))
    big_df = spark.createDataFrame(pd.DataFrame({"component": keys, "big_split": [SPLITS[p] for p in placed]}), "component string, big_split string")
    rest_counts = counts.join(F.broadcast(big_df), "component", "left_anti").withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names_here, index = np.unique(group["component"].to_numpy(dtype=object), return_inverse=True)
        own = np.zeros((len(names_here), len(at)))
        np.add.at(own, (index, group["ds"].map(at).to_numpy()), group["n"].to_numpy())
        now = np.zeros((len(names_here), len(SPLITS)))
        np.add.at(now, index, group[list(SPLITS)].to_numpy())
        aim = goal * own.sum(axis=0)
        placed_here, _ = anneal(own, _starts(names_here.tolist(), now, mean), aim, 1.0 / np.maximum(own.sum(axis=0), 1) ** 2, seed + int(group["shard"].iloc[0]), min(60_000, 30 * len(names_here)))
        return pd.DataFrame({"component": names_here, "small_split": [SPLITS[p] for p in placed_here]})

    # as many partitions as shards: small shards would otherwise be put together into one task, though their work is not small
    small_df = rest_counts.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "component string, small_split string")
    out = rows.join(F.broadcast(big_df), "component", "left")
    big_rows = out.where("big_split is not null").withColumn("new_split", F.col("big_split"))
    small_rows = out.where("big_split is null").join(small_df, "component").withColumn("new_split", F.col("small_split"))
    columns = ["row_id", "uid", "dataset", "new_split"]
    both = big_rows.select(*columns).unionByName(small_rows.select(*columns))
    return both.withColumnRenamed("row_id", row_id) if row_id != "row_id" else both
