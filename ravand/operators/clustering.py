"""Speaker clustering of segment embeddings: Ward linkage with the number of clusters chosen by silhouette, and silhouette itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of distances: what is held at once, whatever the size of a file.
BLOCK = 1024


def ward_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of Ward's merges, in order of height; a and b are rows that stand for the merged clusters.

    Nearest-neighbour chains over cluster means: no matrix of distances is held, and each of about three times as
    many steps as rows costs one pass over the means.
    """
    n = len(x)
    mean, size = x.astype(float).copy(), np.ones(n)
    alive = np.ones(n, bool)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        d = ((mean - mean[a]) ** 2).sum(axis=1) * (size * size[a] / (size + size[a]))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b]:  # the one before is nearest as well: they merge
            b = chain[-2]
            chain = chain[:-2]
            keep, gone = min(a, b), max(a, b)
            merges.append((float(d[b]), keep, gone))
            mean[keep] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
            size[keep] = size[a] + size[b]
            alive[gone] = False
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[0])


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters: the tree of `ward_tree` without its k - 1 highest merges."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in merges[: n - k]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's agglomeration."""
    return cut(ward_tree(x), len(x), k)


def mean_silhouettes(x: np.ndarray, labelings: list[np.ndarray]) -> list[float]:
    """Mean Euclidean silhouette of each labelling; a cluster of one scores 0. Distances are made once, in blocks of rows."""
    norm = (x**2).sum(axis=1)
    members = [np.eye(int(labels.max()) + 1)[labels] for labels in labelings]
    totals = [0.0] * len(labelings)
    for at in range(0, len(x), BLOCK):
        part = slice(at, at + BLOCK)
        d = norm[part, None] + norm[None] - 2 * x[part] @ x.T
        row = np.arange(len(d))
        d[row, row + at] = 0
        d = np.sqrt(np.maximum(d, 0))
        for k, (labels, member) in enumerate(zip(labelings, members, strict=True)):
            sums, counts, own = d @ member, member.sum(axis=0), labels[part]
            inner = sums[row, own] / np.maximum(counts[own] - 1, 1)
            means = sums / counts
            means[row, own] = np.inf
            outer = means.min(axis=1)
            totals[k] += float(np.where(counts[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).sum())
    return [t / len(x) for t in totals]


def mean_silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    return mean_silhouettes(x, [np.unique(labels, return_inverse=True)[1]])[0]


def choose_labels(x: np.ndarray, least: int = 1, most: int = 10, forced: int | None = None) -> np.ndarray:
    """Labels of the number of clusters with the best silhouette; one cluster scores 0, ties keep the fewer.

    `forced` clusters, at most one for each row, are made without a choice. Where `least` is over what the rows
    allow, there are `least` clusters, or as many as there are rows.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    if forced is not None and forced >= 1:
        return ward_labels(x, min(forced, n))
    tree = ward_tree(x)
    counts = list(range(max(least, 2), min(most, n - 1) + 1))
    labelings = [cut(tree, n, k) for k in counts]
    best, best_score = (np.zeros(n, int), 0.0) if least <= 1 else (cut(tree, n, min(least, n)), -1.0)
    for labels, score in zip(labelings, mean_silhouettes(x, labelings), strict=True):
        if score > best_score:
            best, best_score = labels, score
    return best


def cluster_speakers(df: DataFrame, file_id: str, seg_id: str, embedding: str, least: int = 1, most: int = 10, forced: int | None = None) -> DataFrame:
    """(file_id, seg_id, speaker): clusters of a file's segments.

    A file's vectors are one task's, time grows with the square of their number; memory with the number alone.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (file_id, seg_id)}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group[embedding].to_numpy()).astype(float)
        return pd.DataFrame({file_id: group[file_id], seg_id: group[seg_id], "speaker": choose_labels(x, least, most, forced)})

    kept = df.select(file_id, seg_id, embedding).where(F.col(embedding).isNotNull())
    return kept.groupBy(file_id).applyInPandas(run, f"`{file_id}` {kinds[file_id]}, `{seg_id}` {kinds[seg_id]}, speaker bigint")


#: Clusters whose means centroid_silhouette sends to every task.
MOST_CENTROIDS = 10_000


def centroid_silhouette(df: DataFrame, row_id: str, embedding: str, label: str) -> DataFrame:
    """(row_id, silhouette) against the means of the clusters instead of all rows (A15 at any size): linear in the rows.

    Only the means are sent to the tasks; more than MOST_CENTROIDS clusters are an error. A single cluster scores 0.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(embedding).alias("v"), F.col(label).alias("c")).where("v is not null and c is not null")
    means = rows.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    found = means.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")).limit(MOST_CENTROIDS + 1).collect()
    if len(found) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} clusters")
    place = {r["c"]: i for i, r in enumerate(found)}
    centres = df.sparkSession.sparkContext.broadcast((place, np.array([[m["m"] for m in r["m"]] for r in found])))

    def run(batches):
        place, mean = centres.value
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                x, own = np.stack(part["v"].to_numpy()).astype(float), part["c"].map(place).to_numpy()
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (mean**2).sum(axis=1)[None] - 2 * x @ mean.T, 0))
                row = np.arange(len(x))
                inner = d[row, own].copy()
                d[row, own] = np.inf
                outer = d.min(axis=1)
                value = np.where(np.isinf(outer), 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300))
                yield pd.DataFrame({row_id: part["id"], "silhouette": value})

    return rows.mapInPandas(run, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, silhouette double")


def silhouette_points(df: DataFrame, row_id: str, embedding: str, label: str) -> DataFrame:
    """(row_id, silhouette) of every vector against all others, in blocks of rows.

    The measure is defined over all pairs; the pairs of two blocks are one task's matrix product, and only
    sums by cluster leave it, so no row of pairs is ever written.
    """
    n = df.count()
    blocks = max(1, -(-n // 2000))
    packed = df.select(F.pmod(F.xxhash64(row_id), F.lit(blocks)).alias("block"), F.col(row_id).alias("id"), F.col(embedding).alias("v"), F.col(label).alias("c"))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct("id", "v", "c")).alias("rows"))
    pairs = packed.select(F.col("block").alias("a"), F.col("rows").alias("left")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed.select(F.col("block").cast("int").alias("b"), F.col("rows").alias("right")), "b")

    def run(batches):
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"], strict=True):
                x, y = (np.array([r["v"] for r in rows], float) for rows in (left, right))
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
                same = np.array([r["id"] for r in left])[:, None] == np.array([r["id"] for r in right])[None]
                d[same] = 0
                names = np.array([r["c"] for r in right])
                for c in np.unique(names):
                    yield pd.DataFrame({"id": [r["id"] for r in left], "own": [r["c"] for r in left], "c": c, "total": d[:, names == c].sum(1), "n": int((names == c).sum())})

    kind, label_kind = df.schema[row_id].dataType.simpleString(), df.schema[label].dataType.simpleString()
    sums = pairs.select("left", "right").mapInPandas(run, f"id {kind}, own {label_kind}, c {label_kind}, total double, n bigint").groupBy("id", "own", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    inner = F.max(F.when(F.col("c") == F.col("own"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(-1.0)))
    outer = F.min(F.when(F.col("c") != F.col("own"), F.col("total") / F.col("n")))
    s = sums.groupBy("id").agg(inner.alias("i"), outer.alias("o"))
    return s.select(F.col("id").alias(row_id), F.when((F.col("i") < 0) | F.col("o").isNull(), 0.0).otherwise((F.col("o") - F.col("i")) / F.greatest("o", "i")).alias("silhouette"))
