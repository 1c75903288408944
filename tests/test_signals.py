import numpy as np
import pytest
from pyspark.sql import functions as F

from ravand.functions import arrays as A
from ravand.functions import spectral
from ravand.operators.clustering import choose_labels, mean_silhouette, silhouette_points, ward_labels


def one(spark, f, values):
    return spark.createDataFrame([(values,)], "a array<double>").select(f(F.col("a")).alias("r")).first()["r"]


def test_arrays(spark):
    assert one(spark, A.mono, [1.0, 3.0, -1.0, 1.0]) == [2.0, 0.0]
    assert one(spark, lambda a: A.trimmed_silence(a, 0.5), [0.0, 0.6, 0.1, -0.7, 0.2]) == [0.6, 0.1, -0.7]
    assert one(spark, lambda a: A.trimmed_silence(a, 5.0), [0.0, 0.6]) == [0.0, 0.6]
    assert one(spark, lambda a: A.segment(a, F.lit(0.1), F.lit(0.35), 10), [0.0, 1.0, 2.0, 3.0]) == [1.0, 2.0]
    assert one(spark, lambda a: A.padded(a, 3), [1.0]) == [1.0, 0.0, 0.0]
    x = np.array([0.1, -0.4, 0.2])
    y = x / 0.4 * 0.95
    assert one(spark, A.normalized, x.tolist()) == pytest.approx((y * (0.1 / np.sqrt((y**2).mean()))).tolist())
    assert one(spark, lambda a: A.changed_volume(a, 4.0), x.tolist()) == pytest.approx((x * 4 / 1.6 * 0.95).tolist())
    assert one(spark, lambda a: A.frame_energies(a, 2, 2), [1.0, 2.0, 3.0, 4.0, 5.0]) == [5.0, 25.0]
    assert one(spark, A.zero_crossings, [1.0, -1.0, -1.0, 1.0]) == 2 / 2048
    assert one(spark, lambda a: A.zero_crossings(a, 4, 2), [1.0, -1.0, -1.0, 1.0]) == pytest.approx((1 / 4 + 2 / 4 + 1 / 4) / 3)
    assert one(spark, A.zero_crossings, []) is None


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (12, 3)) for c in (0, 5, 10)])
    labels = choose_labels(x)
    assert len(np.unique(labels)) == 3 and all(len(np.unique(labels[k : k + 12])) == 1 for k in (0, 12, 24))
    assert len(np.unique(ward_labels(x, 2))) == 2
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "id bigint, v array<double>, c int")
    mean = silhouette_points(df, "id", "v", "c").agg(F.avg("silhouette")).first()[0]
    assert mean == pytest.approx(mean_silhouette(x, labels))


def plain_ward(x, k):
    """Clusters merged pair by pair, always the pair whose merge adds least to the squares within."""
    groups = [[i] for i in range(len(x))]

    def rise(a, b):
        d = x[a].mean(axis=0) - x[b].mean(axis=0)
        return len(a) * len(b) / (len(a) + len(b)) * (d @ d)

    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: rise(groups[p[0]], groups[p[1]]))
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        mates = [j for j in range(len(x)) if labels[j] == own and j != i]
        a = d[i, mates].mean() if mates else 0
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if mates else 0)
    return np.mean(out)


def test_ward_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(8):
        x = rng.normal(size=(25, 3))
        for k in (1, 2, 5, 24, 25):
            labels = ward_labels(x, k)
            assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in np.unique(labels)} == plain_ward(x, k)
        assert mean_silhouette(x, ward_labels(x, 4)) == pytest.approx(plain_silhouette(x, ward_labels(x, 4)))


def test_numbers_of_clusters():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    assert len(set(choose_labels(x, forced=4).tolist())) == 4 and len(set(choose_labels(x[:3], forced=9).tolist())) == 3
    assert len(set(choose_labels(x, least=3, most=3).tolist())) == 3 and len(set(choose_labels(x, least=5, most=3).tolist())) == 5
    assert choose_labels(x[:1]).tolist() == [0] and len(choose_labels(x[:0])) == 0
    assert set(choose_labels(np.zeros((6, 2))).tolist()) == {0}


def test_five_thousand_segments():
    import time

    x = np.random.default_rng(4).normal(size=(5000, 64))
    began = time.perf_counter()
    assert len(np.unique(choose_labels(x, most=3))) <= 3 and time.perf_counter() - began < 120


def test_entropy_and_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=700)
    n = 256
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.zeros(n // 2 + 1)
    for s in (0, 128, 256, 384):
        part = (x[s : s + n] - x[s : s + n].mean()) * w
        for k in range(n // 2 + 1):
            power[k] += abs((part * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum()) ** 2 * (1 if k in (0, n // 2) else 2)
    p = power / power.sum()
    assert one(spark, spectral.spectral_entropy, x.tolist()) == pytest.approx(-(p * np.log(p)).sum())
    assert one(spark, spectral.spectral_entropy, []) is None and one(spark, spectral.spectral_entropy, [0.0] * 64) == 0
    # second differences of a parabola are its second derivative, first ones of a line its slope, at the ends too
    t = np.arange(12.0)
    assert spectral.delta_matrix(12, 1) @ (3 * t + 1) == pytest.approx(np.full(12, 3.0))
    assert spectral.delta_matrix(12, 2) @ (2 * t**2 - t) == pytest.approx(np.full(12, 4.0))
    filters = spectral.mel_filters(16_000, 512, 40)
    assert (filters.sum(axis=1) * 16_000 / 512 == pytest.approx(np.ones(40), rel=0.35)) and (filters >= 0).all()
    c = spectral.mfcc(np.stack([x, 2 * x]), 16_000, 64, 16, bands=20)
    assert c.shape == (2, 13, 44) and c[1, 1:] == pytest.approx(c[0, 1:]) and c[1, 0] - c[0, 0] == pytest.approx(np.full(44, 20 * np.log10(2) * np.sqrt(20)))
    assert len(one(spark, lambda a: spectral.pooled_features(a, n_fft=64, hop=16, bands=20), x.tolist())) == 39
