"""Spectral measures of sample arrays, in Arrow batches: a Fourier transform is no built-in expression.

Arrays of one length are transformed together. A null or empty array gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hann(n: int) -> np.ndarray:
    """Periodic window of n samples."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def entropy(x: np.ndarray, segment: int = 256) -> np.ndarray:
    """Entropy (natural logarithm) of Welch's power spectrum of each row: segments of `segment` samples or fewer, half overlapping, without their mean."""
    n = min(segment, x.shape[1])
    step = n - n // 2
    starts = range(0, x.shape[1] - n + 1, step)
    power = np.zeros((len(x), n // 2 + 1))
    for s in starts:
        part = x[:, s : s + n]
        power += np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * hann(n), axis=1)) ** 2
    power[:, 1 : None if n % 2 else -1] *= 2  # both sides of the spectrum, but for its ends
    total = power.sum(axis=1, keepdims=True)
    p = np.divide(power, total, out=np.zeros_like(power), where=total > 0)
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)


def _mel(hz: np.ndarray) -> np.ndarray:
    """Mel scale: linear up to 1,000 Hz, logarithmic above."""
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=8)
def mel_filters(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """bands x (n_fft / 2 + 1): triangles of equal width on the mel scale, each of area two over its width in Hz."""
    edges = _hz(np.linspace(0, float(_mel(np.array(rate / 2))), bands + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=8)
def delta_matrix(frames: int, order: int, width: int = 9) -> np.ndarray:
    """Frames x frames: the derivative of order `order` of a polynomial of degree `order` fitted to `width` frames; at the ends that of the outermost ones."""
    half = width // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))
    out = np.zeros((frames, frames))
    for t in range(frames):
        middle = min(max(t, half), frames - 1 - half)
        # the order-th derivative of a polynomial of that degree is the same everywhere
        out[t, middle - half : middle + half + 1] = fit[order] * math.factorial(order)
    return out


def mfcc(x: np.ndarray, rate: int, n_fft: int, hop: int, count: int = 13, bands: int = 128) -> np.ndarray:
    """rows x count x frames: cepstral coefficients of frames of n_fft samples around every `hop`-th one."""
    padded = np.pad(x, ((0, 0), (n_fft // 2, n_fft // 2)))
    starts = np.arange(0, x.shape[1] + 1, hop)
    frames = padded[:, starts[:, None] + np.arange(n_fft)] * hann(n_fft)
    power = np.abs(np.fft.rfft(frames, axis=2)) ** 2
    level = 10 * np.log10(np.maximum(power @ mel_filters(rate, n_fft, bands).T, 1e-10))
    level = np.maximum(level, level.max(axis=(1, 2), keepdims=True) - 80)
    k, n = np.arange(count)[:, None], np.arange(bands)[None]
    cosine = np.cos(np.pi * k * (2 * n + 1) / (2 * bands)) * np.sqrt(2 / bands)
    cosine[0] /= np.sqrt(2)
    return np.einsum("cb,rtb->rct", cosine, level)


def voice_features(x: np.ndarray, rate: int, n_fft: int, hop: int, count: int = 13, bands: int = 128) -> np.ndarray:
    """rows x 3 count: coefficients, their first and second differences, pooled by the mean over frames."""
    c = mfcc(x, rate, n_fft, hop, count, bands)
    frames = c.shape[2]
    if frames < 9:
        raise ValueError(f"{frames} frames; differences need 9")
    return np.concatenate([c, c @ delta_matrix(frames, 1).T, c @ delta_matrix(frames, 2).T], axis=1).mean(axis=2)


def _by_length(values: pd.Series, measure: Callable[[np.ndarray], np.ndarray]) -> list:
    out: list = [None] * len(values)
    places: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and len(v):
            places.setdefault(len(v), []).append(i)
    for at in places.values():
        for i, r in zip(at, measure(np.stack([np.asarray(values.iloc[i], float) for i in at])), strict=True):
            out[i] = r
    return out


def spectral_entropy(a: Column, segment: int = 256) -> Column:
    @F.pandas_udf(DoubleType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(_by_length(values, lambda x: entropy(x, segment)), dtype=float)

    return run(a)


def pooled_features(a: Column, rate: int = 16_000, n_fft: int = 2048, hop: int = 512, count: int = 13, bands: int = 128) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(_by_length(values, lambda x: voice_features(x, rate, n_fft, hop, count, bands)), dtype=object)

    return run(a)
