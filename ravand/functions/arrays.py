"""Column builders over sample arrays: scaling, loudness, trimming, framing. A null array gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once for each row, not once for each element that refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def rms(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) / F.size(a))


def mono(interleaved: Column) -> Column:
    """Mean of each two neighbours (A1)."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(interleaved) / 2).cast("int") - 1)
    return F.transform(pairs, lambda k: (F.get(interleaved, k * 2) + F.get(interleaved, k * 2 + 1)) / 2)


def without_offset(a: Column, low: float = -32768.0, high: float = 32767.0) -> Column:
    """The mean taken away, clipped and cut to whole numbers (A2)."""
    return let(mean(a), lambda m: F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double") - m)).cast("int")))


def loudness_gain(a: Column, target_db: float = -20.0) -> Column:
    """Gain in dB to the target, within 20; none if under 1 (A3). Silence gets none."""
    level = F.lit(20.0) * F.log10(rms(a))
    gain = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.lit(target_db) - level))
    return F.when(rms(a) > 0, F.when(F.abs(gain) > 1, gain).otherwise(0.0)).otherwise(0.0)


def normalized(a: Column, target_db: float = -20.0) -> Column:
    """Peak to 0.95, then the level to the target (A4)."""
    scaled = let(peak(a), lambda p: F.when(p > 0, F.transform(a, lambda x: x.cast("double") / p * 0.95)).otherwise(F.transform(a, lambda x: x.cast("double"))))

    def to_level(y: Column) -> Column:
        return let(rms(y), lambda level: F.when(level > 0, F.transform(y, lambda x: x * (F.lit(10 ** (target_db / 20)) / level))).otherwise(y))

    return let(scaled, to_level)


def changed_volume(a: Column, factor: float) -> Column:
    """Scaled; brought down to 0.95 if it would clip."""
    scaled = F.transform(a, lambda x: x.cast("double") * factor)
    return let(scaled, lambda y: let(peak(y), lambda p: F.when(p > 1.0, F.transform(y, lambda x: x / p * 0.95)).otherwise(y)))


def guarded(a: Column) -> Column:
    """Divided by the peak where that is over one."""
    plain = F.transform(a, lambda x: x.cast("double"))
    return let(plain, lambda y: let(peak(y), lambda p: F.when(p > 1.0, F.transform(y, lambda x: x / p)).otherwise(y)))


def trimmed_silence(a: Column, threshold: float) -> Column:
    """From the first to the last sample over the threshold; unchanged if there is none."""
    loud = F.filter(F.transform(a, lambda x, i: F.when(F.abs(x) > threshold, i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(loud) == 0, a).otherwise(F.slice(a, F.array_min(loud), F.array_max(loud) - F.array_min(loud) + 1))


def segment(a: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples int(start * rate) to int(end * rate)."""
    first = F.floor(start * rate).cast("int")
    return F.slice(a, first + 1, F.greatest(F.floor(end * rate).cast("int") - first, F.lit(0)))


def padded(a: Column, size: int) -> Column:
    """Zeros behind, up to `size` (I16)."""
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def joined_with_gap(a: Column, b: Column, gap_seconds: Column, rate: int) -> Column:
    """Two segments with zeros for the gap between them; an overlap gets none."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    return F.concat(d(a), F.array_repeat(F.lit(0.0), F.greatest(F.floor(gap_seconds * rate).cast("int"), F.lit(0))), d(b))


def zero_crossings(a: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Mean over frames, centred on every `hop`-th sample and padded with the outermost ones, of the share of samples at which the sign changes.

    Magnitudes up to 1e-10 count as zero, which is not negative; the first sample of a frame is no change.
    """

    def share(changes: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / hop).cast("int")), lambda t: t * hop - frame // 2)
        return F.transform(starts, lambda s: F.size(F.filter(changes, lambda i: (i > s) & (i < s + frame))) / F.lit(float(frame)))

    low = F.transform(a, lambda x: x < -1e-10)
    changes = let(low, lambda z: F.filter(F.transform(z, lambda x, i: F.when((i > 0) & (x != F.get(z, i - 1)), i)), lambda i: i.isNotNull()))
    return F.when(F.size(a) > 0, let(changes, lambda c: mean(share(c))))


def frame_energies(a: Column, frame: int, hop: int) -> Column:
    """Sums of squares of frames at every hop before len - frame."""
    starts = F.sequence(F.lit(1), F.size(a) - frame, F.lit(hop))
    return F.transform(starts, lambda i: total(F.transform(F.slice(a, i, frame), lambda x: x.cast("double") * x.cast("double"))))
