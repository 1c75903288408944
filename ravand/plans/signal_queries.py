"""Queries of the array and signal operators (A, I10, I12, I13, I16) over embeddings as sample arrays.

Sums over doubles depend on their order only within an array, which both engines walk from the left; what is
aggregated over rows is compared in millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravand.functions import arrays as A
from ravand.functions.spectral import pooled_features, spectral_entropy
from ravand.operators.clustering import centroid_silhouette, cluster_speakers, silhouette_points
from ravand.operators.islands import speech_islands, with_rank
from ravand.plans.registry import query, table

SUM = "list_sum(list_transform({0}, lambda x: cast(x as double)))"
E = "list_transform(embedding, lambda x: cast(x as double))"
RMS = "sqrt(list_sum(list_transform({0}, lambda x: cast(x as double) * cast(x as double))) / len({0}))"


def micro(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("double")


def s_micro(c: str) -> str:
    return f"floor(({c}) * 1e6 + 0.5)"


def summed(a: Column) -> Column:
    """An array's checksum: the sum of its values times their places."""
    return micro(F.aggregate(F.transform(a, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x))


def s_summed(a: str) -> str:
    return s_micro(f"list_sum(list_transform({a}, lambda x, i: cast(x as double) * i))")


def signal(name: str, columns: Callable[[Column], dict[str, Column]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return e.select("vec_id", *[c.alias(n) for n, c in columns(F.col("embedding")).items()])

    query(name, f"select vec_id, {sql} from embeddings")(run)


signal("a01_mono", lambda a: {"size": F.size(A.mono(a)), "checksum": summed(A.mono(a))}, f"len(embedding) // 2 as size, {s_summed('list_transform(range(1, len(embedding), 2), lambda k: (embedding[k] + embedding[k + 1]) / 2)')} as checksum")
signal("a02_offset", lambda a: {"checksum": summed(A.without_offset(F.transform(a, lambda x: x.cast("double") * 1000)))}, s_summed(f"list_transform(list_transform({E}, lambda x: x * 1000), lambda x: trunc(greatest(-32768.0e0, least(32767.0e0, x - list_sum(list_transform({E}, lambda z: z * 1000)) / len(embedding)))))") + " as checksum")
_GAIN = f"greatest(-20.0e0, least(20.0e0, -20.0e0 - 20.0e0 * log10({RMS.format('embedding')})))"
signal("a03_gain", lambda a: {"gain_e6": micro(A.loudness_gain(a)), "rms_e6": micro(A.rms(a))}, f"{s_micro(f'case when abs({_GAIN}) > 1 then {_GAIN} else 0.0e0 end')} as gain_e6, {s_micro(RMS.format('embedding'))} as rms_e6")
_PEAK = "list_max(list_transform(embedding, lambda x: abs(cast(x as double))))"
_SCALED = f"list_transform({E}, lambda x: x / {_PEAK} * 0.95e0)"
signal("a04_normalized", lambda a: {"checksum": summed(A.normalized(a)), "peak_e6": micro(A.peak(a).cast("double"))}, f"{s_summed(f'list_transform({_SCALED}, lambda x: x * (0.1e0 / {RMS.format(_SCALED)}))')} as checksum, {s_micro(_PEAK)} as peak_e6")
_CHANGES = "list_filter(range(2, len(embedding) + 1), lambda i: (embedding[i] < -1e-10) <> (embedding[i - 1] < -1e-10))"


def s_crossings(frame: int, hop: int) -> str:
    return f"list_avg(list_transform(range(0, len(embedding) // {hop} + 1), lambda t: len(list_filter({_CHANGES}, lambda i: i - 1 > t * {hop} - {frame // 2} and i - 1 < t * {hop} + {frame // 2})) / {frame}.0e0)) as zcr"


signal("a06_zero_crossings", lambda a: {"zcr": A.zero_crossings(a)}, s_crossings(2048, 512))
signal("a06_short_frames", lambda a: {"zcr": A.zero_crossings(a, 16, 8)}, s_crossings(16, 8))
signal("a09_volume", lambda a: {"checksum": summed(A.changed_volume(a, 4.0))}, s_summed(f"case when {_PEAK} * 4.0e0 > 1 then list_transform({E}, lambda x: x * 4.0e0 / ({_PEAK} * 4.0e0) * 0.95e0) else list_transform({E}, lambda x: x * 4.0e0) end") + " as checksum")
signal("a17_guarded", lambda a: {"checksum": summed(A.guarded(F.transform(a, lambda x: x.cast("double") * 3)))}, s_summed(f"case when {_PEAK} * 3 > 1.0 then list_transform({E}, lambda x: x * 3 / ({_PEAK} * 3)) else list_transform({E}, lambda x: x * 3) end") + " as checksum")
_LOUD = "list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) > 0.1)"
signal("i12_trim_silence", lambda a: {"size": F.size(A.trimmed_silence(a, 0.1)), "checksum": summed(A.trimmed_silence(a, 0.1))}, "len({0}) as size, {1} as checksum".format(_t := f"case when len({_LOUD}) = 0 then embedding else embedding[list_min({_LOUD}):list_max({_LOUD})] end", s_summed(_t)))
signal("i13_segment", lambda a: {"checksum": summed(A.segment(a, F.lit(0.5), F.lit(2.25), 16))}, s_summed("embedding[9:36]") + " as checksum")
signal("i16_padded", lambda a: {"size": F.size(A.padded(a, 80)), "checksum": summed(A.padded(a, 80))}, f"greatest(80, len(embedding)) as size, {s_summed('embedding')} as checksum")
signal("a16_joined", lambda a: {"size": F.size(A.joined_with_gap(a, a, F.lit(0.5), 16)), "checksum": summed(A.joined_with_gap(a, a, F.lit(0.5), 16))}, f"2 * len(embedding) + 8 as size, {s_summed('list_concat(list_concat(embedding, list_transform(range(0, 8), lambda i: 0.0)), embedding)')} as checksum")


_CENTRED = f"list_transform({E}, lambda x, i: (x - list_sum({E}) / len(embedding)) * (0.5e0 - 0.5e0 * cos(2 * pi() * (i - 1) / len(embedding))))"
_WAVE = "list_sum(list_transform(y, lambda x, i: x * {0}(2 * pi() * k * (i - 1) / len(y))))"


@query(
    "a05_signal_quality",
    f"""with x as (select vec_id, unnest({E}) as x from embeddings), q as (select vec_id, quantile_cont(abs(x), 0.1) as p from x group by vec_id),
        y as (select vec_id, {_CENTRED} as y from embeddings),
        w as (select vec_id, k, case when k = 0 or k * 2 = len(y) then 1 else 2 end * (pow({_WAVE.format("cos")}, 2) + pow({_WAVE.format("sin")}, 2)) as w from (select *, unnest(range(0, len(y) // 2 + 1)) as k from y)),
        h as (select vec_id, -sum(case when w > 0 then w / t * ln(w / t) else 0 end) as h from (select *, sum(w) over (partition by vec_id) as t from w) group by vec_id),
        s as (select vec_id, h, 10 * log10(list_sum(list_transform({E}, lambda x: x * x)) / len(embedding) / greatest(p * p, 1e-10)) as snr from embeddings join q using (vec_id) join h using (vec_id))
        select vec_id, {s_micro("snr")} as snr_e6, {s_micro("h")} as entropy_e6, case when snr > 20 and h < 8 then 'EXCELLENT' when snr > 15 and h < 10 then 'GOOD' when snr > 10 then 'FAIR' else 'POOR' end as quality from s""",
)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-to-noise ratio over the tenth percentile of the magnitudes, entropy of the spectrum, and the class they give (A5)."""

    def tenth(sorted_magnitudes: Column) -> Column:
        place = (F.size(sorted_magnitudes) - 1) * F.lit(0.1)
        low = F.floor(place).cast("int")
        a, b = F.get(sorted_magnitudes, low), F.get(sorted_magnitudes, F.least(low + 1, F.size(sorted_magnitudes) - 1))
        return a + (b - a) * (place - low)

    floor = A.let(F.array_sort(F.transform("embedding", lambda x: F.abs(x.cast("double")))), tenth)
    power = A.total(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))) / F.size("embedding")
    s = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", floor.alias("p"), power.alias("power"))
    s = s.select("vec_id", (F.lit(10) * F.log10(F.col("power") / F.greatest(F.col("p") * F.col("p"), F.lit(1e-10)))).alias("snr"), spectral_entropy(F.transform("embedding", lambda x: x.cast("double"))).alias("h"))
    quality = F.when((F.col("snr") > 20) & (F.col("h") < 8), "EXCELLENT").when((F.col("snr") > 15) & (F.col("h") < 10), "GOOD").when(F.col("snr") > 10, "FAIR").otherwise("POOR")
    return s.select("vec_id", micro(F.col("snr")).alias("snr_e6"), micro(F.col("h")).alias("entropy_e6"), quality.alias("quality"))


@query("a08_noise")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White noise by hash of (row, place), so that a second run gives the same; brought down to 0.95 if over one."""
    e = table(spark, sf_dir, "embeddings")
    noise = F.transform("embedding", lambda x, i: x.cast("double") + (F.pmod(F.xxhash64("vec_id", i), F.lit(2_000_001)) / 1_000_000.0 - 1.0) * 0.01)
    return e.select("vec_id", noise.alias("n")).select("vec_id", A.changed_volume(F.col("n"), 1.0).alias("samples"))


TAPS = [2.718281828459045 ** (-k / 2.0) for k in range(8)]
TAPS = [t / sum(TAPS) for t in TAPS]
_WET = "list_sum(list_transform({1}, lambda t, k: case when i + 4 - k between 1 and len({0}) then {0}[i + 4 - k] * t else 0.0e0 end))".format(E, "[" + ", ".join(f"{t!r}::double" for t in TAPS) + "]")


@query("a10_reverb", f"select vec_id, {s_summed(f'list_transform(range(1, len(embedding) + 1), lambda i: ({E})[i] * 0.7e0 + {_WET} * 0.3e0)')} as checksum from embeddings")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of the signal and 0.3 of its convolution with a decay of eight taps (A10)."""
    a = F.col("embedding")

    def sample(i: Column) -> Column:
        wet = F.lit(0.0)
        for k, t in enumerate(TAPS):
            at = i + 3 - k  # the middle of the full convolution
            wet = wet + F.when((at >= 0) & (at < F.size(a)), F.get(a, at).cast("double") * t).otherwise(0.0)
        return F.get(a, i).cast("double") * 0.7 + wet * 0.3

    return table(spark, sf_dir, "embeddings").select("vec_id", summed(F.transform(F.sequence(F.lit(0), F.size(a) - 1), sample)).alias("checksum"))


@query("a12_augmented_names", "select vec_id, 'clip_' || vec_id || '_aug_' || i || '.wav' as name from (select vec_id, unnest(range(1, least(3, 5) + 1)) as i from embeddings)")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each augmented copy of a file, at most `most`."""
    factor, most = 3, 5
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(factor), F.lit(most)))).alias("i"))
    return e.select("vec_id", F.concat(F.lit("clip_"), F.col("vec_id").cast("string"), F.lit("_aug_"), F.col("i").cast("string"), F.lit(".wav")).alias("name"))


@query("a13_mean_pool", f"select label, i, {s_micro('avg(cast(x as double))')} as mean_e6 from (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings pooled by the mean of each dimension."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return x.groupBy("label", (F.col("p") + 1).cast("bigint").alias("i")).agg(micro(F.avg(F.col("x").cast("double"))).alias("mean_e6"))


@query("a13_voice_features")
def a13b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cepstral coefficients with their first and second differences, pooled by the mean (A13); frames fit arrays of 64 samples."""
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", pooled_features(samples, rate=16_000, n_fft=32, hop=4, bands=20).alias("features"))


@query("a14_speaker_clusters")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("file_id", F.col("vec_id") % 10)
    return cluster_speakers(e, "file_id", "vec_id", "embedding", most=5)


@query(
    "a15_silhouette",
    """with d as (select a.vec_id, a.label as own, b.label as c, sum(list_distance(list_transform(a.embedding, lambda x: cast(x as double)), list_transform(b.embedding, lambda x: cast(x as double)))) as t, count(*) as n from embeddings a join embeddings b on true group by all),
            s as (select vec_id, max(case when c = own then case when n > 1 then t / (n - 1) else -1 end end) as i, min(case when c <> own then t / n end) as o from d group by vec_id)
       select count(*) as n, floor(avg(case when i < 0 or o is null then 0 else (o - i) / greatest(o, i) end) * 1e6 + 0.5) as silhouette_e6 from s""",
)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silhouette_points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").agg(F.count(F.lit(1)).alias("n"), micro(F.avg("silhouette")).alias("silhouette_e6"))


@query(
    "a15_centroid_silhouette",
    f"""with m as (select label, i, avg(x) as m from (select label, unnest({E}) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i), l as (select label, list(m order by i) as m from m group by label),
             d as (select vec_id, e.label as own, l.label as c, list_distance({E}, l.m) as d from embeddings e join l on true),
             s as (select vec_id, max(case when c = own then d end) as i, min(case when c <> own then d end) as o from d group by vec_id)
       select vec_id, {s_micro("(o - i) / greatest(o, i)")} as silhouette_e6 from s""",
)
def a15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("vec_id", micro(F.col("silhouette")).alias("silhouette_e6"))


RATE, FRAME, HOP = 1000, 25, 10


@query(
    "i10_energy_islands",
    f"""with x as (select label, cast(x as double) as x, row_number() over (partition by label order by vec_id, k) - 1 as p from (select label, vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as k from embeddings)),
             l as (select label, count(*) as len from x group by label), f as (select label, unnest(range(0, len - {FRAME}, {HOP})) as s from l),
             e as (select f.label, f.s // {HOP} as i, sum(x * x) as en from f join x on f.label = x.label and p >= s and p < s + {FRAME} group by f.label, f.s),
             t as (select label, quantile_cont(floor(en * 1e9 + 0.5), 0.4) as th from e group by label),
             b as (select e.label, i, floor(en * 1e9 + 0.5) > th as sp from e join t on e.label = t.label), c as (select *, lag(sp) over (partition by label order by i) as q from b),
             g as (select *, sum(case when sp and not coalesce(q, false) then 1 else 0 end) over (partition by label order by i) as g from c),
             r as (select g.label, min(i) as a, max(i) + 1 as z from g where sp group by g.label, g), m as (select label, max(i) + 1 as n from e group by label)
        select r.label, a * {HOP} as start_ms, case when z = n then len else z * {HOP} end as end_ms from r join m using (label) join l using (label) where (case when z = n then len else z * {HOP} end) - a * {HOP} >= 50""",
)
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy voice activity (I10): frames over the 40th percentile of their energy, islands of 50 ms or more.

    The z-score keeps the order of the energies, so the threshold is taken on the energies themselves. Signals
    are the embeddings of a label one after another; samples are ranked in steps of vectors and runs found in
    blocks of frames, so no window spans a signal.
    """
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "x"))
    x = with_rank(e, ["label"], F.floor(F.col("vec_id") / 100), ["vec_id", "k"], "r").select("label", F.col("x").cast("double").alias("x"), (F.col("r") - 1).alias("p"))
    # a sample lies in the frames that begin up to FRAME before it: two or three of them
    frames = x.select("label", "x", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("p") - FRAME + 1) / HOP)).cast("bigint"), F.floor(F.col("p") / HOP).cast("bigint"))).alias("i"))
    lengths = x.groupBy("label").agg((F.max("p") + 1).alias("len"))
    en = frames.join(lengths, "label").where(F.col("i") * HOP < F.col("len") - FRAME).groupBy("label", "i", "len").agg(F.floor(F.sum(F.col("x") * F.col("x")) * 1e9 + 0.5).cast("double").alias("en"))
    th = en.groupBy("label").agg(F.percentile("en", F.lit(0.4)).alias("th"), (F.max("i") + 1).alias("n"), F.max("len").alias("len"))
    speech = en.join(th.select("label", "th"), "label").select(F.col("label").alias("file_id"), F.col("i").alias("frame_no"), (F.col("en") > F.col("th")).alias("is_speech"))
    r = speech_islands(speech, 1).withColumnRenamed("file_id", "label").join(th, "label")  # a frame is a step here
    end = F.when(F.col("end_ms") == F.col("n"), F.col("len")).otherwise(F.col("end_ms") * HOP)
    return r.select("label", (F.col("start_ms") * HOP).alias("start_ms"), end.alias("end_ms")).where("end_ms - start_ms >= 50")
