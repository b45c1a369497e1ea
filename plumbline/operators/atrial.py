"""What P waves show of the atria: terminal force, area, notch, and how much their durations differ between leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.signals import let, moving_mean
from plumbline.operators.delineation import BASELINE_MS, P_LEAST_MV, P_LONGEST_MS, P_THRESHOLD, QUIET_MS, extent, largest, middle, part, samples

#: A notch's least share of the wave's height and samples, and the smoothing in milliseconds.
NOTCH_SHARE, NOTCH_SAMPLES, NOTCH_SMOOTH_MS = 0.08, 5, 8.0
#: How much wider than the floor a spread must be to count as a measurement, and the smoothing that tells wave from noise.
FLOORS, WAVE_MS = 2.0, 24.0


def terminal_force(trace: Column, ms: float) -> Column:
    """-(length in ms * depth) of the run below 0 that ends the trace; 0 without one, null for an empty trace. ms: of a sample."""
    def of(t: Column) -> Column:
        up = F.array_position(F.transform(F.reverse(t), lambda v: v >= 0), True).cast("int")
        length = F.when(up > 0, up - 1).otherwise(F.size(t))
        return F.when(length > 0, length * ms * F.array_min(F.slice(t, F.size(t) - length + 1, length))).when(F.size(t) > 0, 0.0)

    return let(trace, of)


def notch_depth(trace: Column, width: int) -> Column:
    """The lower of the two tallest maxima less the trough between them; 0 for a wave of one hump.

    The trace is turned so that its largest swing points up and smoothed over width samples, with zeros beyond its ends.
    A notch counts from NOTCH_SHARE of the height before smoothing on, and if the two maxima, whichever are tallest, are
    two samples apart at least. Null for traces of fewer than NOTCH_SAMPLES samples.
    """
    def turned(t: Column) -> Column:
        return let(largest(F.transform(t, lambda v: F.abs(v))), lambda at: F.transform(t, lambda v: v * F.when(F.get(t, at) < 0, -1.0).otherwise(1.0)))

    def smoothed(t: Column) -> Column:
        window = lambda i: part(t, F.greatest(i - width // 2, F.lit(0)), F.least(i + (width - 1) // 2, F.size(t) - 1))
        return F.transform(t, lambda _, i: F.aggregate(window(i), F.lit(0.0), lambda a, v: a + v) / width)

    def depth(s: Column, tops: Column, height: Column) -> Column:
        a, b = (F.get(tops, F.lit(i))["at"] for i in (0, 1))
        low, high = F.least(a, b), F.greatest(a, b)
        deep = F.get(s, b) - F.array_min(part(s, low, high))
        return F.when(b.isNotNull() & (high - low >= 2) & (deep >= NOTCH_SHARE * height), deep).otherwise(0.0)

    def of(v: Column) -> Column:
        s = v["s"]
        inner = F.filter(F.sequence(F.lit(1), F.size(s) - 2), lambda i: (F.get(s, i) > F.get(s, i - 1)) & (F.get(s, i) >= F.get(s, i + 1)))
        # Tallest first.
        return let(F.array_sort(F.transform(inner, lambda i: F.struct((-F.get(s, i)).alias("down"), i.alias("at")))), lambda tops: depth(s, tops, v["height"]))

    height = F.array_max(F.transform(trace, lambda v: F.abs(v)))
    return F.when(F.size(trace) >= NOTCH_SAMPLES, let(F.struct(let(turned(trace), smoothed).alias("s"), height.alias("height")), of))


def p_waves(recordings: DataFrame, beats: DataFrame, key: str, leads: str, names: list[str], fs: int) -> DataFrame:
    """key, n_leads, beat, lead (its name), at (its number), trace (the P wave above the lead's own baseline), duration_ms.

    The baseline is the median of the lead before QRS. A lead's own wave is looked for as far around the reference
    lead's as half the longest P, and is no longer than the longest P; duration_ms is null in leads without a wave.
    Beats without P aren't listed; leads beyond the names have a null name.
    """
    half, quiet, before = max(samples(P_LONGEST_MS, fs) // 2, 1), max(samples(QUIET_MS, fs), 1), max(samples(BASELINE_MS, fs), 1)
    listed = beats.where("p_peak is not null").groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("beat", "p_onset", "p_offset", "qrs_onset")).alias("beats"))
    rows = recordings.select(key, F.size(leads).alias("n_leads"), F.posexplode(leads).alias("at", "x")).join(listed, F.col(key) == F.col("_key")).drop("_key")
    rows = rows.select(key, "n_leads", F.get(F.array(*[F.lit(n) for n in names]), "at").alias("lead"), "at", "x", F.explode("beats").alias("b"))
    # Only the samples around a beat go on from here, with places counted from the first of them.
    first = F.greatest(F.least(F.col("b.p_onset") - half, F.col("b.qrs_onset") - 1 - before), F.lit(0))
    last = F.least(F.greatest(F.col("b.p_offset") + half, F.col("b.qrs_onset")), F.size("x") - 1)
    rows = rows.select(key, "n_leads", "lead", "at", F.col("b.beat").alias("beat"), part(F.col("x"), first, last).alias("x"), *[(F.col(f"b.{c}") - first).alias(c) for c in ("p_onset", "p_offset", "qrs_onset")], first.alias("first"))
    x, end = F.col("x"), F.size("x") - 1
    high = F.greatest(F.col("qrs_onset") - 1, -F.col("first"))
    start = F.greatest(high - before, -F.col("first"))
    rows = rows.withColumn("base", F.when(high > start, middle(part(x, start, high))).otherwise(0.0))
    rows = rows.withColumn("low", F.greatest(F.col("p_onset") - half, -F.col("first"))).withColumn("high", F.least(F.col("p_offset") + half, end))
    rows = rows.withColumn("peak", F.when(F.col("high") - F.col("low") >= 3, F.col("low") + largest(F.transform(part(x, F.col("low"), F.col("high")), lambda v: F.abs(v - F.col("base"))))))
    onset, offset = extent(x, F.col("peak"), F.col("base"), F.greatest("low", F.col("peak") - half), F.least("high", F.col("peak") + half), P_THRESHOLD, quiet)
    found = (F.abs(F.get(x, F.col("peak")) - F.col("base")) >= P_LEAST_MV) & (offset > onset)
    trace = F.transform(part(x, F.col("p_onset"), F.col("p_offset")), lambda v: v - F.col("base"))
    return rows.select(key, "n_leads", "beat", "lead", "at", trace.alias("trace"), F.when(found, (offset - onset) * (1000.0 / fs)).alias("duration_ms"))


def duration_dispersion(waves: DataFrame, key: str) -> DataFrame:
    """key, p_dispersion_ms: longest less shortest P of a beat's leads, as the median over beats.

    Beats count that have a duration in half their leads and in three at least; without one the result is null.
    """
    each = waves.groupBy(key, "beat").agg(F.max("n_leads").alias("n_leads"), F.count("duration_ms").alias("n"), (F.max("duration_ms") - F.min("duration_ms")).alias("d"))
    return each.groupBy(key).agg(F.median(F.when(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_leads") / 2)), F.col("d"))).alias("p_dispersion_ms"))


def atrial_table(recordings: DataFrame, beats: DataFrame, key: str, leads: str, names: list[str], fs: int) -> DataFrame:
    """A row a recording with P waves: terminal force (V1), area and notch (II), dispersion; medians over beats."""
    ms = 1000.0 / fs
    waves = p_waves(recordings, beats, key, leads, names, fs)
    area = F.aggregate("trace", F.lit(0.0), lambda a, v: a + v) * ms
    of = lambda lead, c: F.median(F.when(F.col("lead") == lead, c))
    out = waves.groupBy(key).agg(
        of("V1", terminal_force(F.col("trace"), ms)).alias("p_terminal_force"), of("II", area).alias("p_area"),
        of("II", notch_depth(F.col("trace"), max(samples(NOTCH_SMOOTH_MS, fs), 1))).alias("p_notch_mv"),
    )
    spread = duration_dispersion(waves, key).withColumnRenamed(key, "_key")
    return out.join(spread, F.col(key) == F.col("_key")).drop("_key")


def without_dispersion(recordings: DataFrame, leads: str, fs: int, reference: int = 0) -> DataFrame:
    """The same recordings, in which every lead's waves are the reference lead's, as tall as its own, under its own noise.

    A lead is its smooth course plus what that leaves. The course becomes the reference's, times the factor that fits
    best; what is left stays. So timing is the same in all leads, and what differs between them is noise.
    """
    half = max(samples(WAVE_MS, fs) // 2, 1)
    smooth = F.transform(leads, lambda x: moving_mean(x, half))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def null(v: Column) -> Column:
        return F.transform(v["x"], lambda x, i: let(F.struct(F.get(v["s"], i).alias("own"), F.get(v["s"], F.lit(reference)).alias("of"), x.alias("x")), same))

    def same(v: Column) -> Column:
        factor = F.coalesce(F.try_divide(dot(v["own"], v["of"]), dot(v["of"], v["of"])), F.lit(0.0))
        noise = F.zip_with(v["x"], v["own"], lambda a, b: a - b)
        return let(factor, lambda k: F.zip_with(noise, v["of"], lambda e, w: e + k * w))

    return recordings.withColumn(leads, let(F.struct(F.col(leads).alias("x"), smooth.alias("s")), null))


def dispersion_reliability(recordings: DataFrame, beats: DataFrame, key: str, leads: str, names: list[str], fs: int, reference: int = 0) -> DataFrame:
    """One row: noise_floor_ms, observed_sd_ms, n_null, n_real, usable.

    noise_floor_ms: median dispersion of the same recordings with the reference lead's waves in every lead, where the
    true dispersion is zero; usable: dispersion spreads more than FLOORS times that between recordings.
    """
    own = lambda r: duration_dispersion(p_waves(r, beats, key, leads, names, fs), key)
    real = own(recordings).agg(F.stddev_samp("p_dispersion_ms").alias("observed_sd_ms"), F.count("p_dispersion_ms").alias("n_real"))
    null = own(without_dispersion(recordings, leads, fs, reference)).agg(F.median("p_dispersion_ms").alias("noise_floor_ms"), F.count("p_dispersion_ms").alias("n_null"))
    # One row each.
    out = null.join(F.broadcast(real))
    return out.select("noise_floor_ms", "observed_sd_ms", "n_null", "n_real", F.coalesce(F.col("observed_sd_ms") > FLOORS * F.col("noise_floor_ms"), F.lit(False)).alias("usable"))
