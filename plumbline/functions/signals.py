"""Array functions over fixed-rate signals: envelopes, peak candidates, the adaptive threshold walk, beats as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def slope_energy(x: Column, fs: int) -> Column:
    """The squared central difference of every sample; 0 at the ends."""
    last = F.size(x) - 1
    return F.transform(x, lambda _, i: F.when((i > 0) & (i < last), F.pow((F.get(x, i + 1) - F.get(x, i - 1)) * (fs / 2.0), F.lit(2.0))).otherwise(0.0))


def moving_mean(x: Column, half: int) -> Column:
    """The centred mean over 2 * half + 1 samples, fewer at the edges. x is worked out once, not for every sample."""
    def at(x: Column, i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        high = F.least(i + half, F.size(x) - 1)
        return F.aggregate(F.slice(x, low + 1, high - low + 1), F.lit(0.0), lambda a, b: a + b) / (high - low + 1)

    return let(x, lambda x: F.transform(x, lambda _, i: at(x, i)))


def candidates(envelope: Column, apart: int) -> Column:
    """(at, height) of the samples that are the highest within so many samples on both sides; plateaus count once."""
    def highest(v: Column, i: Column) -> Column:
        before = F.array_max(F.slice(envelope, F.greatest(i - apart, F.lit(0)) + 1, F.least(i, F.lit(apart))))
        after = F.array_max(F.slice(envelope, i + 2, F.lit(apart)))
        return (v > F.coalesce(before, F.lit(-1.0))) & (v >= F.coalesce(after, F.lit(-1.0))) & (v > 0)

    every = F.transform(envelope, lambda v, i: F.when(highest(v, i), F.struct(i.alias("at"), v.alias("height"))))
    return F.filter(every, lambda c: c.isNotNull())


def threshold_walk(found: Column, envelope: Column, fs: int, learn_s: float = 2.0, refractory_s: float = 0.2) -> Column:
    """Places of accepted candidates. Signal and noise levels follow what is accepted and rejected.

    The threshold is noise + 0.25 * (signal - noise). A rejected candidate above half of it is taken after all when the
    next one comes later than 1.66 times the mean of the last intervals (the mean follows by an eighth).
    """
    head = F.slice(envelope, F.lit(1), F.lit(round(learn_s * fs)))
    signal, noise = F.array_max(head) * 0.25, F.aggregate(head, F.lit(0.0), lambda a, b: a + b) / F.size(head) * 0.5
    nothing = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("height"))
    start = F.struct(F.greatest(signal, noise + 1e-12).alias("s"), noise.alias("n"), F.lit(0.0).alias("rr"), nothing.alias("missed"), F.array().cast("array<int>").alias("beats"))

    def step(state: Column, c: Column) -> Column:
        limit = state["n"] + 0.25 * (state["s"] - state["n"])
        last = F.coalesce(F.try_element_at(state["beats"], F.lit(-1)), F.lit(-(10**9)))
        late = (state["rr"] > 0) & (c["at"] - last > 1.66 * state["rr"]) & (state["missed"]["height"] > limit / 2) & (state["missed"]["at"] - last > refractory_s * fs)
        beats = F.when(late, F.concat(state["beats"], F.array(state["missed"]["at"]))).otherwise(state["beats"])
        taken = (c["height"] > limit) & (c["at"] - F.when(late, state["missed"]["at"]).otherwise(last) > refractory_s * fs)
        gap = (c["at"] - last).cast("double")
        rr = F.when(taken & (last >= 0) & ~late, F.when(state["rr"] > 0, 0.875 * state["rr"] + 0.125 * gap).otherwise(gap)).otherwise(state["rr"])
        higher = ~taken & (c["height"] > state["missed"]["height"])
        return F.struct(
            F.when(taken, 0.125 * c["height"] + 0.875 * state["s"]).otherwise(state["s"]).alias("s"),
            F.when(taken, state["n"]).otherwise(0.125 * c["height"] + 0.875 * state["n"]).alias("n"), rr.alias("rr"),
            F.when(taken | late, nothing).when(higher, c).otherwise(state["missed"]).alias("missed"),
            F.when(taken, F.concat(beats, F.array(c["at"]))).otherwise(beats).alias("beats"),
        )

    return F.aggregate(found, start, step, lambda state: state["beats"])


def refined(x: Column, beats: Column, half: int) -> Column:
    """Each place moved to the largest sample within half; distinct, in order."""
    def top(b: Column) -> Column:
        low = F.greatest(b - half, F.lit(0))
        near = F.slice(x, low + 1, F.lit(2 * half + 1))
        return (low + F.array_position(near, F.array_max(near)).cast("int") - 1).cast("int")

    return F.array_sort(F.array_distinct(F.transform(beats, top)))


def beat_places(signal: Column, fs: int) -> Column:
    """Where the walk finds beats, before peaks are refined: array<int>, in order."""
    found = let(moving_mean(slope_energy(signal, fs), round(0.06 * fs)), lambda envelope: threshold_walk(candidates(envelope, round(0.2 * fs)), envelope, fs))
    return F.when(F.size(signal) >= fs // 2, found).otherwise(F.array().cast("array<int>"))


def orientation(x: Column, beats: Column, half: int) -> Column:
    """1 or -1: whether the largest swing around the beats points up or down. One choice for a lead."""
    near = lambda b: F.slice(x, F.greatest(b - half, F.lit(0)) + 1, F.lit(2 * half + 1))
    up = F.array_max(F.transform(beats, lambda b: F.array_max(near(b))))
    down = F.array_max(F.transform(beats, lambda b: -F.array_min(near(b))))
    return F.when(F.coalesce(up, F.lit(0.0)) >= F.coalesce(down, F.lit(0.0)), 1.0).otherwise(-1.0)


def r_peaks(signal: Column, fs: int) -> Column:
    """Places of R peaks in one lead, array<int>; empty for signals that are null, short, flat or not finite.

    The energy of the slope has no sign, so beats are found in inverted leads, too; peaks are then looked for on the side
    to which the lead points, from its middle level.
    """
    sound = (F.size(signal) >= fs // 2) & F.forall(signal, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.array_max(signal) > F.array_min(signal))
    half = max(round(0.1 * fs), 1)

    def level(x: Column) -> Column:
        return let(F.sort_array(x), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))

    def turned(x: Column, found: Column) -> Column:
        flat = let(level(x), lambda m: F.transform(x, lambda v: v - m))
        return let(F.struct(flat.alias("x"), found.alias("beats")), lambda v: let(orientation(v["x"], v["beats"], half), lambda sign: let(F.transform(v["x"], lambda y: y * sign), lambda z: refined(z, v["beats"], half))))

    def of(x: Column) -> Column:
        return let(moving_mean(slope_energy(x, fs), round(0.06 * fs)), lambda envelope: let(threshold_walk(candidates(envelope, round(0.2 * fs)), envelope, fs), lambda found: turned(x, found)))

    return F.when(F.coalesce(sound, F.lit(False)), let(signal, of)).otherwise(F.array().cast("array<int>"))


def multi_lead_peaks(recordings: DataFrame, key: str, leads: str, fs: int, reference: int = 0, least: float = 0.5, within_ms: float = 100.0) -> DataFrame:
    """key, peaks, n_leads (that found any beat): beats that enough leads vote for, whatever their polarity.

    Each lead is searched by itself. Votes less than within_ms apart are one beat; it counts if so large a share of the
    leads with beats votes for it, and lies where the reference lead has it, or at the votes' median.
    """
    votes = recordings.select(F.col(key).alias("k"), F.posexplode(leads).alias("lead", "x")).select("k", "lead", F.explode(r_peaks(F.col("x"), fs)).alias("at"))
    along = Window.partitionBy("k").orderBy("at", "lead")
    votes = votes.withColumn("fresh", F.coalesce(F.col("at") - F.lag("at").over(along) > within_ms / 1000.0 * fs, F.lit(True)).cast("int"))
    votes = votes.withColumn("beat", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    voters = votes.groupBy("k").agg(F.count_distinct("lead").alias("n_leads"))
    beats = votes.groupBy("k", "beat").agg(F.count_distinct("lead").alias("voted"), F.min(F.when(F.col("lead") == reference, F.col("at"))).alias("own"), F.floor(F.median("at")).cast("int").alias("middle"))
    kept = beats.join(voters, "k").where(F.col("voted") >= F.greatest(F.col("n_leads") * least, F.lit(1.0)))
    found = kept.groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_set(F.coalesce("own", "middle"))).alias("peaks"), F.max("n_leads").alias("n_leads"))
    out = recordings.select(key).join(found, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.coalesce("peaks", F.array().cast("array<int>")).alias("peaks"), F.coalesce("n_leads", F.lit(0)).alias("n_leads"))


def beats(recordings: DataFrame, key: str, peaks: str, fs: str) -> DataFrame:
    """key, beat, at, rr_ms: one row a beat; the first has no interval."""
    rows = recordings.select(key, F.col(fs).alias("fs"), F.posexplode(peaks).alias("beat", "at"))
    before = F.lag("at").over(Window.partitionBy(key).orderBy("beat"))
    return rows.select(key, "beat", "at", ((F.col("at") - before) * 1000.0 / F.col("fs")).alias("rr_ms"))


def interval_features(recordings: DataFrame, key: str, peaks: str, fs: str, least: int = 3) -> DataFrame:
    """key, n_beats, rr_ms (median), rr_sd_ms, heart_rate for every record; nulls below so many beats."""
    each = beats(recordings, key, peaks, fs).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("rr_ms").alias("rr"), F.stddev_samp("rr_ms").alias("sd"))
    out = recordings.select(key).join(each.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left")
    enough = F.col("n") >= least
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n_beats"), F.when(enough, F.col("rr")).alias("rr_ms"), F.when(enough, F.coalesce("sd", F.lit(0.0))).alias("rr_sd_ms"), F.when(enough, F.try_divide(F.lit(60000.0), F.col("rr"))).alias("heart_rate"))
