"""Attribution by named signal segment, null controls, and occlusion against matched controls."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of the segments that may claim a sample; what none claims is "other".
PRECEDENCE = ["qrs", "p", "t"]


def segment_of(at: Column, spans: dict[str, tuple[int, int]]) -> Column:
    """The segment of a sample position; spans are inclusive, earlier names of PRECEDENCE win."""
    out = F
    for name in PRECEDENCE:
        if name in spans:
            out = out.when(at.between(*spans[name]), name)
    return out.otherwise("other")


def segments_of_beats(samples: DataFrame, beats: DataFrame, key: str, at: str) -> DataFrame:
    """samples with segment added. beats: key, segment, onset, offset (inclusive).

    Containment becomes an equality: every span is spread over its samples, the first by precedence wins.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), F.col("segment"))
    spread = beats.select(F.col(key).alias("k"), F.explode(F.sequence("onset", "offset")).alias("s"), rank.alias("rank"))
    owner = spread.groupBy("k", "s").agg(F.min("rank").alias("rank"))
    joined = samples.join(owner, (F.col(key) == F.col("k")) & (F.col(at) == F.col("s")), "left").drop("k", "s")
    names = F.array(*[F.lit(p) for p in PRECEDENCE])
    return joined.withColumn("segment", F.when(F.col("rank").isNull(), "other").otherwise(names[(F.col("rank") - 1).cast("int")])).drop("rank")


def by_segment(samples: DataFrame, key: str, value: str) -> DataFrame:
    """key, lead, segment, share, density, signed_share.

    share: of the record's total magnitude; density: share over the segment's share of all samples.
    """
    each = samples.groupBy(key, "lead", "segment").agg(F.sum(F.abs(value)).alias("mass"), F.sum(value).alias("signed"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(key)
    total, all_n = F.sum("mass").over(own), F.sum("n").over(own)
    return each.select(
        key, "lead", "segment", F.try_divide("mass", total).alias("share"),
        F.try_divide(F.try_divide("mass", total), F.col("n") / all_n).alias("density"), F.try_divide("signed", total).alias("signed_share"),
    )


def cohort_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("lead", "segment").agg(F.avg("share").alias("share_mean"), F.stddev_samp("share").alias("share_sd"), F.avg("density").alias("density_mean"), F.stddev_samp("density").alias("density_sd"), F.avg("signed_share").alias("signed_share_mean"))


def dominant(segments: DataFrame, key: str) -> DataFrame:
    """The named segment with the largest share of each record; "other" doesn't compete."""
    named = segments.where("segment <> 'other'").groupBy(key, "segment").agg(F.sum("share").alias("share"))
    best = named.groupBy(key).agg(F.max(F.struct("share", "segment")).alias("b"))
    return best.select(key, F.col("b.segment").alias("segment"), F.col("b.share").alias("share"))


def paired_difference(trained: DataFrame, control: DataFrame, key: str, level: float = 0.95) -> DataFrame:
    """segment, n, mean, se, low, high of trained minus control share; intervals are Bonferroni-corrected over segments."""
    a = trained.groupBy(key, "segment").agg(F.sum("share").alias("a"))
    b = control.groupBy(F.col(key).alias("k"), F.col("segment").alias("s")).agg(F.sum("share").alias("b"))
    d = a.join(b, (F.col(key) == F.col("k")) & (F.col("segment") == F.col("s"))).withColumn("d", F.col("a") - F.col("b"))
    out = d.groupBy("segment").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d").cast("double"))).alias("se"))
    tests = out.agg(F.count(F.lit(1)).alias("tests"))
    # The quantile of a handful of possible test counts: there are at most len(PRECEDENCE) + 1 segments.
    z = F.element_at(F.array(*[F.lit(NormalDist().inv_cdf(1 - (1 - level) / n / 2)) for n in range(1, len(PRECEDENCE) + 2)]), F.col("tests").cast("int"))
    out = out.join(F.broadcast(tests)).withColumn("z", z)
    return out.select("segment", "n", "mean", "se", (F.col("mean") - F.col("z") * F.col("se")).alias("low"), (F.col("mean") + F.col("z") * F.col("se")).alias("high"))


def elevation(samples: DataFrame, key: str, value: str, segment: str) -> DataFrame:
    """lead, n, elevation, low, high: a segment's mean over records minus that of the rest, by lead, 95% interval."""
    each = samples.groupBy(key, "lead").agg(F.avg(F.when(F.col("segment") == segment, F.col(value))).alias("a"), F.avg(F.when(F.col("segment") != segment, F.col(value))).alias("b"))
    d = F.col("a") - F.col("b")
    out = each.groupBy("lead").agg(F.count(d).alias("n"), F.avg(d).alias("elevation"), (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))).alias("se"))
    z = NormalDist().inv_cdf(0.975)
    return out.select("lead", "n", "elevation", (F.col("elevation") - z * F.col("se")).alias("low"), (F.col("elevation") + z * F.col("se")).alias("high"))


def occluded_scores(samples: DataFrame, key: str, value: str, weight: str, named: list[str]) -> DataFrame:
    """key, segment, effect, control: change of a linear score when a segment's samples become the lead's median,
    and when as many samples of "other", chosen by hash, do. The control has fewer if "other" has fewer."""
    medians = samples.groupBy(F.col(key).alias("mk"), F.col("lead").alias("ml")).agg(F.median(value).alias("m"))
    s = samples.join(medians, (F.col(key) == F.col("mk")) & (F.col("lead") == F.col("ml")))
    s = s.withColumn("change", (F.col("m") - F.col(value)) * F.col(weight))
    by_hash = Window.partitionBy(key, "segment").orderBy(F.md5(F.concat_ws(":", key, "lead", "at")), "lead", "at")
    s = s.withColumn("place", F.row_number().over(by_hash))
    size = s.where(F.col("segment").isin(named)).groupBy(key, "segment").agg(F.sum("change").alias("effect"), F.count(F.lit(1)).alias("n"))
    other = s.where("segment = 'other'").select(F.col(key).alias("ok"), "place", F.col("change").alias("c"))
    control = size.select(key, "segment", "n").join(other, (F.col(key) == F.col("ok")) & (F.col("place") <= F.col("n"))).groupBy(F.col(key).alias("ck"), F.col("segment").alias("cs")).agg(F.sum("c").alias("control"))
    return size.join(control, (F.col(key) == F.col("ck")) & (F.col("segment") == F.col("cs")), "left").select(key, "segment", "n", "effect", F.coalesce("control", F.lit(0.0)).alias("control"))


def occlusion(scores: DataFrame) -> DataFrame:
    """segment, n, effect, control, paired difference of magnitudes with its standard error, share with a rise."""
    d = F.abs("effect") - F.abs("control")
    return scores.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("effect"), F.avg("control").alias("control"), F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))).alias("se"), F.avg((F.col("effect") > 0).cast("double")).alias("older"))


def integrated_gradients(samples: DataFrame, value: str, baseline: str, weight: str, curve: float, steps: int) -> DataFrame:
    """Adds attribution of f(x) = sum(w x + curve x^2) by the midpoint rule: (x - x0) times the mean gradient."""
    path = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: (s - 0.5) / F.lit(float(steps)))
    delta = F.col(value) - F.col(baseline)
    gradient = F.aggregate(path, F.lit(0.0), lambda acc, a: acc + F.col(weight) + 2 * F.lit(curve) * (F.col(baseline) + a * delta)) / steps
    return samples.withColumn("attribution", delta * gradient)


def completeness(attributed: DataFrame, key: str, value: str, baseline: str, weight: str, curve: float, absolute: float = 1.0, relative: float = 0.05) -> DataFrame:
    """key, total, span, error, flagged: attributions must sum to f(x) - f(x0)."""
    f = lambda c: F.col(weight) * F.col(c) + curve * F.col(c) * F.col(c)
    out = attributed.groupBy(key).agg(F.sum("attribution").alias("total"), F.sum(f(value) - f(baseline)).alias("span"))
    error = F.col("total") - F.col("span")
    return out.withColumn("error", error).withColumn("flagged", F.abs("error") > absolute + relative * F.abs("span"))


def tail(level: float, tests: int) -> float:
    """The tail probability of each side of a Bonferroni-corrected interval."""
    return (1 - level) / tests / 2 if tests else math.nan


def input_times_gradient(samples: DataFrame, value: str, weight: str, curve: float) -> DataFrame:
    """Adds attribution of f(x) = sum(w x + curve x^2): the value times the gradient there."""
    return samples.withColumn("attribution", F.col(value) * (F.col(weight) + 2 * F.lit(curve) * F.col(value)))


def against_controls(trained: DataFrame, controls: dict[str, DataFrame], key: str, level: float = 0.95) -> DataFrame:
    """method, segment, n, mean, se, low, high, departs: the trained share less each control's, paired by record.

    trained and controls come from by_segment. Intervals are corrected for all tests, segments times controls; departs
    says that one excludes 0, and is null where fewer than two records have both.
    """
    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("_key"), F.col("segment").alias("_segment")).agg(F.sum("share").alias(name))

    own = shares(trained, "a")
    tagged = None
    for method, df in controls.items():
        one = shares(df, "b").select(F.lit(method).alias("method"), F.col("_key").alias("k"), F.col("_segment").alias("segment"), "b")
        tagged = one if tagged is None else tagged.unionByName(one)
    d = tagged.join(own, (F.col("_key") == F.col("k")) & (F.col("_segment") == F.col("segment"))).withColumn("d", F.col("a") - F.col("b"))
    out = d.groupBy("method", "segment").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d").cast("double"))).alias("se"))
    z = NormalDist().inv_cdf(1 - tail(level, (len(PRECEDENCE) + 1) * len(controls)))
    out = out.withColumn("low", F.col("mean") - z * F.col("se")).withColumn("high", F.col("mean") + z * F.col("se"))
    return out.withColumn("departs", (F.col("low") > 0) | (F.col("high") < 0))


def elevation_summary(elevations: DataFrame) -> DataFrame:
    """segment, leads, mean, low, high (smallest and largest) of the leads' elevations, n_above: leads whose interval is above 0."""
    return elevations.groupBy("segment").agg(
        F.count(F.lit(1)).alias("leads"), F.avg("elevation").alias("mean"), F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.count_if(F.col("low") > 0).alias("n_above"),
    )


def segment_totals(summary: DataFrame) -> DataFrame:
    """segment, share (the sum of the leads' mean shares) and density (the mean of their mean densities) of a cohort summary."""
    return summary.groupBy("segment").agg(F.sum("share_mean").alias("share"), F.avg("density_mean").alias("density"))


def attention_correlation(attributed: DataFrame, key: str, segment: str, measured: DataFrame, measured_key: str, columns: list[str]) -> DataFrame:
    """feature, n, r: does a record's share of attribution on a segment, over all leads, follow what is measured of it?

    attributed comes from by_segment; a pair counts where both are finite. r is null without variance.
    """
    own = attributed.where(F.col("segment") == segment).groupBy(F.col(key).alias("_key")).agg(F.sum("share").alias("share"))
    rows = measured.join(own, F.col(measured_key) == F.col("_key"))
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    sound = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    each = rows.select("share", F.inline(listed)).withColumn("ok", sound(F.col("v")) & sound(F.col("share")))
    x, y = (F.when(F.col("ok"), F.col(c)) for c in ("share", "v"))
    return each.groupBy("feature").agg(F.count_if("ok").alias("n"), F.nanvl(F.corr(x, y), F.lit(None).cast("double")).alias("r"))
