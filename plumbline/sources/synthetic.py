"""Recordings with known truth, as expressions of the record number: any part of a cohort can be made anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that follows from the record and a salt alone."""
    return (F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")


def normal(key: Column, salt: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, salt + "a") + F.lit(1e-12))) * F.cos(2 * math.pi * uniform(key, salt + "b"))


def bump(at: Column, centre: Column, half: Column | float) -> Column:
    """A raised cosine of height 1, 0 outside centre +- half."""
    u = F.abs(at - centre) / half
    return F.when(u < 1, (1 + F.cos(math.pi * u)) / 2).otherwise(0.0)


def cohort(spark: SparkSession, n: int, fs: int = 250, seconds: int = 10, noise: float = 0.02, wander: float = 0.05, seed: int = 7) -> DataFrame:
    """record_id, patient_id, age, sex, fs, rate, true_peaks array<int>, signal array<double> (one lead, mV).

    Every tenth patient has two records. A beat is a P wave, a QRS lobe with a dip on both sides and a T wave at fixed
    places before and after its R peak; beats follow each other by 60 / rate seconds with 3 % jitter.
    """
    key = F.concat_ws(":", F.lit(seed), F.col("id"))
    rows = spark.range(n).withColumn("patient_id", F.col("id") - F.when(F.col("id") % 10 == 9, 1).otherwise(0))
    person = F.concat_ws(":", F.lit(seed), F.col("patient_id"))
    rows = rows.withColumn("age", F.floor(20 + 70 * uniform(person, "age")).cast("double")).withColumn("sex", (uniform(person, "sex") < 0.5).cast("int"))
    rate = F.least(F.greatest(70 + 10 * normal(key, "rate") - 0.2 * (F.col("age") - 40), F.lit(35.0)), F.lit(150.0))
    rows = rows.withColumn("fs", F.lit(fs)).withColumn("rate", rate)
    beat = F.lit(float(fs)) * 60 / F.col("rate")
    jitter = lambda i: 0.03 * (2 * uniform(F.concat_ws(":", key, i), "rr") - 1)
    many = F.sequence(F.lit(0), F.ceil(F.lit(seconds) * F.col("rate") / 60).cast("int"))
    peaks = F.transform(many, lambda i: F.round(F.lit(0.4 * fs) + beat * (i + jitter(i))).cast("int"))
    rows = rows.withColumn("true_peaks", F.filter(peaks, lambda p: (p >= round(0.1 * fs)) & (p < seconds * fs - round(0.1 * fs))))

    def sample(t: Column) -> Column:
        waves = [(-0.16, 0.045, 0.12), (0.0, 0.02, 1.1), (-0.03, 0.015, -0.1), (0.03, 0.015, -0.2), (0.26, 0.08, 0.3)]
        beats = F.aggregate("true_peaks", F.lit(0.0), lambda acc, p: acc + sum((h * bump(t, p + c * fs, w * fs) for c, w, h in waves), F.lit(0.0)))
        drift = wander * F.sin(2 * math.pi * 0.3 * t / fs)
        return beats + drift + noise * normal(F.concat_ws(":", key, t), "noise")

    signal = F.transform(F.sequence(F.lit(0), F.lit(seconds * fs - 1)), lambda t: sample(t))
    return rows.withColumn("signal", signal).select(F.format_string("rec%06d", "id").alias("record_id"), "patient_id", "age", "sex", "fs", "rate", "true_peaks", "signal")
