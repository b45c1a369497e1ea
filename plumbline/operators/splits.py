"""Splits and folds that keep a patient's rows together, leakage checks, normalization per lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.order import hash_bins, running_before


def hash_share(key: Column) -> Column:
    """A number in [0, 1) that follows from the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def patient_split(df: DataFrame, patient: str, train: float = 0.7, validation: float = 0.1) -> DataFrame:
    """Adds split: train, val or test; all rows of a patient fall on the same side, and no side is empty.

    The side follows from a hash of the patient, without a shuffle. Only where that leaves a side empty, as it may with
    few patients, are they dealt in order of the hash instead, at least one to each side. Fewer than three are an error.
    """
    def hashed(key: Column) -> Column:
        h = hash_share(key)
        return F.when(h < train, "train").when(h < train + validation, "val").otherwise("test")

    split = df.withColumn("split", hashed(F.col(patient)))
    if split.select("split").distinct().count() == 3:
        return split
    patients = df.select(F.col(patient).alias("_patient")).distinct()
    n = patients.count()
    if n < 3:
        raise ValueError(f"{n} patients can't be split three ways")
    n_validation, n_test = (max(1, round(share * n)) for share in (validation, 1 - train - validation))
    while n_validation + n_test > n - 1:
        n_validation, n_test = (n_validation - 1, n_test) if n_validation > n_test else (n_validation, n_test - 1)
    n_train = n - n_validation - n_test
    place = F.row_number().over(Window.orderBy(hash_share(F.col("_patient")), "_patient"))
    side = F.when(place <= n_train, "train").when(place <= n_train + n_validation, "val").otherwise("test")
    dealt = patients.select("_patient", side.alias("split"))
    return df.join(dealt, F.col(patient).eqNullSafe(F.col("_patient"))).drop("_patient")


def official_split(df: DataFrame, fold: Column, validation: int = 9, test: int = 10) -> DataFrame:
    return df.withColumn("split", F.when(fold == validation, "val").when(fold == test, "test").otherwise("train"))


def leaking(df: DataFrame, patient: str, split: str = "split") -> DataFrame:
    """Patients with rows in several splits."""
    return df.groupBy(patient).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def leakage(df: DataFrame, patient: str, split: str = "split") -> DataFrame:
    """Share of test rows whose patient also has training rows."""
    sides = df.groupBy(patient).agg(F.count_if(F.col(split) == "test").alias("test"), F.count_if(F.col(split) == "train").alias("train"))
    return sides.agg(F.sum("test").alias("n_test"), F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0)).alias("n_leaked"))


def folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds fold: groups stay whole. Whole numbers go round the folds; other groups by a hash."""
    kind = df.schema[group].dataType.simpleString()
    number = F.col(group) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(group)
    return df.withColumn("fold", F.pmod(number, F.lit(k)))


def leads(df: DataFrame, key: str, signal: str, n_leads: int) -> DataFrame:
    """key, lead, at, x: a flat signal as rows; consecutive runs of equal length are leads."""
    width = F.floor(F.size(signal) / n_leads)
    rows = df.select(key, width.alias("width"), F.posexplode(signal).alias("i", "x"))
    return rows.select(key, F.floor(F.col("i") / F.col("width")).cast("int").alias("lead"), F.pmod(F.col("i"), F.col("width")).cast("int").alias("at"), F.col("x").cast("double").alias("x"))


def lead_stats(long: DataFrame, dead: float = 1e-8) -> DataFrame:
    """mean and population sd of each lead; a dead lead's sd counts as 1."""
    sd = F.stddev_pop("x")
    return long.groupBy("lead").agg(F.avg("x").alias("mean"), F.when(sd < dead, 1.0).otherwise(sd).alias("sd"))


def normalized(long: DataFrame, stats: DataFrame) -> DataFrame:
    """z = (x - mean) / sd by lead; stats have one row a lead."""
    return long.join(F.broadcast(stats), "lead").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))


def stratified_folds(df: DataFrame, group: str, label: str, k: int, repeat: int = 0, name: str = "fold") -> DataFrame:
    """Adds a fold: groups stay whole, and those with a positive label are dealt out evenly, as are the others.

    Groups of each kind are dealt in the order of a hash of group and repeat, so each repeat gives other folds. The deal
    balances groups, not their rows. Rows without a group are one group; a null label is no positive.
    """
    groups = df.groupBy(F.col(group).alias("_group")).agg(F.max(F.coalesce(F.col(label) == 1, F.lit(False)).cast("int")).alias("_kind"))
    digest = F.md5(F.concat_ws(":", F.lit(str(repeat)), F.col("_group").cast("string")))
    groups = groups.withColumn("_digest", digest).withColumn("_bin", hash_bins(F.col("_digest")))
    dealt = running_before(groups, ["_kind"], "_bin", [F.col("_digest"), F.col("_group")], F.lit(1).cast("long"))
    dealt = dealt.select("_group", F.pmod("before", F.lit(k)).alias(name))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def fold_balance(df: DataFrame, fold: str, group: str, label: str) -> DataFrame:
    """fold, n, groups, positives, classes: distinct labels of the fold, two where a score can be judged in it."""
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), F.count_if(F.col(label) == 1).alias("positives"), F.count_distinct(label).alias("classes"))
