"""Selecting and describing a cohort: filters, code maps, indicators, late materialization, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order import hash_bins, quantile_bins, running_before


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def plausible(df: DataFrame, value: str, low: float, high: float, unknown: float, member: str, allowed: list) -> DataFrame:
    """Rows whose value is not the mark for unknown and lies in [low, high], and whose member is allowed."""
    return df.where((F.col(value) != unknown) & F.col(value).between(low, high) & F.col(member).isin(allowed))


def finite(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds usable: every named column is finite. Unusable rows are dropped and counted, never imputed."""
    return df.withColumn("usable", all_of([finite(c) for c in columns]))


def drop_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    u = usable(df, columns)
    return u.agg(F.count_if("usable").alias("n_used"), F.count_if(~F.col("usable")).alias("n_dropped"))


def code_map(text: Column) -> Column:
    """A stringified dict as map<string,double>; what can't be parsed is an empty map."""
    return F.coalesce(F.from_json(F.translate(text, "'", '"'), "map<string,double>"), F.create_map().cast("map<string,double>"))


def class_sets(df: DataFrame, key: str, codes: Column, statements: DataFrame, classes: list[str]) -> DataFrame:
    """key and a 0/1 column for each class; a row may have several classes or none. statements: code, diagnostic_class."""
    each = df.select(key, F.explode_outer(F.map_keys(codes)).alias("code")).join(F.broadcast(statements), "code", "left")
    return each.groupBy(key).agg(*[F.max(F.coalesce(F.col("diagnostic_class") == c, F.lit(False)).cast("int")).alias(f"dx_{c}") for c in classes])


def indicators(df: DataFrame, key: str, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """key and for every group 1 if any of the key's rows has one of the group's values."""
    return df.groupBy(key).agg(*[F.max(F.col(value).isin(v).cast("int")).alias(name) for name, v in groups.items()])


def steady(df: DataFrame, key: str, value: str, own: str, others: list[str], explicit: bool) -> DataFrame:
    """Keys without any of the others' values and, if explicit, with their own."""
    has, other = F.bool_or(F.col(value) == own), F.bool_or(F.col(value).isin(others))
    return df.groupBy(key).agg(((has & ~other) if explicit else ~other).alias("steady"))


def only_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Late materialization: the wide table's rows of the chosen keys only."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def in_all_runs(df: DataFrame, key: str, run: str) -> DataFrame:
    """Keys that every run has, with the number of runs."""
    runs = df.agg(F.count_distinct(run).alias("runs"))
    counted = df.groupBy(key).agg(F.count_distinct(run).alias("n_runs"))
    return counted.join(F.broadcast(runs), F.col("n_runs") == F.col("runs")).select(key, "n_runs")


def both_ends(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest and k smallest, ties by key; each end is a bounded top-k."""
    top = df.orderBy(F.desc(value), key).limit(k).withColumn("side", F.lit("high"))
    low = df.orderBy(F.asc(value), key).limit(k).withColumn("side", F.lit("low"))
    return top.unionByName(low)


def even_stride(df: DataFrame, key: str, wanted: int, of: int) -> DataFrame:
    """Every (of / wanted)-th row in key order: rows int(i * of / wanted) for i below wanted. Keys are numbers."""
    placed = running_before(quantile_bins(df, key), [], "_bin", [F.col(key)], F.lit(1).cast("long")).withColumnRenamed("before", "at")
    stride = of / wanted
    near = F.ceil(F.col("at") / F.lit(stride)).cast("long")
    return placed.where((F.floor(near * F.lit(stride)).cast("long") == F.col("at")) & (near < wanted)).drop("at", "_bin")


def permuted_labels(df: DataFrame, key: str, label: str, group: str) -> DataFrame:
    """key and another row's label of the same group: rows in key order meet rows in hash order. Keys are numbers."""
    one, digest = F.lit(1).cast("long"), F.md5(F.col(key).cast("string"))
    a = running_before(quantile_bins(df.select(group, key), key), [group], "_bin", [F.col(key)], one).drop("_bin")
    b = df.select(F.col(group).alias("g"), F.col(label).alias("permuted"), digest.alias("digest"), F.col(key).alias("other")).withColumn("_bin", hash_bins(F.col("digest")))
    b = running_before(b, ["g"], "_bin", [F.col("digest"), F.col("other")], one).select("g", "permuted", F.col("before").alias("n"))
    return a.join(b, F.col(group).eqNullSafe(F.col("g")) & (F.col("before") == F.col("n"))).select(key, group, "permuted")


def at_least_one(df: DataFrame, what: str) -> DataFrame:
    """df itself; an error where a filter has left nothing."""
    if df.isEmpty():
        raise ValueError(f"no rows left after {what}")
    return df


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, finite and nonzero (shares of all rows), median and sd of the finite values."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    x = F.when(finite("x"), F.col("x"))
    return each.groupBy("feature").agg(F.avg(x.isNotNull().cast("double")).alias("finite"), F.avg(F.coalesce(x != 0, F.lit(False)).cast("double")).alias("nonzero"), F.median(x).alias("median"), F.stddev_samp(x).alias("sd"))


def composition(indicated: DataFrame, names: list[str], none: str = "(none)") -> DataFrame:
    """name, n, share: how many rows have each indicator, and how many have none of them; a row may have several."""
    every = F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) == 1).alias("has")) for c in names], F.struct(F.lit(none).alias("name"), (F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in names], F.lit(0)) != 1).alias("has")))
    each = indicated.select(F.inline(every))
    return each.groupBy("name").agg(F.count_if("has").alias("n"), (F.count_if("has") / F.count(F.lit(1))).alias("share"))
