"""Places in an order, found by bins, so that no task sorts a whole table or group."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of about as many rows each.
BINS = 1024


def quantile_bins(df: DataFrame, column: str, name: str = "_bin", bins: int = BINS) -> DataFrame:
    """df with the column's bin, in the column's order. Bounds are quantiles, so an outlier doesn't fill a bin with the rest."""
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / bins for i in range(1, bins)], 10 * bins)).collect()[0][0] or []
    bounds = sorted(set(found))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    value = df.withColumn("_value", F.col(column).cast("double"))
    return Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_value", outputCol=name, handleInvalid="keep").transform(value).withColumn(name, F.col(name).cast("int")).drop("_value")


def hash_bins(digest: Column, name: str = "_bin") -> Column:
    """The bin of a hexadecimal digest, in the digest's order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias(name)


def running_before(df: DataFrame, groups: list[str], bin_: str, order: list[Column], value: Column) -> DataFrame:
    """df with before: the sum of value over the group's rows that come earlier by bin, then order."""
    rows = df.withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy(*groups, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy(*groups, bin_).agg(F.sum("_v").alias("_t"))
    under = F.sum("_t").over(Window.partitionBy(*groups, F.lit(0)).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate([*groups, bin_])], F.coalesce(under, F.lit(0)).alias("_under"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate([*groups, bin_])]
    on = same[0]
    for s in same[1:]:
        on &= s
    joined = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(totals, on)
    return joined.withColumn("before", F.col("_under") + F.col("_inside")).drop("_v", "_inside", "_under", *[f"_g{i}" for i in range(len(same))])
