"""Out-of-fold least squares from shared sums: one pass over the rows answers every subset of features.

Per fold (and stratum) the pass sums all products of 1, the covariates, the features and the target. Sums of all folds
less a fold's own are its training set; its held-out error follows from its own sums. What comes to the driver is one
row a fold, whatever the table's size; strata are solved where their sums meet.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import share_package


def metrics(df: DataFrame, y: str | Column, p: str | Column) -> DataFrame:
    """n, mae, rmse, r2 (null without variance; may be negative)."""
    y, p = (F.col(c) if isinstance(c, str) else c for c in (y, p))
    e = y - p
    return df.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(F.when(e.isNotNull(), y)))).alias("r2"))


def fold_sums(df: DataFrame, y: str, columns: list[str], fold: str, stratum: str | None = None) -> DataFrame:
    """stratum, fold and s<i>_<j>: sums of products of 1, the columns and the target; rows with any value missing are left out."""
    z = ["_one", *columns, y]
    rows = df.withColumn("_one", F.lit(1.0)).dropna(subset=[*columns, y]).select(F.col(fold).cast("long").alias("fold"), (F.col(stratum) if stratum else F.lit("all")).cast("string").alias("stratum"), *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)])
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in combinations_with_replacement(range(len(z)), 2)]
    return rows.groupBy("stratum", "fold").agg(*sums)


def gram(row: Mapping[str, float], width: int) -> np.ndarray:
    """The matrix of one row of sums."""
    g = np.zeros((width, width))
    for i, j in combinations_with_replacement(range(width), 2):
        g[i, j] = g[j, i] = row[f"s{i}_{j}"]
    return g


def held_out_r2(by_fold: list[np.ndarray], at: list[int]) -> float | None:
    """Out-of-fold R2 of the last variable on those at some places, from the folds' matrices; None for one fold."""
    if len(by_fold) < 2:
        return None
    total, y, sse = sum(by_fold), len(by_fold[0]) - 1, 0.0
    for own in by_fold:
        train = total - own
        beta, *_ = np.linalg.lstsq(train[np.ix_(at, at)], train[at, y], rcond=None)
        sse += own[y, y] - 2 * beta @ own[at, y] + beta @ own[np.ix_(at, at)] @ beta
    sst = total[y, y] - total[0, y] ** 2 / total[0, 0]
    return float(1 - sse / sst) if sst > 0 else None


class Sums:
    """The sums of a regression table. columns: covariates and features; one row a fold comes to the driver."""

    def __init__(self, df: DataFrame, y: str, columns: list[str], fold: str):
        self.columns = columns
        self.found = {r["fold"]: gram(r, len(columns) + 2) for r in fold_sums(df, y, columns, fold).collect()}

    def r2(self, subset: list[str]) -> float | None:
        """Out-of-fold R2 of the target on a subset of the columns, with an intercept."""
        return held_out_r2(list(self.found.values()), [0, *[1 + self.columns.index(c) for c in subset]])


def decomposition(df: DataFrame, y: str, covariates: list[str], features: list[str], fold: str, stratum: str | None = None) -> DataFrame:
    """stratum, n, r2_base (floored at 0), r2_full, incremental, unexplained.

    A stratum's sums, a row a fold, meet in one group and are solved there, so that there may be any number of strata.
    """
    share_package(df.sparkSession)
    width, known = len(covariates) + len(features) + 2, 1 + len(covariates)

    def solve(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["fold"])
        by_fold = [gram(r, width) for r in rows]
        base, full = (held_out_r2(by_fold, list(range(n))) for n in (known, width - 1))
        out = [] if base is None or full is None else [(rows[0]["stratum"], round(sum(g[0, 0] for g in by_fold)), max(base, 0.0), full, full - max(base, 0.0), 1 - full)]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.string(), pa.int64(), *[pa.float64()] * 4]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("stratum", "n", "r2_base", "r2_full", "incremental", "unexplained"), columns, kinds, strict=True)})

    sums = fold_sums(df, y, covariates + features, fold, stratum)
    return sums.groupBy("stratum").applyInArrow(solve, "stratum string, n long, r2_base double, r2_full double, incremental double, unexplained double")


def univariate(df: DataFrame, y: str, features: list[str], fold: str) -> DataFrame:
    """feature, r2: each feature alone, out of fold."""
    s = Sums(df, y, features, fold)
    return df.sparkSession.createDataFrame([(f, s.r2([f])) for f in features], "feature string, r2 double")


def most_explanatory(scores: DataFrame, name: str, r2: str) -> DataFrame:
    return scores.agg(F.max_by(name, F.struct(r2, name)).alias(name), F.max(r2).alias(r2))


def subset_scores(df: DataFrame, y: str, covariates: list[str], subsets: list[list[str]], fold: str) -> DataFrame:
    """subset, k, r2_full, incremental for many subsets from one pass."""
    columns = covariates + sorted({f for s in subsets for f in s})
    s = Sums(df, y, columns, fold)
    base = max(s.r2(covariates) or 0.0, 0.0)
    rows = [("+".join(x), len(x), r, r - base) for x in subsets if (r := s.r2(covariates + x)) is not None]
    return df.sparkSession.createDataFrame(rows, "subset string, k int, r2_full double, incremental double")


def fold_fit(df: DataFrame, columns: list[str], y: str, fold: str) -> DataFrame:
    """df with fitted: y on all columns together, with an intercept, through all other folds' rows. One row a fold is joined."""
    found = Sums(df, y, columns, fold).found
    total, last = sum(found.values()), len(columns) + 1
    betas = [(k, np.linalg.lstsq((total - own)[:last, :last], (total - own)[:last, last], rcond=None)[0].tolist()) for k, own in found.items()] if len(found) > 1 else []
    fits = df.sparkSession.createDataFrame(betas, "lf long, beta array<double>")
    fitted = sum((F.col("beta")[i + 1] * F.col(c) for i, c in enumerate(columns)), F.col("beta")[0])
    return df.join(F.broadcast(fits), F.col(fold) == F.col("lf")).withColumn("fitted", fitted).drop("lf", "beta")
