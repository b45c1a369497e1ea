"""The whole decomposition of a prediction gap: covariates, known features, every explainer, intervals, residuals.

For each explainer (a linear one, boosted trees) come out-of-fold predictions from the covariates alone, from covariates
and all features, and from covariates and each feature by itself. What is reported of them are shares of variance, and
those follow from one sum of squared errors by cluster and prediction; bootstrap replicates are weighted sums of these
rows. So all intervals of all explainers and features come from one pass, over the same draws.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.boosting import Settings, boosted
from plumbline.operators.regression import Sums
from plumbline.operators.replicates import replicate_sums
from plumbline.sources.staging import staged

EXPLAINERS = ("linear", "boosted")
#: Recordings below which shares are unstable.
FEW = 200


@dataclass(frozen=True)
class Decomposition:
    """explainers: explainer, n, n_dropped, gap_sd, r2_base (floored at 0), r2_full, incremental, unexplained,
    full_low, full_high, incremental_low, incremental_high, most_explanatory.
    features: explainer, feature, effect, univariate (the feature alone, above the base), low, high.
    residuals: key, explainer, residual: what all features leave of the gap, out of fold.
    warnings: explainer, warning.
    """

    explainers: DataFrame
    features: DataFrame
    residuals: DataFrame
    warnings: DataFrame


def finite(columns: list[str]) -> Column:
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return reduce(lambda a, b: a & b, map(one, columns))


def usable(df: DataFrame, y: str, columns: list[str], fold: str) -> tuple[DataFrame, int, int]:
    """Rows with all values, their number, and how many had to go. An error where columns are absent or rows too few."""
    absent = [c for c in [y, fold, *columns] if c not in df.columns]
    if absent:
        raise KeyError(f"no such columns: {absent}")
    ok = finite([y, *columns]) & F.col(fold).isNotNull()
    n, kept, folds = df.agg(F.count(F.lit(1)), F.count_if(ok), F.count_distinct(F.when(ok, F.col(fold)))).first()
    if folds < 2 or kept < 2 * folds:
        raise ValueError(f"{kept} rows with all values in {folds} folds are too few")
    return df.where(ok), kept, n - kept


def linear(rows: DataFrame, y: str, fold: str, subsets: dict[str, list[str]]) -> tuple[DataFrame, dict[str, float]]:
    """rows with each subset's out-of-fold prediction as lin_<subset>, and the standardized coefficients of subset full.

    Sums of products by fold are all that comes to the driver; coefficients go back as one row a fold.
    """
    columns = sorted({c for s in subsets.values() for c in s})
    s = Sums(rows, y, columns, fold)
    by_fold = s.found
    total, last = sum(by_fold.values()), len(columns) + 1

    def beta(g: np.ndarray, own: list[str]) -> np.ndarray:
        at = [0, *[1 + columns.index(c) for c in own]]
        out = np.zeros(last)
        out[at] = np.linalg.lstsq(g[np.ix_(at, at)], g[at, last], rcond=None)[0]
        return out

    lines = [(int(k), *[beta(total - own, c).tolist() for c in subsets.values()]) for k, own in by_fold.items()]
    schema = "_fold long, " + ", ".join(f"_b{i} array<double>" for i in range(len(subsets)))
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(lines, schema)), F.col(fold).cast("long") == F.col("_fold"))
    fitted = {f"lin_{name}": sum((F.col(f"_b{i}")[1 + columns.index(c)] * F.col(c).cast("double") for c in own), F.col(f"_b{i}")[0]) for i, (name, own) in enumerate(subsets.items())}
    whole, n = beta(total, subsets["full"]), total[0, 0]
    spread = {c: float(np.sqrt(max(total[j, j] / n - (total[0, j] / n) ** 2, 0.0))) for j, c in enumerate(columns, 1)}
    return joined.withColumns(fitted).drop("_fold", *[f"_b{i}" for i in range(len(subsets))]), {c: float(whole[j]) * spread[c] for j, c in enumerate(columns, 1)}


def explained(
    rows: DataFrame, key: str, y: str, fold: str, subsets: dict[str, list[str]], explainers: tuple[str, ...], settings: Settings | None, keep: list[str], whole: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """keep and, for every explainer and subset, its out-of-fold prediction as <explainer>_<subset>; effects of subset full."""
    effects: dict[str, dict[str, float]] = {}
    predicted = rows
    if "linear" in explainers:
        predicted, effects["linear"] = linear(predicted, y, fold, subsets)
    if "boosted" in explainers:
        run = boosted(rows, key, y, fold, subsets, settings, whole)
        effects["boosted"] = run.importances("full") if "full" in whole else {}
        found = run.predicted()
        found = found.select(F.col("key").alias("_key"), *[F.col(s).alias(f"boo_{s}") for s in subsets])
        predicted = predicted.join(found, F.col(key) == F.col("_key")).drop("_key")
    names = [f"{e[:3]}_{s}" for e in explainers for s in subsets]
    return predicted.select(*dict.fromkeys(keep), *names), effects


class Shares:
    """Shares of variance of many predictions of one target, and their replicates, from one pass of sums by cluster."""

    def __init__(self, predicted: DataFrame, y: str, cluster: str, names: list[str]):
        gap = F.col(y).cast("double")
        errors = [F.sum((gap - F.col(k)) ** 2).alias(k) for k in names]
        sums = predicted.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(gap).alias("sy"), F.sum(gap * gap).alias("syy"), *errors)
        self.sums, self.cluster, self.names, self.columns = staged(sums, "decompose-sums"), cluster, names, ["n", "sy", "syy", *names]

    def of(self, sums: DataFrame) -> DataFrame:
        """r_<name>: its share; <name>_inc: what that is above its explainer's base, which is floored at 0."""
        left = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
        shares = sums.select("n", "sy", "syy", *[(1 - F.try_divide(F.col(k), left)).alias(f"r_{k}") for k in self.names])
        return shares.select("*", *[(F.col(f"r_{k}") - F.greatest(F.col(f"r_{k[:3]}_base"), F.lit(0.0))).alias(f"{k}_inc") for k in self.names])

    def point(self):
        return self.of(self.sums.agg(*[F.sum(c).alias(c) for c in self.columns])).first()

    def intervals(self, replicates: int, level: float):
        """<column>_low and <column>_high of every share and every share above the base: one row."""
        drawn = self.of(replicate_sums(self.sums, self.cluster, {c: F.col(c) for c in self.columns}, replicates))
        tail = (1 - level) / 2
        ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for k in self.names for c in (f"r_{k}", f"{k}_inc") for side, q in (("low", tail), ("high", 1 - tail))]
        return drawn.agg(*ends).first()


def decompose(
    df: DataFrame, key: str, y: str, covariates: list[str], features: list[str], fold: str, cluster: str | None = None, explainers: tuple[str, ...] = EXPLAINERS, replicates: int = 1000, level: float = 0.95, settings: Settings | None = None
) -> Decomposition:
    """key is unique; folds keep a cluster's rows together; without clusters each row is drawn by itself.

    Rows with a missing or infinite value go, and are counted; nothing is imputed.
    """
    unknown = set(explainers) - set(EXPLAINERS)
    if unknown or not explainers:
        raise ValueError(f"explainers are {EXPLAINERS}, not {sorted(unknown)}")
    rows, n, dropped = usable(df, y, [*covariates, *features], fold)
    drawn = cluster or key
    names = [key, drawn, y, fold, *covariates, *features]
    rows = staged(rows.select(*dict.fromkeys(names)), "decompose-rows")
    subsets = {"base": covariates, "full": [*covariates, *features], **{f"only{i}": [*covariates, f] for i, f in enumerate(features)}}
    predicted, effects = explained(rows, key, y, fold, subsets, explainers, settings, [key, drawn, y], whole=("full",))
    predicted = staged(predicted, "decompose-predicted")

    found = Shares(predicted, y, drawn, [f"{e[:3]}_{s}" for e in explainers for s in subsets])
    point, interval = found.point(), found.intervals(replicates, level)
    spark = df.sparkSession
    sd = float(np.sqrt(max(point["syy"] / n - (point["sy"] / n) ** 2, 0.0)))
    best = max(explainers, key=lambda e: -np.inf if point[f"r_{e[:3]}_full"] is None else point[f"r_{e[:3]}_full"])
    table, by_feature, warnings = [], [], []
    for e in explainers:
        short, full = e[:3], point[f"r_{e[:3]}_full"]
        base = None if point[f"r_{short}_base"] is None else max(point[f"r_{short}_base"], 0.0)
        added = point[f"{short}_full_inc"]
        table.append((e, n, dropped, sd, base, full, added, None if full is None else 1 - full, interval[f"r_{short}_full_low"], interval[f"r_{short}_full_high"], interval[f"{short}_full_inc_low"], interval[f"{short}_full_inc_high"], e == best))
        by_feature += [(e, f, effects[e][f], point[f"{short}_only{i}_inc"], interval[f"{short}_only{i}_inc_low"], interval[f"{short}_only{i}_inc_high"]) for i, f in enumerate(features)]
        if added is not None and added < 0:
            warnings.append((e, f"the features' share is negative ({added:.4f}): out of fold they predict worse than the covariates alone; read it as zero"))
        if n < FEW:
            warnings.append((e, f"only {n} rows: shares are unstable below {FEW}"))
    residuals = reduce(DataFrame.unionByName, [predicted.select(key, F.lit(e).alias("explainer"), (F.col(y).cast("double") - F.col(f"{e[:3]}_full")).alias("residual")) for e in explainers])
    kind = "explainer string, n long, n_dropped long, gap_sd double, r2_base double, r2_full double, incremental double, unexplained double, full_low double, full_high double, incremental_low double, incremental_high double, most_explanatory boolean"
    return Decomposition(
        spark.createDataFrame(table, kind),
        spark.createDataFrame(by_feature, "explainer string, feature string, effect double, univariate double, low double, high double"),
        residuals,
        spark.createDataFrame(warnings, "explainer string, warning string"),
    )


def arms(df: DataFrame, key: str, y: str, covariates: list[str], named: dict[str, list[str]], fold: str, cluster: str | None = None, **more) -> DataFrame:
    """arm, n_features, explainer, n, incremental, low, high, unexplained of named sets of known features, a row each.

    Each arm is decomposed on the rows that have its own features; one with absent columns is skipped. Arms are a handful.
    """
    out = None
    for arm, features in named.items():
        if any(c not in df.columns for c in features):
            continue
        best = decompose(df, key, y, covariates, features, fold, cluster, **more).explainers.where("most_explanatory")
        row = best.select(F.lit(arm).alias("arm"), F.lit(len(features)).alias("n_features"), "explainer", "n", "incremental", F.col("incremental_low").alias("low"), F.col("incremental_high").alias("high"), "unexplained")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise KeyError("no arm has all of its columns")
    return out
