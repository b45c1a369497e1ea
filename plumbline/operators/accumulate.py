"""How much of a prediction gap known features explain as more of them are known: a sweep over subsets of any explainer.

All subsets are judged on the same rows, those where every feature has a value, and above one base. A point takes the
explainer that explains most. All boosted models of all subsets and folds are grown together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators import sweep
from plumbline.operators.boosting import Settings
from plumbline.operators.decompose import EXPLAINERS, Shares, explained, usable
from plumbline.sources.staging import staged


@dataclass(frozen=True)
class Curve:
    """points: label (null: drawn), k, features, explainer, r2_full, incremental.
    levels: k, n, mean, sd, low, high of the drawn points' incremental shares.
    summary: one row with n, n_dropped, full_set (its incremental share), low, high, log_slope, tail_gain, tail_log_slope,
    saturated, ceiling (null: refused), refused, saturation_fraction, spread_k, spread, spread_warn.
    """

    points: DataFrame
    levels: DataFrame
    summary: DataFrame


def sweep_known(
    df: DataFrame, key: str, y: str, covariates: list[str], features: list[str], fold: str, cluster: str | None = None, explainers: tuple[str, ...] = EXPLAINERS, sizes: list[int] | None = None, draws: int = 8,
    named: dict[str, list[str]] | None = None, replicates: int = 1000, level: float = 0.95, settings: Settings | None = None, seed: int = 0, tolerance: float = 0.01,
) -> Curve:
    """key is unique; sizes: of drawn subsets (those of sweep.subset_sizes if none); named: subsets with a name of their own."""
    named = named or {}
    sizes = sorted({s for s in sizes or sweep.subset_sizes(len(features)) if 1 <= s <= len(features)})
    if not sizes:
        raise ValueError("no size of a subset lies between 1 and the number of features")
    absent = [c for own in named.values() for c in own if c not in df.columns]
    if absent:
        raise KeyError(f"named subsets refer to absent columns: {absent}")
    extra = sorted({c for own in named.values() for c in own} - set(features))
    drawn, wanted = cluster or key, [y, fold, *covariates, *features, *extra]
    # Written first, so that what df stands for is worked out once; usable names columns that are absent.
    rows = staged(df.select(*dict.fromkeys([key, drawn, *wanted])), "sweep-rows") if set(wanted) <= set(df.columns) else df
    rows, n, dropped = usable(rows, y, [*covariates, *features], fold)
    if extra:
        # Columns that only named subsets use must not take rows from the others.
        rows, n, more = usable(rows, y, extra, fold)
        dropped += more
    points = [(None, s) for size in sizes for s in sweep.draw_subsets(features, size, draws, seed)] + list(named.items())
    subsets = {"base": covariates, "full": [*covariates, *features], **{f"point{i}": [*covariates, *own] for i, (_, own) in enumerate(points)}}
    predicted, _ = explained(rows, key, y, fold, subsets, explainers, settings, [key, drawn, y])
    found = Shares(predicted, y, drawn, [f"{e[:3]}_{s}" for e in explainers for s in subsets])
    at = found.point()

    def best(name: str) -> str:
        return max(explainers, key=lambda e: float("-inf") if at[f"r_{e[:3]}_{name}"] is None else at[f"r_{e[:3]}_{name}"])

    spark, table = df.sparkSession, []
    for i, (label, own) in enumerate(points):
        e = best(f"point{i}")
        table.append((label, len(own), own, e, at[f"r_{e[:3]}_point{i}"], at[f"{e[:3]}_point{i}_inc"]))
    points_frame = spark.createDataFrame(table, "label string, k int, features array<string>, explainer string, r2_full double, incremental double")
    levels = sweep.levels(points_frame.where("label is null").selectExpr("k", "incremental as r2_full"))
    means = levels.orderBy("k").collect()
    trend = sweep.saturation(sweep.trend(levels), tolerance).first()
    spread = sweep.spread_warning(levels).first()
    fit = sweep.ceiling([r["k"] for r in means], [r["mean"] for r in means])
    e = best("full")
    whole, interval = at[f"{e[:3]}_full_inc"], found.intervals(replicates, level)
    fraction = whole / fit.value if fit.value and whole is not None else None
    row = (n, dropped, e, whole, interval[f"{e[:3]}_full_inc_low"], interval[f"{e[:3]}_full_inc_high"], *[trend[c] for c in ("log_slope", "tail_gain", "tail_log_slope", "saturated")], fit.value, fit.refused, fraction, spread["k"], spread["spread"], spread["warn"])
    kind = "n long, n_dropped long, explainer string, full_set double, low double, high double, log_slope double, tail_gain double, tail_log_slope double, saturated boolean, ceiling double, refused string, saturation_fraction double, spread_k int, spread double, spread_warn boolean"
    return Curve(points_frame, levels, spark.createDataFrame([row], kind))
