"""Attribution of any differentiable scorer along straight paths from a baseline: integrated gradients in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import share_package

#: From points (rows) to their scores and the scores' gradients there.
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Most values that are open at a time: records times steps times their length.
VALUES = 4_000_000


def logistic(weights: np.ndarray, bias: float) -> Scorer:
    """A logistic scorer and its gradient."""
    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-(x @ weights + bias)))
        return p, (p * (1 - p))[:, None] * weights[None, :]

    return of


def baseline_of(kind: str, x: np.ndarray, mean: np.ndarray | None, leads: int) -> np.ndarray:
    """Where paths begin: zero; flatline, each lead of a record at its median, the lower of two; mean, the mean of all records."""
    if kind == "zero":
        return np.zeros_like(x)
    if kind == "flatline":
        own = np.sort(x.reshape(len(x), leads, -1), axis=2)
        level = own[:, :, (own.shape[2] - 1) // 2]
        return np.repeat(level, x.shape[1] // leads, axis=1)
    return np.tile(mean, (len(x), 1))


def integrated(scorer: Scorer, x: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """(x - start) times the mean gradient at the middles of so many equal steps of the path."""
    total, at = np.zeros_like(x), (np.arange(steps) + 0.5) / steps
    together = max(1, VALUES // max(x.size, 1))
    for first in range(0, steps, together):
        some = at[first : first + together]
        points = start[None] + some[:, None, None] * (x - start)[None]
        total += scorer(points.reshape(-1, x.shape[1]))[1].reshape(len(some), *x.shape).sum(axis=0)
    return (x - start) * total / steps


def path_attribution(df: DataFrame, key: str, vector: str, scorer: Scorer, baseline: str = "zero", leads: int = 1, steps: int = 64, absolute: float = 1.0, relative: float = 0.05) -> DataFrame:
    """key, attribution (array<double>), score, baseline_score, error, flagged of every finite vector of the usual length.

    error: the attributions' sum less what the score moved from the baseline's; flagged: it is larger than absolute plus
    relative times that move, which tells of wrong gradients or too few steps. leads: consecutive runs of equal length.
    """
    if baseline not in ("zero", "flatline", "mean"):
        raise ValueError(f"baselines are zero, flatline and mean, not {baseline}")
    if steps < 1 or leads < 1:
        raise ValueError("there must be a step and a lead at least")
    share_package(df.sparkSession)
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(sound).select(F.col(key).alias("key"), v.cast("array<double>").alias("x"))
    # One number: most records' length.
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = usual["n"] if usual else 0
    if length % leads:
        raise ValueError(f"{length} values aren't {leads} leads of equal length")
    rows = rows.where(F.size("x") == length)
    mean = None
    if baseline == "mean" and length:
        found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
        mean = np.array([r["m"] for r in sorted(found, key=lambda r: r["i"])])
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                own = batch.slice(first, 1024)
                x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, length)
                start = baseline_of(baseline, x, mean, leads)
                credit = integrated(scorer, x, start, steps)
                score, before = scorer(x)[0], scorer(start)[0]
                error = credit.sum(axis=1) - (score - before)
                flagged = np.abs(error) > absolute + relative * np.abs(score - before)
                yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(list(credit), pa.list_(pa.float64())), *[pa.array(c) for c in (score, before, error, flagged)]], ["key", "attribution", "score", "baseline_score", "error", "flagged"])

    found = rows.mapInArrow(run, f"key {kind}, attribution array<double>, score double, baseline_score double, error double, flagged boolean")
    return found.withColumnRenamed("key", key)
