"""How much more known features explain: levels over subset sizes, slopes, saturation, and a fitted ceiling."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subset_sizes(n: int) -> list[int]:
    """1, 2, 3, then larger by 1.6 times, and n."""
    sizes, at = {1, 2, 3, n}, 3
    while at < n:
        at = max(at + 1, round(at * 1.6))
        sizes.add(at)
    return sorted(s for s in sizes if 0 < s <= n)


def draw_subsets(features: list[str], size: int, n: int, seed: int) -> list[list[str]]:
    """At most n distinct subsets of a size, in the features' order; all of them if there are fewer."""
    most = min(n, math.comb(len(features), size))
    draw, found = random.Random(f"{seed}:{size}"), set()
    for _ in range(50 * n):
        if len(found) == most:
            break
        found.add(tuple(sorted(draw.sample(range(len(features)), size))))
    return [[features[i] for i in s] for s in sorted(found)]


def levels(scores: DataFrame) -> DataFrame:
    """k, n, mean, sd, low, high of the scores of each subset size."""
    return scores.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("r2_full").alias("mean"), F.coalesce(F.stddev_samp("r2_full"), F.lit(0.0)).alias("sd"), F.min("r2_full").alias("low"), F.max("r2_full").alias("high"))


def trend(level: DataFrame) -> DataFrame:
    """One row: log_slope (mean on ln k), tail_gain (last step's rise) and tail_log_slope (per unit of ln k)."""
    w = Window.orderBy("k")
    steps = level.withColumn("rise", F.col("mean") - F.lag("mean").over(w)).withColumn("run", F.log("k") - F.log(F.lag("k").over(w)))
    return steps.agg(F.regr_slope("mean", F.log("k")).alias("log_slope"), F.max_by("rise", "k").alias("tail_gain"), F.max_by(F.col("rise") / F.col("run"), F.col("k")).alias("tail_log_slope"))


def saturation(trends: DataFrame, tolerance: float = 0.01) -> DataFrame:
    flat = (F.col("tail_gain") <= tolerance) & (F.col("tail_log_slope") <= tolerance)
    return trends.withColumn("saturated", F.coalesce(flat, F.lit(False)))


def spread_warning(level: DataFrame, limit: float = 0.02) -> DataFrame:
    """The size whose subsets differ most, and whether that exceeds the limit."""
    s = F.col("high") - F.col("low")
    return level.agg(F.max_by("k", F.struct(s, -F.col("k"))).alias("k"), F.max(s).alias("spread")).withColumn("warn", F.col("spread") >= limit)


@dataclass(frozen=True)
class Ceiling:
    value: float | None
    half: float | None
    refused: str | None


def ceiling(sizes: list[float], means: list[float]) -> Ceiling:
    """Fits a * k / (k + h): for each h the best a is closed-form, h is searched. Refused where it would mislead."""
    if len(sizes) < 4:
        return Ceiling(None, None, "fewer than four levels")
    if not all(map(math.isfinite, means)):
        return Ceiling(None, None, "levels aren't finite")
    if max(means) < 0.005:
        return Ceiling(None, None, "nothing explained")

    def at(h: float) -> tuple[float, float]:
        shape = [k / (k + h) for k in sizes]
        a = min(max(sum(s * m for s, m in zip(shape, means, strict=True)) / sum(s * s for s in shape), 0.0), 1.0)
        return sum((a * s - m) ** 2 for s, m in zip(shape, means, strict=True)), a

    low, high = math.log(1e-6), math.log(1e4)
    grid = [low + (high - low) * i / 400 for i in range(401)]
    best = min(range(401), key=lambda i: at(math.exp(grid[i]))[0])
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 400)]
    for _ in range(60):
        c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
        a, b = (a, d) if at(math.exp(c))[0] < at(math.exp(d))[0] else (c, b)
    h = math.exp((a + b) / 2)
    top = at(h)[1]
    if top >= 0.999:
        return Ceiling(None, None, "ceiling at its bound")
    if top < max(means):
        return Ceiling(None, None, "ceiling below a level")
    return Ceiling(top, h, None)


def arms(scores: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """arm, k, r2_full, gain of named subsets in their order; gain: over the arm before, null for the first.

    scores: subset, k, r2_full as regression.subset_scores gives them. Arms are a handful, and so are the rows.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("arm"), F.lit(_sorted("+".join(x))).alias("members")) for i, (a, x) in enumerate(named.items())]))
    wanted = scores.sparkSession.range(1).select(listed.alias("a")).select("a.*")
    found = scores.withColumn("members", F.array_join(F.array_sort(F.split("subset", r"\+")), "+")).drop("subset")
    out = found.join(F.broadcast(wanted), "members")
    before = F.lag("r2_full").over(Window.orderBy("place"))
    return out.select("arm", "k", "r2_full", (F.col("r2_full") - before).alias("gain"))


def _sorted(subset: str) -> str:
    return "+".join(sorted(subset.split("+")))
