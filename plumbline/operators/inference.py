"""Cluster bootstraps, AUC, superiority and equivalence verdicts, seed noise floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order import quantile_bins, running_before
from plumbline.operators.replicates import replicate_auc, replicate_sums

def bootstrap_r2(df: DataFrame, cluster: str, y: str, base: str, full: str, replicates: int, level: float = 0.95) -> DataFrame:
    """Intervals of the full R2 and of what it adds to the base's, floored at 0, from the same cluster draws.

    A cluster is five sums; a replicate is a weighted sum of clusters, so rows are read once.
    """
    e = lambda c: (F.col(y) - F.col(c)) * (F.col(y) - F.col(c))
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(e(base)).alias("eb"), F.sum(e(full)).alias("ef"))
    w = replicate_sums(stats, cluster, {c: F.col(c) for c in ("n", "sy", "syy", "eb", "ef")}, replicates)
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = w.where(sst > 0).select((1 - F.col("ef") / sst).alias("r_full"), (1 - F.col("ef") / sst - F.greatest(1 - F.col("eb") / sst, F.lit(0.0))).alias("r_inc"))
    t = (1 - level) / 2
    return r.agg(F.count(F.lit(1)).alias("replicates"), *[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("r_full", "r_inc") for name, q in (("low", t), ("high", 1 - t))])


def rank_sums(at: DataFrame, by: list[str]) -> DataFrame:
    """by, n_positive, n_negative, auc of distinct scores s with p positives, q negatives and _bin: ties count half.

    Scores are ranked within bins of about as many rows each, so no task sees all scores. auc is null where one label
    is missing.
    """
    ranked = running_before(at, by, "_bin", [F.col("s")], F.col("q"))
    win = F.col("p") * (F.col("before") + F.col("q").cast("double") / 2)
    total = ranked.groupBy(*by).agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("n_positive"), F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("n_negative"), F.sum(win).alias("w"))
    both = F.col("n_positive").cast("double") * F.col("n_negative")
    return total.select(*by, "n_positive", "n_negative", F.when(both > 0, F.try_divide("w", both)).alias("auc"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """n_positive, n_negative, auc by the rank sum over distinct scores; rows without a label count on no side."""
    at = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return rank_sums(quantile_bins(at, "s"), [])


def weighted_auc(df: DataFrame, by: str, label: str, score: str, weight: str, bins: str) -> DataFrame:
    """by, auc: null where one class only is there. bins: the column with the scores' bins."""
    count = lambda y: F.sum(F.when(F.col(label) == y, F.col(weight)).otherwise(0))
    at = df.where(F.col(score).isNotNull()).groupBy(by, F.col(bins).alias("_bin"), F.col(score).cast("double").alias("s")).agg(count(1).alias("p"), count(0).alias("q"))
    return rank_sums(at, [by]).select(by, "auc")


def auc_differences(df: DataFrame, cluster: str, label: str, base: str, full: str, replicates: int, by: list[str] | None = None) -> DataFrame:
    """by, replicate, d: AUC(full) - AUC(base) of each replicate of paired cluster draws; null where one has one class only."""
    by = by or []
    rows = df.where(F.col(base).isNotNull() & F.col(full).isNotNull())
    arms = [replicate_auc(rows, by, cluster, label, score, replicates) for score in (full, base)]
    other = arms[1].select(*[F.col(b).alias(f"_{b}") for b in by], F.col("replicate").alias("_replicate"), F.col("auc").alias("base_auc"))
    on = F.col("replicate") == F.col("_replicate")
    for b in by:
        on &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    return arms[0].join(other, on).select(*by, "replicate", (F.col("auc") - F.col("base_auc")).alias("d"))


def delta_auc(df: DataFrame, cluster: str, label: str, base: str, full: str, replicates: int, tail: float) -> DataFrame:
    """replicates (usable ones), low, high of AUC(full) - AUC(base) from paired cluster draws; null under half usable."""
    d = auc_differences(df, cluster, label, base, full, replicates)
    out = d.agg(F.count("d").alias("replicates"), F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"))
    enough = F.col("replicates") * 2 >= replicates
    return out.select("replicates", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def verdict(low: Column, high: Column, plain_low: Column, plain_high: Column, margin: float) -> tuple[Column, Column]:
    """(improves: the corrected interval is above 0; equivalent: the plain one is inside the margin)."""
    return low > 0, (plain_low > -margin) & (plain_high < margin)


def verdict_text(improves: Column, equivalent: Column) -> Column:
    return F.when(improves & equivalent, "improves within margin").when(improves, "improves").when(equivalent, "equivalent").otherwise("inconclusive")


def testable(df: DataFrame, labels: list[str], least: int, folds: int) -> DataFrame:
    """label, positives, n, testable: enough rows on both sides."""
    need = max(least, folds)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y")) for c in labels])).alias("x")).select("x.*").where("y is not null")
    out = each.groupBy("label").agg(F.sum("y").cast("long").alias("positives"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("testable", (F.col("positives") >= need) & (F.col("positives") <= F.col("n") - need))


def noise_floor(df: DataFrame, key: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """n, mean_correlation, nu: 1 less the mean correlation between runs over the keys that all have, within [0, 1].

    Pairs with a run without variance have no correlation and are left out; nu is null where none has one.
    """
    wide = df.groupBy(key).pivot(run, runs).agg(F.avg(value)).dropna()
    pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    c = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    found = F.filter(F.array(*[F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(pairs))]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(found, F.lit(0.0), lambda x, y: x + y), F.size(found))
    return c.select("n", mean.alias("mean_correlation"), F.least(F.greatest(1 - mean, F.lit(0.0)), F.lit(1.0)).alias("nu"))


def corrected_share(unexplained: Column, nu: Column) -> Column:
    """The unexplained share beyond the noise between runs."""
    return F.greatest(unexplained - nu, F.lit(0.0))


def noise_floor_interval(df: DataFrame, key: str, run: str, value: str, runs: list[str], replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """noise_floor with low and high of nu from draws of single keys: replicates of weighted sums of products, in one pass.

    A pair of runs without variance in a replicate is left out of that replicate's mean.
    """
    wide = df.groupBy(key).pivot(run, runs).agg(F.avg(value)).dropna()
    pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    products = {f"s{i}": F.col(a) for i, a in enumerate(runs)} | {f"q{i}": F.col(a) * F.col(a) for i, a in enumerate(runs)} | {f"c{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(pairs)}
    sums = replicate_sums(wide, key, {"n": F.lit(1), **products}, replicates)
    at = {name: i for i, name in enumerate(runs)}
    spread = lambda i: F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")
    r = [F.try_divide(F.col(f"c{i}") - F.col(f"s{at[a]}") * F.col(f"s{at[b]}") / F.col("n"), F.sqrt(F.greatest(spread(at[a]) * spread(at[b]), F.lit(0.0)))) for i, (a, b) in enumerate(pairs)]
    usable = F.filter(F.array(*r), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(usable, F.lit(0.0), lambda x, y: x + y), F.size(usable))
    nu = F.least(F.greatest(1 - mean, F.lit(0.0)), F.lit(1.0))
    tail = (1 - level) / 2
    ends = sums.select(F.when(mean.isNotNull(), nu).alias("nu")).agg(F.percentile("nu", F.lit(tail)).alias("low"), F.percentile("nu", F.lit(1 - tail)).alias("high"))
    return noise_floor(df, key, run, value, runs).join(F.broadcast(ends))


def report(links: DataFrame) -> DataFrame:
    """One row over the tested labels: any_improves, all_equivalent, n_inconclusive and best, the label with the largest delta."""
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    return links.agg(F.bool_or(sure("improves")).alias("any_improves"), F.bool_and(sure("equivalent")).alias("all_equivalent"), F.count_if(~sure("improves") & ~sure("equivalent")).alias("n_inconclusive"), F.max_by("label", F.struct("delta", "label")).alias("best"))


def tightest_bound(low: Column, high: Column) -> Column:
    """The smallest margin that the interval lies inside."""
    return F.greatest(F.abs(low), F.abs(high))


def fold_deltas(df: DataFrame, fold: str, label: str, base: str, full: str) -> DataFrame:
    """fold, auc_base, auc_full, delta of each fold's own rows; null where a fold has one class only."""
    rows = quantile_bins(quantile_bins(df.withColumn("_one", F.lit(1)), base, "_base_bin"), full, "_full_bin")
    a = weighted_auc(rows, fold, label, base, "_one", "_base_bin").withColumnRenamed("auc", "auc_base")
    b = weighted_auc(rows, fold, label, full, "_one", "_full_bin").select(F.col(fold).alias("_fold"), F.col("auc").alias("auc_full"))
    out = a.join(b, F.col(fold).eqNullSafe(F.col("_fold"))).drop("_fold")
    return out.withColumn("delta", F.col("auc_full") - F.col("auc_base"))


def dispersion_reliability(df: DataFrame, key: str, kind: str, value: str, factor: float = 2.0) -> DataFrame:
    """kind, n, sd, floor, usable: does the spread of the keys' means stand out from what repeats of one key scatter?

    floor: mean over keys with two values at least of the standard error of their mean; usable: sd above factor floors.
    """
    means = df.groupBy(kind, key).agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("se"))
    out = means.groupBy(kind).agg(F.count("m").alias("n"), F.stddev_samp("m").alias("sd"), F.avg("se").alias("floor"))
    return out.withColumn("usable", F.coalesce(F.col("sd") > factor * F.col("floor"), F.lit(False)))
