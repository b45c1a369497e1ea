"""Does a residual add to known features in predicting labels? All labels, repeats, folds and arms in one run.

Logistic models of all (label, repeat, fold, arm) are fitted together by Newton's method. A step is one pass: a batch of
rows multiplies its features by all models' coefficients at once and leaves each model's gradient and Hessian, which
meet in one group, where the step is solved. The driver has one row of coefficients a model. Features are standardized
over a model's own training rows and coefficients but the intercept are penalized by half their squares, so a fit is
that of an ordinary penalized logistic regression of strength 1.

Out-of-fold probabilities are averaged over repeats and judged over the whole table: one set of paired cluster draws of
all labels gives the corrected interval of superiority and the plain one of equivalence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import inference
from plumbline.operators.decompose import finite
from plumbline.operators.segments import tail
from plumbline.operators.splits import stratified_folds
from plumbline.sources.staging import share_package, staged

ARMS = ("base", "full")
STEPS, CLOSE = 60, 1e-9
#: Rows that are open at a time.
ROWS = 2048


@dataclass(frozen=True)
class Links:
    """links: label, n_positive, n, prevalence, auc_base, auc_full, delta, low, high (corrected), plain_low, plain_high,
    tightest, folds_positive, n_folds, improves, equivalent, verdict; skipped: label, reason; folds: label, repeat, fold,
    auc_base, auc_full, delta; predictions: key, cluster, label, y, base, full.
    """

    links: DataFrame
    skipped: DataFrame
    folds: DataFrame
    predictions: DataFrame


class Fits:
    """Logistic models over staged rows: key, cluster, x (array<double>, the residual last), y and folds (arrays)."""

    def __init__(self, rows: DataFrame, width: int, labels: int, repeats: int, k: int):
        self.rows, self.width, self.labels, self.repeats, self.k = rows, width + 1, labels, repeats, k
        self.models = [(label, r, f, arm) for label in range(labels) for r in range(repeats) for f in range(k) for arm in range(2)]
        self.beta = np.zeros((len(self.models), self.width))
        self.pairs = np.triu_indices(self.width)

    def fit(self) -> None:
        """Newton's steps of all models; a step that makes a model's loss larger is halved."""
        before, loss_before = self.beta.copy(), np.full(len(self.models), np.inf)
        settled = np.zeros(len(self.models), bool)
        for _ in range(STEPS):
            live = [i for i in range(len(self.models)) if not settled[i]]
            if not live:
                break
            for r in self._step(live):
                i, step = r["model"], np.array(r["step"])
                if r["loss"] > loss_before[i] + 1e-9 * abs(loss_before[i]):
                    self.beta[i] = (self.beta[i] + before[i]) / 2
                    continue
                before[i], loss_before[i] = self.beta[i].copy(), r["loss"]
                self.beta[i] += step
                settled[i] = r["size"] < CLOSE

    def _step(self, live: list[int]) -> list:
        """loss, step and size (largest standardized change) of the live models."""
        models, beta, width, pairs = [self.models[i] for i in live], self.beta[live], self.width, self.pairs
        labels, repeats = self.labels, self.repeats

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((len(models), 1 + width + len(pairs[0]))), False
            label, repeat, fold = (np.array([m[i] for m in models]) for i in range(3))
            for batch in batches:
                for x, y, folds, _ in opened(batch, labels, repeats):
                    some = True
                    z, own = x @ beta.T, y[:, label]
                    inside = (folds[:, label * repeats + repeat] != fold[None, :]) & ~np.isnan(own)
                    own = np.where(inside, own, 0.0)
                    p = 1 / (1 + np.exp(-z))
                    total[:, 0] += ((np.logaddexp(0, z) - own * z) * inside).sum(axis=0)
                    total[:, 1 : 1 + width] += ((p - own) * inside).T @ x
                    total[:, 1 + width :] += (p * (1 - p) * inside).T @ (x[:, pairs[0]] * x[:, pairs[1]])
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "sums"])

        centre, spread = self._scales(live)

        def solve(group: pa.Table) -> pa.Table:
            i = group.column("model")[0].as_py()
            sums = sum(np.frombuffer(b) for b in sorted(group.column("sums").to_pylist()))
            hessian = np.zeros((width, width))
            hessian[pairs] = sums[1 + width :]
            hessian = hessian + np.triu(hessian, 1).T
            arm = models[i][3]
            at = np.arange(width) if arm else np.arange(width - 1)
            # Standardized features are t times the row: an intercept, then (x - centre) / spread.
            t = np.eye(width)
            t[1:, 1:] = np.diag(1 / spread[i])
            t[1:, 0] = -centre[i] / spread[i]
            t = t[np.ix_(at, at)]
            weight = np.r_[0.0, beta[i][1:] * spread[i]][at]
            penalty = np.r_[0.0, np.ones(len(at) - 1)]
            # Without rows of both labels the intercept has no place to settle at: the shortest step then.
            step = -np.linalg.lstsq(t @ hessian[np.ix_(at, at)] @ t.T + np.diag(penalty), t @ sums[1 : 1 + width][at] + penalty * weight, rcond=None)[0]
            out = np.zeros(width)
            out[at] = t.T @ step
            loss = sums[0] + (weight**2).sum() / 2
            return pa.table({"model": pa.array([i], pa.int32()), "loss": [float(loss)], "size": [float(np.abs(step).max())], "step": pa.array([out], pa.list_(pa.float64()))})

        found = self.rows.mapInArrow(run, "model int, sums binary").groupBy("model").applyInArrow(solve, "model int, loss double, size double, step array<double>")
        return [{**r.asDict(), "model": live[r["model"]]} for r in found.collect()]

    def _scales(self, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of the features over each model's training rows; one pass for all models."""
        if not hasattr(self, "scales"):
            labels, repeats, k, width = self.labels, self.repeats, self.k, self.width - 1

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((labels * repeats * k, 1 + 2 * width))
                for batch in batches:
                    for x, y, folds, _ in opened(batch, labels, repeats):
                        each = np.c_[x, x[:, 1:] ** 2]
                        for j in range(labels * repeats):
                            for f in range(k):
                                total[j * k + f] += each[(folds[:, j] != f) & ~np.isnan(y[:, j // repeats])].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["part", "sums"])

            found = self.rows.mapInArrow(run, "part int, sums array<double>").select("part", F.posexplode("sums").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
            total = np.zeros((labels * repeats * k, 1 + 2 * width))
            for r in found.collect():
                total[r["part"], r["at"]] = r["v"]
            n = np.maximum(total[:, :1], 1)
            mean = total[:, 1 : 1 + width] / n
            sd = np.sqrt(np.maximum(total[:, 1 + width :] / n - mean**2, 0))
            # As good as constant over the training rows: left as it is.
            self.scales = mean, np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1), sd, 1.0)
        part = [(m[0] * self.repeats + m[1]) * self.k + m[2] for m in (self.models[i] for i in live)]
        return self.scales[0][part], self.scales[1][part]

    def predicted(self, usable: set[tuple[int, int, int]]) -> DataFrame:
        """key, cluster, label (its number), y and parts: repeat, fold, base, full, of the usable folds that hold the row out."""
        models, beta, labels, repeats = self.models, self.beta, self.labels, self.repeats
        at = {m: i for i, m in enumerate(models)}
        kinds = dict(self.rows.dtypes)
        part = pa.list_(pa.struct({"repeat": pa.int32(), "fold": pa.int32(), "base": pa.float64(), "full": pa.float64()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, y, folds, rows in opened(batch, labels, repeats):
                    p = 1 / (1 + np.exp(-(x @ beta.T)))
                    for label in range(labels):
                        having = np.flatnonzero(~np.isnan(y[:, label]))
                        parts = []
                        for i in having:
                            own = [(r, int(folds[i, label * repeats + r])) for r in range(repeats)]
                            parts.append([{"repeat": r, "fold": f, "base": p[i, at[label, r, f, 0]], "full": p[i, at[label, r, f, 1]]} for r, f in own if (label, r, f) in usable])
                        keys = [batch.column(c).slice(rows.start, x.shape[0]).take(pa.array(having)) for c in ("key", "cluster")]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array([label] * len(having), pa.int32()), pa.array(y[having, label].astype(np.int32)), pa.array(parts, part)], ["key", "cluster", "label", "y", "parts"])

        schema = f"key {kinds['key']}, cluster {kinds['cluster']}, label int, y int, parts array<struct<repeat: int, fold: int, base: double, full: double>>"
        return self.rows.mapInArrow(run, schema)


def opened(batch: pa.RecordBatch, labels: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Features with a leading 1, labels (NaN where there is none) and folds of some rows at a time."""
    for start in range(0, batch.num_rows, ROWS):
        own = batch.slice(start, ROWS)
        n = own.num_rows
        x, y = (own.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c in ("x", "y"))
        folds = own.column("folds").flatten().to_numpy(zero_copy_only=False).reshape(n, labels * repeats)
        yield np.c_[np.ones(n), x], y.reshape(n, labels), folds, slice(start, start + n)


def diagnostic_links(
    df: DataFrame, key: str, labels: list[str], known: list[str], residual: str, covariates: list[str] | None = None, cluster: str | None = None, k: int = 5, repeats: int = 3, least: int = 20,
    replicates: int = 1000, level: float = 0.95, margin: float = 0.02,
) -> Links:
    """key is unique; labels: columns of 0, 1 or null; both arms have covariates and known features, one also the residual.

    With clusters there is one repeat, whose folds keep them whole; without, folds are of rows, repeats times.
    """
    share_package(df.sparkSession)
    absent = [c for c in [key, *labels, *known, residual, *(covariates or [])] if c not in df.columns]
    if absent:
        raise KeyError(f"no such columns: {absent}")
    columns = [*(covariates or []), *known, residual]
    rows = df.where(finite(columns))
    rows = rows.select(F.col(key).alias("key"), F.col(cluster or key).alias("cluster"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(labels)])
    rows = staged(rows, "link-rows")
    spark, need = df.sparkSession, max(least, k)
    counts = rows.agg(*[f(F.col(f"y{i}")).alias(f"{n}{i}") for i in range(len(labels)) for n, f in (("s", F.sum), ("n", F.count))]).first()
    sizes = [(counts[f"s{i}"] or 0, counts[f"n{i}"]) for i in range(len(labels))]
    tested = [i for i, (s, n) in enumerate(sizes) if need <= s <= n - need]
    skipped = [(labels[i], f"{s} positives of {n}: each side needs {need}") for i, (s, n) in enumerate(sizes) if i not in tested]
    repeats = 1 if cluster else repeats
    dealt = rows
    for j, i in enumerate(tested):
        for r in range(repeats):
            dealt = stratified_folds(dealt, "cluster", f"y{i}", k, r, f"_f{j * repeats + r}")
    folds = [F.col(f"_f{n}").cast("int") for n in range(len(tested) * repeats)]
    empty = F.array().cast("array<int>")
    dealt = staged(dealt.select("key", "cluster", "x", F.array(*[F.col(f"y{i}").cast("double") for i in tested]).alias("y") if tested else F.array().cast("array<double>").alias("y"), (F.array(*folds) if folds else empty).alias("folds")), "link-dealt")
    fits = Fits(dealt, len(columns), len(tested), repeats, k)
    if tested:
        fits.fit()
    classes = dealt.select(F.posexplode("folds").alias("at", "fold"), "y").select("at", "fold", F.col("y")[F.floor(F.col("at") / repeats).cast("int")].alias("y")).where("y is not null")
    classes = classes.groupBy("at", "fold").agg(F.count_distinct("y").alias("classes")).where("classes = 2").collect()
    usable = {(r["at"] // repeats, r["at"] % repeats, r["fold"]) for r in classes}
    named = F.element_at(F.array(*[F.lit(labels[i]) for i in tested] or [F.lit("")]), F.col("label") + 1)
    found = staged(fits.predicted(usable).withColumn("label", named).where(F.size("parts") > 0), "link-predicted") if tested else None
    if found is None:
        found = spark.createDataFrame([], f"key {dict(rows.dtypes)['key']}, cluster {dict(rows.dtypes)['cluster']}, label string, y int, parts array<struct<repeat: int, fold: int, base: double, full: double>>")

    def mean(arm: str) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[arm]) / F.size("parts")

    predictions = found.select("key", "cluster", "label", "y", mean("base").alias("base"), mean("full").alias("full"))
    single = found.select("label", "y", F.explode("parts").alias("p")).select("label", "y", "p.*")
    by_fold = inference.fold_deltas(single.withColumn("part", F.struct("label", "repeat", "fold")), "part", "y", "base", "full").select("part.*", "auc_base", "auc_full", "delta")
    by_fold = staged(by_fold, "link-folds")
    several = by_fold.groupBy("label").agg(F.count("delta").alias("n_folds"), F.count_if(F.col("delta") > 0).alias("folds_positive"))
    size = predictions.groupBy("label").agg(F.count(F.lit(1)).alias("covered"), F.count_distinct("y").alias("classes"))
    fit_to_judge = {r["label"]: r for r in several.join(size, "label").collect()}
    judged = []
    for i in tested:
        r = fit_to_judge.get(labels[i])
        if r is None or r["n_folds"] < 2 or r["covered"] < 2 * need:
            skipped.append((labels[i], "too few usable folds for an interval"))
        elif r["classes"] < 2:
            skipped.append((labels[i], "one class only among the predictions"))
        else:
            judged.append(i)
    kept = predictions.where(F.col("label").isin([labels[i] for i in judged]))
    point = inference.fold_deltas(kept, "label", "y", "base", "full")
    # The tails of both verdicts are read off the same draws.
    draws = staged(inference.auc_differences(kept, "cluster", "y", "base", "full", replicates, by=["label"]), "link-draws")
    tails = {"low": tail(level, max(len(tested), 1)), "plain_low": (1 - level) / 2}
    ends = [F.percentile("d", F.lit(q)).alias(c) for low, high in (("low", "high"), ("plain_low", "plain_high")) for c, q in ((low, tails[low]), (high, 1 - tails[low]))]
    interval = draws.groupBy("label").agg(F.count("d").alias("drawn"), *ends)
    enough = F.col("drawn") * 2 >= replicates
    interval = interval.select("label", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "plain_low", "plain_high")])
    numbers = spark.createDataFrame([(labels[i], *sizes[i]) for i in judged], "label string, n_positive long, n long")
    out = numbers.join(point, "label").join(interval, "label").join(several, "label")
    better, same = inference.verdict(F.col("low"), F.col("high"), F.col("plain_low"), F.col("plain_high"), margin)
    better, same = F.coalesce(better, F.lit(False)), F.coalesce(same, F.lit(False))
    out = out.select(
        "label", "n_positive", "n", (F.col("n_positive") / F.col("n")).alias("prevalence"), "auc_base", "auc_full", "delta", "low", "high", "plain_low", "plain_high",
        inference.tightest_bound(F.col("plain_low"), F.col("plain_high")).alias("tightest"), "folds_positive", "n_folds", better.alias("improves"), same.alias("equivalent"),
        F.when(better, "improves").when(same, "equivalent").otherwise("inconclusive").alias("verdict"),
    )
    return Links(out, spark.createDataFrame(skipped, "label string, reason string"), by_fold, predictions)
