"""The diagnostic link in one call: fits equal to separate ones, gate, folds, verdicts, what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import replicates
from plumbline.operators.link import diagnostic_links

KNOWN = ["rate", "width"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(9)
    out = []
    for i in range(500):
        rate, width, residual, age = draw.normal(70, 10), draw.normal(95, 12), draw.normal(0, 4), draw.uniform(20, 80)
        strong = int(draw.random() < 1 / (1 + np.exp(0.4 - 0.05 * (width - 95) - 0.5 * residual)))
        weak = int(draw.random() < 1 / (1 + np.exp(0.4 - 0.05 * (width - 95))))
        out.append([i, i // 2, float(rate), float(width), float(residual), float(age), strong if i % 50 else None, weak, int(i < 5)])
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    bad = [[9000, 9000, None, 1.0, 1.0, 40.0, 1, 1, 1], [9001, 9001, 60.0, 1.0, float("nan"), 40.0, 1, 1, 1]]
    return spark.createDataFrame(rows + bad, "id long, patient long, rate double, width double, residual double, age double, strong int, weak int, rare int").repartition(3)


def separate_fit(x, y):
    """Penalized logistic regression of strength 1 over standardized columns, by plain Newton steps; returns a function."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w, keep = np.zeros(z.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
    return lambda v: 1 / (1 + np.exp(-np.c_[np.ones(len(v)), (v - mean) / sd] @ w))


def auc(score, y, times=None):
    times = np.ones(len(y)) if times is None else times
    p, q = times * (y == 1), times * (y == 0)
    gap = (score[:, None] > score[None, :]) + (score[:, None] == score[None, :]) / 2
    return (p[:, None] * q[None, :] * gap).sum() / (p.sum() * q.sum())


@pytest.mark.parametrize("clustered", [True, False])
def test_links_equal_separate_fits(frame, rows, clustered):
    found = diagnostic_links(frame, "id", ["strong", "weak", "rare"], KNOWN, "residual", ["age"], "patient" if clustered else None, k=4, repeats=2, replicates=100)
    assert [(r["label"], r["reason"].split(":")[0]) for r in found.skipped.collect()] == [("rare", "5 positives of 500")]
    links = {r["label"]: r for r in found.links.collect()}
    assert set(links) == {"strong", "weak"}
    # Folds as the run dealt them, seen through its table of folds and predictions.
    by_fold = found.folds.toPandas()
    assert len(by_fold) == 2 * 4 * (1 if clustered else 2)
    pdf = found.predictions.toPandas()
    for name in ("strong", "weak"):
        own = {r[0]: r for r in rows if r[6 if name == "strong" else 7] is not None}
        p = pdf[pdf.label == name].set_index("key")
        assert set(p.index) == set(own)
        y = p.y.to_numpy()
        r = links[name]
        assert r["n"] == len(own) and r["n_positive"] == y.sum() and r["prevalence"] == pytest.approx(y.mean())
        assert (r["auc_base"], r["auc_full"]) == (pytest.approx(auc(p.base.to_numpy(), y)), pytest.approx(auc(p.full.to_numpy(), y)))
        w = replicates.weights(np.array([own[i][1] if clustered else i for i in p.index]), 100).astype(float)
        d = [auc(p.full.to_numpy(), y, w[:, b]) - auc(p.base.to_numpy(), y, w[:, b]) for b in range(100)]
        assert [r[c] for c in ("low", "high", "plain_low", "plain_high")] == pytest.approx(list(np.quantile(d, [0.0125, 0.9875, 0.025, 0.975])))
        assert r["improves"] == (r["low"] > 0) and r["equivalent"] == (r["plain_low"] > -0.02 and r["plain_high"] < 0.02) and r["tightest"] == pytest.approx(max(abs(r["plain_low"]), abs(r["plain_high"])))
        own_folds = by_fold[by_fold.label == name]
        assert r["n_folds"] == len(own_folds) and r["folds_positive"] == (own_folds.delta > 0).sum()
    assert links["strong"]["verdict"] == "improves"


def test_probabilities_are_those_of_separate_fits(spark, frame, rows):
    from plumbline.operators.link import Fits
    from plumbline.sources.staging import staged

    own = [(r[0], r[1], [r[5], r[2], r[3], r[4]], [float(r[7]), None if r[6] is None else float(r[6])], [(r[1] * 7) % 3, (r[1] * 5) % 3]) for r in rows]
    df = staged(spark.createDataFrame(own, "key long, cluster long, x array<double>, y array<double>, folds array<int>").repartition(3), "link-test")
    fits = Fits(df, 4, 2, 1, 3)
    fits.fit()
    got = {(r["key"], r["label"]): r["parts"] for r in fits.predicted({(label, 0, f) for label in range(2) for f in range(3)}).collect()}
    x = np.array([o[2] for o in own])
    for label in range(2):
        y = np.array([np.nan if o[3][label] is None else o[3][label] for o in own])
        fold, there = np.array([o[4][label] for o in own]), ~np.isnan(y)
        for f in range(3):
            train, test = there & (fold != f), np.flatnonzero(there & (fold == f))
            base, full = separate_fit(x[train][:, :3], y[train])(x[test][:, :3]), separate_fit(x[train], y[train])(x[test])
            for i, b, c in zip(test, base, full, strict=True):
                (part,) = got[own[i][0], label]
                assert (part["fold"], part["base"], part["full"]) == (f, pytest.approx(b, abs=1e-6), pytest.approx(c, abs=1e-6))


def test_what_is_refused(frame):
    with pytest.raises(KeyError, match="nothing"):
        diagnostic_links(frame, "id", ["strong"], ["nothing"], "residual")
    none = diagnostic_links(frame, "id", ["rare"], KNOWN, "residual", replicates=100)
    assert none.links.count() == 0 and none.skipped.count() == 1 and none.predictions.count() == 0 and none.folds.count() == 0
    alone = diagnostic_links(frame.withColumn("far", (F.col("id") >= 480).cast("int")).withColumn("group", F.col("far").cast("long")), "id", ["far"], KNOWN, "residual", cluster="group", replicates=100, k=2)
    assert alone.links.count() == 0 and "usable folds" in alone.skipped.first()["reason"]
