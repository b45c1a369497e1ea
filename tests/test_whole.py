"""Queries without SQL over whole tables, against brute force on the smallest ones."""

from itertools import combinations

import numpy as np
import pytest

from plumbline.operators import replicates, sweep
from plumbline.plans import queries as plans
from plumbline.plans.frames import order_features

FOLDER = "/root/testdata/sf0.001"


def scrambled(x):
    z = np.asarray(x, np.int64) % 2**32
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        z = (z ^ (z >> shift)) * factor % 2**32
    return z ^ (z >> 15)


def times(replicate, clusters):
    share = scrambled(scrambled(clusters) ^ scrambled(replicate + 1)) / 2**32
    return (share[:, None] >= np.array(replicates.POISSON)).sum(axis=1)


def test_draws_are_poisson_of_mean_1_and_unlike_each_other():
    drawn = np.array([times(b, np.arange(20_000)) for b in range(40)])
    assert abs(drawn.mean() - 1) < 0.005 and abs(drawn.var() - 1) < 0.01
    assert np.abs(np.corrcoef(drawn) - np.eye(40)).max() < 0.04
    # Sums over replicates spread as those of independent draws do.
    assert abs(drawn.sum(axis=1).std() / 20_000**0.5 - 1) < 0.35


def out_of_fold(pdf, columns):
    fitted = np.zeros(len(pdf))
    x = np.c_[np.ones(len(pdf)), pdf[columns]]
    for k in set(pdf.fold):
        own = (pdf.fold == k).to_numpy()
        beta, *_ = np.linalg.lstsq(x[~own], pdf.y.to_numpy()[~own], rcond=None)
        fitted[own] = x[own] @ beta
    return fitted


def test_bootstrap_takes_every_customer_and_fits_full_on_age_and_lines(spark):
    pdf = order_features(spark, FOLDER).toPandas()
    y, base, full = pdf.y.to_numpy(), out_of_fold(pdf, ["age"]), out_of_fold(pdf, ["age", "lines"])
    clusters = np.array(sorted(set(pdf.o_custkey)))
    rows = [np.flatnonzero(pdf.o_custkey == c) for c in clusters]
    r_full, r_inc = [], []
    for b in range(1000):
        at = np.repeat(np.concatenate(rows), np.repeat(times(b, clusters), [len(r) for r in rows]))
        sst = ((y[at] - y[at].mean()) ** 2).sum()
        r_full.append(1 - ((y - full)[at] ** 2).sum() / sst)
        r_inc.append(r_full[-1] - max(1 - ((y - base)[at] ** 2).sum() / sst, 0))
    got = plans.QUERIES["cluster_bootstrap_r2"](spark, FOLDER).collect()[0]
    assert got["replicates"] == 1000
    for name, values in (("r_full", r_full), ("r_inc", r_inc)):
        assert got[f"{name}_low"] == pytest.approx(np.quantile(values, 0.025), abs=2e-6)
        assert got[f"{name}_high"] == pytest.approx(np.quantile(values, 0.975), abs=2e-6)


def auc(score, label):
    gap = score[label == 1][:, None] - score[label == 0][None, :]
    return ((gap > 0) + (gap == 0) / 2).mean()


def test_auc_queries_take_1000_replicates(spark):
    pdf = plans._labelled(spark, FOLDER).toPandas()
    label, base, full = pdf.label.to_numpy(), pdf.base.to_numpy(), pdf.full.to_numpy()
    clusters = np.array(sorted(set(pdf.cluster)))
    rows = [np.flatnonzero(pdf.cluster == c) for c in clusters]
    d = []
    for b in range(1000):
        at = np.repeat(np.concatenate(rows), np.repeat(times(b, clusters), [len(r) for r in rows]))
        if 0 < label[at].sum() < len(at):
            d.append(auc(full[at], label[at]) - auc(base[at], label[at]))
    got = plans.QUERIES["delta_auc_bootstrap"](spark, FOLDER).collect()[0]
    assert (got["replicates"], got["low"], got["high"]) == (len(d), pytest.approx(np.quantile(d, 0.025), abs=2e-6), pytest.approx(np.quantile(d, 0.975), abs=2e-6))
    low, pl, ph = np.quantile(d, [0.005, 0.025, 0.975])
    got = plans.QUERIES["superiority_tost_verdict"](spark, FOLDER).collect()[0]
    assert got["low"] == pytest.approx(low, abs=2e-6) and got["improves"] == (low > 0) and got["equivalent"] == (pl > -0.02 and ph < 0.02)


def test_sweep_takes_every_subset_and_feeds_the_verdicts(spark):
    pdf = order_features(spark, FOLDER).toPandas()
    y, scores = pdf.y.to_numpy(), {}
    for k in range(1, 5):
        for x in combinations(["lines", "qty", "disc", "tax"], k):
            e = y - out_of_fold(pdf, ["age", *x])
            scores.setdefault(k, []).append(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    near = lambda v: pytest.approx(v, abs=2e-6)
    got = {r["k"]: r for r in plans.QUERIES["sweep_levels"](spark, FOLDER).collect()}
    assert {k: r["n"] for k, r in got.items()} == {1: 4, 2: 6, 3: 4, 4: 1}
    for k, r in got.items():
        v = np.array(scores[k])
        assert (r["mean"], r["sd"], r["low"], r["high"]) == (near(v.mean()), near(v.std(ddof=1) if len(v) > 1 else 0.0), near(v.min()), near(v.max()))
    means = np.array([np.mean(scores[k]) for k in range(1, 5)])
    tail = means[3] - means[2]
    want = (near(np.polyfit(np.log([1, 2, 3, 4]), means, 1)[0]), near(tail), near(tail / np.log(4 / 3)))
    r = plans.QUERIES["log_slope_tail"](spark, FOLDER).collect()[0]
    assert (r["log_slope"], r["tail_gain"], r["tail_log_slope"]) == want
    r = plans.QUERIES["saturation_verdict"](spark, FOLDER).collect()[0]
    assert (r["log_slope"], r["tail_gain"], r["tail_log_slope"], r["saturated"]) == (*want, bool(tail <= 0.01 and tail / np.log(4 / 3) <= 0.01))
    spread = {k: max(v) - min(v) for k, v in scores.items()}
    r = plans.QUERIES["spread_warning"](spark, FOLDER).collect()[0]
    assert (r["k"], r["spread"], r["warn"]) == (max(spread, key=spread.get), near(max(spread.values())), max(spread.values()) >= 0.02)
    fit = sweep.ceiling([1, 2, 3, 4], means.tolist())
    r = plans.QUERIES["sweep_ceiling"](spark, FOLDER).collect()[0]
    assert r["refused"] == fit.refused and r["value"] == (fit.value and pytest.approx(fit.value, abs=1e-4))
