"""Path attribution of scorers against fine sums and the completeness axiom, and beats found by several leads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import signals
from plumbline.operators import paths
from plumbline.sources import synthetic

WEIGHTS = np.array([1.5, -2.0, 0.0, 0.7, 3.0, -0.4])


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(f"r{i}", draw.normal(size=6).tolist()) for i in range(40)]
    rows += [("null", None), ("nan", [float("nan")] + [0.0] * 5), ("short", [1.0, 2.0]), ("zero", [0.0] * 6)]
    return spark.createDataFrame(rows, "id string, v array<double>").repartition(3)


@pytest.mark.parametrize("baseline", ["zero", "flatline", "mean"])
def test_attributions_are_those_of_a_fine_sum(vectors, baseline):
    scorer = paths.logistic(WEIGHTS, 0.3)
    got = {r["id"]: r for r in paths.path_attribution(vectors, "id", "v", scorer, baseline, leads=2, steps=64, absolute=1e-3, relative=1e-3).collect()}
    own = {r["id"]: np.array(r["v"]) for r in vectors.collect() if r["id"].startswith(("r", "zero"))}
    assert set(got) == set(own)
    mean = np.mean(list(own.values()), axis=0)
    for k, x in own.items():
        start = {"zero": np.zeros(6), "mean": mean, "flatline": np.repeat(np.median(x.reshape(2, 3), axis=1), 3)}[baseline]
        at = start[None] + ((np.arange(20_000) + 0.5) / 20_000)[:, None] * (x - start)[None]
        fine = (x - start) * scorer(at)[1].mean(axis=0)
        r = got[k]
        assert np.allclose(r["attribution"], fine, atol=2e-4) and r["attribution"][2] == 0
        assert r["score"] == pytest.approx(scorer(x[None])[0][0]) and r["baseline_score"] == pytest.approx(scorer(start[None])[0][0])
        assert r["error"] == pytest.approx(sum(r["attribution"]) - (r["score"] - r["baseline_score"])) and not r["flagged"]


def test_wrong_gradients_and_few_steps_are_flagged(vectors):
    right = paths.logistic(5 * WEIGHTS, 0.0)
    broken = lambda x: (right(x)[0], np.zeros_like(x))
    rule = {"absolute": 0.01, "relative": 0.05}
    bad = paths.path_attribution(vectors, "id", "v", broken, **rule).collect()
    assert all(r["flagged"] == (abs(r["score"] - r["baseline_score"]) * 0.95 > 0.01) for r in bad) and any(r["flagged"] for r in bad)
    few = sum(r["flagged"] for r in paths.path_attribution(vectors, "id", "v", right, steps=1, **rule).collect())
    assert few > sum(r["flagged"] for r in paths.path_attribution(vectors, "id", "v", right, steps=128, **rule).collect()) == 0
    # Steps that don't fit together are taken in turn.
    assert paths.path_attribution(vectors.where("false"), "id", "v", right, "mean").count() == 0


def test_what_is_refused(vectors):
    for more, match in (({"baseline": "black"}, "baselines"), ({"steps": 0}, "step"), ({"leads": 4}, "equal length")):
        with pytest.raises(ValueError, match=match):
            paths.path_attribution(vectors, "id", "v", paths.logistic(WEIGHTS, 0.0), **more)


def test_steps_are_taken_in_turn(monkeypatch):
    x, scorer = np.random.default_rng(1).normal(size=(7, 6)), paths.logistic(WEIGHTS, 0.1)
    whole = paths.integrated(scorer, x, np.zeros_like(x), 50)
    monkeypatch.setattr(paths, "VALUES", 100)
    assert np.allclose(paths.integrated(scorer, x, np.zeros_like(x), 50), whole)


@pytest.fixture(scope="module")
def cohort(spark):
    r = synthetic.cohort(spark, 8, fs=250, seconds=6, noise=0.02, wander=0.03).cache()
    lead = lambda k: F.transform("signal", lambda v: v * k)
    return r.withColumn("inverted", lead(-1.0)).withColumn("small", lead(0.4)).withColumn("flat", lead(0.0)).cache()


def near(found, true, fs=250):
    return sum(any(abs(f - t) <= 0.02 * fs for f in found) for t in true) / len(true)


def test_inverted_leads_have_the_peaks_of_upright_ones(cohort):
    got = cohort.select("true_peaks", signals.r_peaks(F.col("signal"), 250).alias("up"), signals.r_peaks(F.col("inverted"), 250).alias("down"), signals.r_peaks(F.col("flat"), 250).alias("none")).collect()
    for r in got:
        assert r["up"] == r["down"] and r["none"] == [] and near(r["up"], r["true_peaks"]) >= 0.75


def test_leads_vote(cohort):
    several = cohort.withColumn("leads", F.array("signal", "inverted", "small", "flat"))
    got = {r["record_id"]: r for r in signals.multi_lead_peaks(several, "record_id", "leads", 250).collect()}
    alone = {r["record_id"]: r["p"] for r in cohort.select("record_id", signals.r_peaks(F.col("signal"), 250).alias("p")).collect()}
    assert {k: r["peaks"] for k, r in got.items()} == alone and all(r["n_leads"] == 3 for r in got.values())
    # A lead that sees beats of its own is outvoted; without any, there are none.
    shifted = F.concat(F.slice("signal", 101, 1400), F.slice("signal", 1, 100))
    outvoted = cohort.withColumn("leads", F.array("signal", "inverted", "small", shifted))
    for r in signals.multi_lead_peaks(outvoted, "record_id", "leads", 250, least=0.6).collect():
        assert near(r["peaks"], alone[r["record_id"]]) > 0.9 and len(r["peaks"]) <= len(alone[r["record_id"]]) + 1
    none = signals.multi_lead_peaks(cohort.withColumn("leads", F.array("flat")), "record_id", "leads", 250).collect()
    assert len(none) == 8 and all(r["peaks"] == [] and r["n_leads"] == 0 for r in none)


def test_a_flat_line_lies_at_the_lower_median():
    x = np.array([[4.0, 1.0, 3.0, 2.0, 9.0, 9.0, 0.0, 0.0]])
    assert paths.baseline_of("flatline", x, None, 2).tolist() == [[2.0] * 4 + [0.0] * 4]
