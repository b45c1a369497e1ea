"""The decomposition in one call against fits fold by fold and draws cluster by cluster."""

import numpy as np
import pytest

from plumbline.operators import replicates
from plumbline.operators.boosting import Settings
from plumbline.operators.decompose import decompose


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    n = 330
    patient, age, sex = np.arange(n) // 2, draw.uniform(20, 80, n), draw.integers(0, 2, n).astype(float)
    a, b, c = draw.normal(size=n), draw.normal(size=n), draw.normal(size=n)
    y = 0.05 * age + 1.5 * a + np.where(b > 0, 2.0, -2.0) + draw.normal(size=n)
    return [[f"k{i}", int(patient[i]), int(patient[i] % 5), float(y[i]), float(age[i]), float(sex[i]), float(a[i]), float(b[i]), float(c[i])] for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    bad = [["x1", 900, 1, None, 40.0, 1.0, 0.0, 0.0, 0.0], ["x2", 901, 2, 1.0, float("nan"), 1.0, 0.0, 0.0, 0.0], ["x3", 902, 3, 1.0, 30.0, 1.0, float("inf"), 0.0, 0.0], ["x4", 903, None, 1.0, 30.0, 1.0, 0.0, 0.0, 0.0]]
    return spark.createDataFrame(rows + bad, "id string, patient long, part int, gap double, age double, sex double, a double, b double, c double").repartition(3)


def test_linear_decomposition_is_the_brute_force_one(frame, rows):
    d = decompose(frame, "id", "gap", ["age", "sex"], ["a", "b", "c"], "part", "patient", ("linear",), 200)
    x = np.array([[r[3], *r[4:]] for r in rows])
    patient, part, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), x[:, 0]

    def held_out(columns):
        z, p = np.c_[np.ones(len(y)), x[:, columns]], np.zeros(len(y))
        for k in range(5):
            p[part == k] = z[part == k] @ np.linalg.lstsq(z[part != k], y[part != k], rcond=None)[0]
        return p

    p = {"base": held_out([1, 2]), "full": held_out([1, 2, 3, 4, 5]), **{f: held_out([1, 2, 3 + i]) for i, f in enumerate("abc")}}
    share = lambda at, q: 1 - ((y - q)[at] ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum()
    every = np.arange(len(y))
    base = max(share(every, p["base"]), 0)
    w = replicates.weights(np.arange(165), 200)
    drawn = {k: [] for k in ("full", "full_inc", "a", "b", "c")}
    for r in range(200):
        at = np.repeat(every, w[patient, r])
        floor = max(share(at, p["base"]), 0)
        drawn["full"].append(share(at, p["full"]))
        for k, q in (("full_inc", "full"), ("a", "a"), ("b", "b"), ("c", "c")):
            drawn[k].append(share(at, p[q]) - floor)
    got = d.explainers.collect()
    assert len(got) == 1
    got, full = got[0], share(every, p["full"])
    assert (got["n"], got["n_dropped"], got["most_explanatory"]) == (330, 4, True) and got["gap_sd"] == pytest.approx(y.std())
    want = (base, full, full - base, 1 - full, *np.quantile(drawn["full"], [0.025, 0.975]), *np.quantile(drawn["full_inc"], [0.025, 0.975]))
    assert [got[c] for c in ("r2_base", "r2_full", "incremental", "unexplained", "full_low", "full_high", "incremental_low", "incremental_high")] == pytest.approx(list(want))
    z = np.c_[np.ones(len(y)), x[:, 1:]]
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    for i, r in enumerate(sorted(d.features.collect(), key=lambda r: r["feature"])):
        assert r["effect"] == pytest.approx(beta[3 + i] * x[:, 3 + i].std()) and r["univariate"] == pytest.approx(share(every, p["abc"[i]]) - base)
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(drawn["abc"[i]], [0.025, 0.975])))
    left = {r["id"]: r["residual"] for r in d.residuals.collect()}
    assert left == {r[0]: pytest.approx(y[i] - p["full"][i]) for i, r in enumerate(rows)} and d.warnings.count() == 0


def test_both_explainers_on_the_same_rows(frame):
    d = decompose(frame, "id", "gap", ["age"], ["a", "b"], "part", "patient", replicates=100, settings=Settings(rounds=12, rate=0.3))
    got = {r["explainer"]: r for r in d.explainers.collect()}
    assert set(got) == {"linear", "boosted"} and sum(r["most_explanatory"] for r in got.values()) == 1
    for r in got.values():
        assert r["full_low"] < r["r2_full"] < r["full_high"] and r["incremental_low"] < r["incremental"] < r["incremental_high"] and r["unexplained"] == pytest.approx(1 - r["r2_full"])
    assert d.residuals.count() == 660 and d.residuals.select("id", "explainer").distinct().count() == 660
    effects = {(r["explainer"], r["feature"]): r["effect"] for r in d.features.collect()}
    assert len(effects) == 4 and 0 < effects["boosted", "a"] < 1 and 0 < effects["boosted", "b"] < 1


def test_what_is_refused_and_warned_of(frame):
    with pytest.raises(KeyError, match="nothing"):
        decompose(frame, "id", "gap", ["age"], ["nothing"], "part")
    with pytest.raises(ValueError, match="explainers"):
        decompose(frame, "id", "gap", ["age"], ["a"], "part", explainers=("forest",))
    with pytest.raises(ValueError, match="too few"):
        decompose(frame.where("part = 1"), "id", "gap", ["age"], ["a"], "part")
    few = decompose(frame.where("patient < 20"), "id", "gap", [], ["c"], "part", explainers=("linear",), replicates=100)
    said = [r["warning"] for r in few.warnings.collect()]
    assert any("only 40 rows" in w for w in said)
    assert few.explainers.first()["incremental"] >= 0 or any("negative" in w for w in said)
