"""The sweep over subsets: all on the same rows, linear points against brute force, boosted models grown together."""

import math

import numpy as np
import pytest

from plumbline.operators.accumulate import sweep_known
from plumbline.operators.boosting import Settings

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(2)
    out = []
    for i in range(300):
        a, b, c, d, e = draw.normal(size=5)
        out.append([i, i // 2, (i // 2) % 4, float(a + 0.7 * b + (2.0 if c > 0.5 else 0.0) + draw.normal() * 0.5), float(20 + i % 50), float(a), float(b), float(c), float(d) if i != 7 else None, float(e)])
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, patient long, part int, gap double, age double, a double, b double, c double, d double, e double")


def test_linear_sweep(frame, rows):
    curve = sweep_known(frame, "id", "gap", ["age"], FEATURES, "part", "patient", ("linear",), named={"pair": ["a", "e"]}, replicates=100)
    kept = [r for r in rows if r[8] is not None]
    x, part, y = np.array([r[4:] for r in kept]), np.array([r[2] for r in kept]), np.array([r[3] for r in kept])

    def share(names):
        z, p = np.c_[np.ones(len(y)), x[:, [0, *["abcde".index(f) + 1 for f in names]]]], np.zeros(len(y))
        for k in range(4):
            p[part == k] = z[part == k] @ np.linalg.lstsq(z[part != k], y[part != k], rcond=None)[0]
        return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    base = max(share([]), 0)
    points = curve.points.collect()
    assert len([p for p in points if p["label"] is None]) == 4 + 6 + 4 + 1 and [p["features"] for p in points if p["label"] == "pair"] == [["a", "e"]]
    for p in points:
        assert p["r2_full"] == pytest.approx(share(p["features"])) and p["incremental"] == pytest.approx(share(p["features"]) - base) and p["k"] == len(p["features"])
    levels = {r["k"]: r["mean"] for r in curve.levels.collect()}
    assert levels == {k: pytest.approx(np.mean([share(p["features"]) - base for p in points if p["label"] is None and p["k"] == k])) for k in (1, 2, 3, 4)}
    s = curve.summary.first()
    assert (s["n"], s["n_dropped"]) == (299, 1) and s["full_set"] == pytest.approx(share(FEATURES) - base) and s["low"] < s["full_set"] < s["high"]
    tail = levels[4] - levels[3]
    assert s["tail_gain"] == pytest.approx(tail) and s["tail_log_slope"] == pytest.approx(tail / math.log(4 / 3)) and s["saturated"] == (tail <= 0.01 and tail / math.log(4 / 3) <= 0.01)
    assert s["saturation_fraction"] is None if s["ceiling"] is None else s["saturation_fraction"] == pytest.approx(s["full_set"] / s["ceiling"])
    assert s["spread_warn"] and s["spread_k"] in (1, 2)


def test_boosted_points_win_where_lines_miss(frame):
    curve = sweep_known(frame, "id", "gap", [], ["a", "c"], "part", "patient", draws=2, sizes=[1, 2], named={"step": ["c"]}, replicates=100, settings=Settings(rounds=14, rate=0.3))
    points = {(p["label"], *p["features"]): p for p in curve.points.collect()}
    assert len(points) == 4 and points[None, "c"]["explainer"] == "boosted" and points[None, "a"]["explainer"] == "linear"
    assert points["step", "c"]["incremental"] == pytest.approx(points[None, "c"]["incremental"]) and curve.summary.first()["explainer"] in ("linear", "boosted")


def test_what_is_refused(frame):
    with pytest.raises(KeyError, match="absent"):
        sweep_known(frame, "id", "gap", [], ["a"], "part", named={"x": ["zzz"]})
    with pytest.raises(ValueError, match="size"):
        sweep_known(frame, "id", "gap", [], ["a"], "part", sizes=[5])
