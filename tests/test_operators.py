"""Constructed truth: effects that are built in are found, and those that aren't are not."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cohort, inference, regression, segments, splits, sweep, waves


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(3)
    n = 2000
    age = rng.uniform(20, 90, n)
    f, g = rng.normal(size=n), rng.normal(size=n)
    pdf = pd.DataFrame({"record_id": range(n), "patient": np.arange(n) // 2, "age": age, "f": f, "g": g, "of_age": age / 10, "same": f, "apart": rng.normal(size=n), "by_age": age + rng.normal(size=n), "run_noise": rng.normal(size=n)})
    return splits.folds(spark.createDataFrame(pdf), "patient", 5)


def one(df):
    return df.collect()[0].asDict()


def test_gap_that_is_a_feature(gaps):
    assert one(regression.decomposition(gaps, "same", ["age"], ["f", "g"], "fold"))["r2_full"] > 0.95


def test_gap_apart_from_features(gaps):
    assert one(regression.decomposition(gaps, "apart", ["age"], ["f", "g"], "fold"))["r2_full"] < 0.1


def test_adjustment_takes_what_a_covariate_explains(gaps):
    assert one(regression.decomposition(gaps, "by_age", [], ["of_age"], "fold"))["incremental"] > 0.6
    adjusted = one(regression.decomposition(gaps, "by_age", ["age"], ["of_age"], "fold"))
    assert adjusted["incremental"] < 0.1 < 0.6 < adjusted["r2_base"]


def test_sums_equal_direct_least_squares(gaps):
    pdf = gaps.toPandas()
    predicted = np.zeros(len(pdf))
    for k in range(5):
        train, own = pdf[pdf.fold != k], pdf.fold == k
        x = np.c_[np.ones(len(train)), train[["age", "f"]]]
        beta, *_ = np.linalg.lstsq(x, train["by_age"], rcond=None)
        predicted[own] = np.c_[np.ones(own.sum()), pdf[own][["age", "f"]]] @ beta
    want = 1 - ((pdf["by_age"] - predicted) ** 2).mean() / pdf["by_age"].var(ddof=0)
    assert math.isclose(regression.Sums(gaps, "by_age", ["age", "f", "g"], "fold").r2(["age", "f"]), want, abs_tol=1e-9)


def test_rows_that_cannot_be_measured_are_counted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0)], "a double, b double")
    assert one(cohort.drop_counts(df, ["a", "b"])) == {"n_used": 1, "n_dropped": 3}


def test_code_map_survives_malformed_text(spark):
    df = spark.createDataFrame([("{'NORM': 100.0, 'SR': 0.0}",), ("{oops",), (None,), ("{}",)], "scp string")
    assert [sorted(r[0]) for r in df.select(F.map_keys(cohort.code_map(F.col("scp")))).collect()] == [["NORM", "SR"], [], [], []]


def test_patient_split_never_leaks_and_row_split_does(gaps):
    split = splits.patient_split(gaps, "patient")
    assert splits.leaking(split, "patient").isEmpty()
    shares = {r["split"]: r["count"] / 2000 for r in split.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.05 and abs(shares["val"] - 0.1) < 0.05
    by_row = splits.patient_split(gaps, "record_id")
    leak = one(splits.leakage(by_row, "patient"))
    assert leak["n_leaked"] > 0.2 * leak["n_test"]


def test_dead_lead_stays_finite(spark):
    long = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (1, 2.0)], "lead int, x double")
    z = splits.normalized(long, splits.lead_stats(long)).groupBy("lead").agg(F.max("z").alias("m")).collect()
    assert {r["lead"]: r["m"] for r in z} == {0: 1.0, 1: 0.0}


def test_bootstrap_brackets_the_estimate(gaps):
    df = gaps.withColumn("base", F.lit(0.0)).withColumn("full", F.col("f") + F.col("run_noise") * 0.5)
    out = one(inference.bootstrap_r2(df, "patient", "same", "base", "full", 200))
    assert out["replicates"] == 200 and out["r_full_low"] < 0.75 < out["r_full_high"] and out["r_full_high"] - out["r_full_low"] < 0.1


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (None, 0.3)], "y int, s double")
    assert one(inference.auc(df, "y", "s"))["auc"] == pytest.approx(0.875)


@pytest.mark.parametrize("nu", [0.1, 0.3, 0.6])
def test_noise_floor_is_recovered(spark, nu):
    rng = np.random.default_rng(5)
    shared = rng.normal(size=3000) * math.sqrt(1 - nu)
    pdf = pd.concat([pd.DataFrame({"k": range(3000), "run": r, "gap": shared + rng.normal(size=3000) * math.sqrt(nu)}) for r in "abc"])
    assert abs(one(inference.noise_floor(spark.createDataFrame(pdf), "k", "run", "gap", ["a", "b", "c"]))["nu"] - nu) < 0.05


def test_verdicts(spark):
    rows = [(0.01, 0.0, 0.01), (0.05, 0.02, 0.09), (-0.01, -0.005, 0.01), (-0.1, -0.1, 0.1)]
    df = spark.createDataFrame(rows, "low double, pl double, ph double")
    v = df.select(inference.verdict_text(*inference.verdict(F.col("low"), F.col("low"), F.col("pl"), F.col("ph"), 0.02)).alias("v")).collect()
    assert [r["v"] for r in v] == ["improves within margin", "improves", "equivalent", "inconclusive"]


def test_ceiling():
    sizes = [1, 2, 3, 5, 8]
    fit = sweep.ceiling(sizes, [0.4 * k / (k + 2) for k in sizes])
    assert fit.refused is None and abs(fit.value - 0.4) < 0.01 and abs(fit.half - 2) < 0.1
    assert sweep.ceiling(sizes, [0.0] * 5).refused == "nothing explained"
    assert sweep.ceiling(sizes[:3], [0.1, 0.2, 0.3]).refused == "fewer than four levels"
    assert sweep.ceiling(sizes, [k / 8 for k in sizes]).refused


def test_subsets():
    assert sweep.subset_sizes(15) == [1, 2, 3, 5, 8, 13, 15]
    assert len(sweep.draw_subsets(list("abcd"), 2, 100, 1)) == 6
    assert sweep.draw_subsets(list("abcdefgh"), 3, 5, 1) == sweep.draw_subsets(list("abcdefgh"), 3, 5, 1)


def test_detection_scoring(spark):
    ref = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 1.0)], "k int, t double")
    det = spark.createDataFrame([(1, 1.01), (1, 2.04), (1, 2.03), (3, 5.0)], "k int, t double")
    # The first takes 103; the second takes what is left, 108, though it isn't the nearest of any other.
    ref = ref.union(spark.createDataFrame([(4, 100.0), (4, 104.0)], ref.schema))
    det = det.union(spark.createDataFrame([(4, 103.0), (4, 108.0)], det.schema))
    wide = {r["k"]: r for r in waves.scored(ref, det, "k", "t", 5.0).collect()}
    assert (wide[4]["n_matched"], wide[4]["mean_error"], wide[4]["max_error"]) == (2, pytest.approx(3.5), pytest.approx(4.0))
    out = {r["k"]: r for r in waves.scored(ref, det, "k", "t", 0.05).collect()}
    assert (out[1]["n_matched"], out[1]["sensitivity"], out[1]["ppv"]) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert out[1]["mean_error"] == pytest.approx(0.02) and out[1]["max_error"] == pytest.approx(0.03)
    assert out[2]["ppv"] is None and out[3]["sensitivity"] is None and out[3]["f1"] == 0


def test_trailing_force(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, -0.5, -0.25])] + [("b", 0, -1.0), ("b", 1, 1.0)], "k string, i int, x double")
    out = {r["k"]: (r["length"], r["depth"], r["force"]) for r in waves.trailing_force(df, "k", "x", ["i"], 0.0, 2.0).collect()}
    assert out == {"a": (2, 0.5, -2.0), "b": (0, 0.0, 0.0)}


def test_segments_are_disjoint_and_complete(spark):
    samples = spark.range(200).select(F.lit(1).alias("r"), F.lit(0).alias("lead"), F.col("id").cast("int").alias("at"), F.lit(1.0).alias("x"))
    beats = spark.createDataFrame([(1, "p", 10, 45), (1, "qrs", 40, 70), (1, "t", 90, 150)], "r int, segment string, onset int, offset int")
    tagged = segments.segments_of_beats(samples, beats, "r", "at")
    sizes = {r["segment"]: r["count"] for r in tagged.groupBy("segment").count().collect()}
    assert sizes == {"p": 30, "qrs": 31, "t": 61, "other": 78}
    out = segments.by_segment(tagged, "r", "x").collect()
    assert sum(r["share"] for r in out) == pytest.approx(1) and all(r["density"] == pytest.approx(1) for r in out)


def test_integrated_gradients_are_complete(spark):
    s = spark.createDataFrame([(1, 2.0, 0.5), (1, -1.0, 0.1), (2, 0.3, 2.0)], "k int, x double, w double").withColumn("x0", F.lit(0.25))
    out = segments.completeness(segments.integrated_gradients(s, "x", "x0", "w", 0.7, 8), "k", "x", "x0", "w", 0.7)
    assert all(abs(r["error"]) < 1e-9 and not r["flagged"] for r in out.collect())


def test_stratified_folds_keep_groups_and_deal_positives_evenly(spark):
    pdf = pd.DataFrame({"g": np.arange(4000) // 4, "label": ((np.arange(4000) // 4) % 10 == 0).astype(int), "fold_before": 1})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1, 1), (None, None, 1)], "g long, label long, fold_before long"))
    first, second = (splits.stratified_folds(df, "g", "label", 5, repeat=r).toPandas() for r in (0, 1))
    assert len(first) == 4002 and (first.groupby("g")["fold"].nunique() == 1).all()
    positive = first[first["label"] == 1].groupby("fold")["g"].nunique(dropna=False)
    assert positive.sum() == 101 and positive.max() - positive.min() <= 1
    both = first.drop_duplicates("g").merge(second.drop_duplicates("g"), on="g")
    assert (both["fold_x"] != both["fold_y"]).mean() > 0.5
    assert splits.stratified_folds(df.limit(0), "g", "label", 5).count() == 0


def test_fold_deltas_against_pairs(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"fold": rng.integers(0, 3, 300), "label": rng.integers(0, 2, 300), "base": rng.integers(0, 6, 300).astype(float), "full": rng.normal(size=300)})
    pdf.loc[pdf["fold"] == 2, "label"] = 0
    for r in inference.fold_deltas(spark.createDataFrame(pdf), "fold", "label", "base", "full").collect():
        own = pdf[pdf["fold"] == r["fold"]]
        pos, neg = own[own["label"] == 1], own[own["label"] == 0]
        if not len(pos):
            assert r["delta"] is None
            continue
        want = {c: np.mean([(a > b) + (a == b) / 2 for a in pos[c] for b in neg[c]]) for c in ("base", "full")}
        assert r["auc_base"] == pytest.approx(want["base"]) and r["delta"] == pytest.approx(want["full"] - want["base"])


def test_report_and_bound(spark):
    rows = [("a", 0.1, True, False), ("b", 0.3, None, None), ("c", 0.0, False, True)]
    out = one(inference.report(spark.createDataFrame(rows, "label string, delta double, improves boolean, equivalent boolean")))
    assert out == {"any_improves": True, "all_equivalent": False, "n_inconclusive": 1, "best": "b"}
    assert spark.range(1).select(inference.tightest_bound(F.lit(-0.03), F.lit(0.01))).collect()[0][0] == 0.03


def test_controls_that_equal_the_trained_profile_do_not_depart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, lead, s, float(v)) for i in range(60) for lead in range(2) for s, v in zip(("p", "qrs", "t", "other"), rng.dirichlet([3, 3, 3, 3]) / 2, strict=True)]
    own = spark.createDataFrame(rows, "id long, lead int, segment string, share double")
    moved = own.withColumn("share", F.col("share") + F.when(F.col("segment") == "p", 0.05).when(F.col("segment") == "t", -0.05).otherwise(0.0))
    out = {(r["method"], r["segment"]): r["departs"] for r in segments.against_controls(own, {"same": own, "moved": moved}, "id").collect()}
    assert {k for k, v in out.items() if v} == {("moved", "p"), ("moved", "t")} and len(out) == 8


def test_predictions_are_keyed(spark, tmp_path):
    from plumbline.sources.tables import read_predictions

    (tmp_path / "a.json").write_text('{"test": {"index": [3, 1, 2],\n "age_gap": [0.5, -1.0]}, "val": {"index": [9], "age_gap": [1.0]}}')
    (tmp_path / "b.json").write_text('{"val": {"index": [9], "age_gap": [1.0]}}')
    assert sorted(map(tuple, read_predictions(spark, str(tmp_path)).collect())) == [(1, -1.0), (3, 0.5)]
