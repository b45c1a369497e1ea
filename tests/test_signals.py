"""Detection and learners against constructed truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import filters, signals
from plumbline.operators import delineation, learners, splits, waves
from plumbline.sources import synthetic, tables


@pytest.fixture(scope="module")
def recordings(spark):
    return synthetic.cohort(spark, 24, fs=125, seconds=8).withColumn("found", signals.r_peaks(F.col("signal"), 125)).cache()


def test_peaks_are_found_where_they_are(recordings):
    ref = recordings.select("record_id", F.explode("true_peaks").alias("at")).withColumn("t", F.col("at") / 125.0)
    det = recordings.select("record_id", F.explode("found").alias("at")).withColumn("t", F.col("at") / 125.0)
    out = waves.scored(ref, det, "record_id", "t", 0.05).toPandas()
    assert out["n_matched"].sum() / out["n_reference"].sum() > 0.98
    assert out["n_matched"].sum() / out["n_detected"].sum() > 0.98


def test_interval_features_follow_the_rate(recordings):
    out = signals.interval_features(recordings, "record_id", "found", "fs").join(recordings.select("record_id", "rate"), "record_id").toPandas()
    assert np.corrcoef(out["heart_rate"], out["rate"])[0, 1] > 0.99 and (out["heart_rate"] - out["rate"]).abs().mean() < 2


def test_unsound_signals_have_no_peaks(spark):
    rows = [(0, None), (1, []), (2, [0.0] * 500), (3, [float("nan")] * 500), (4, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "record_id int, signal array<double>").withColumn("found", signals.r_peaks(F.col("signal"), 125)).withColumn("fs", F.lit(125))
    assert all(r["found"] == [] for r in df.collect())
    assert {(r["n_beats"], r["heart_rate"]) for r in signals.interval_features(df, "record_id", "found", "fs").collect()} == {(0, None)}


def test_cohort_has_the_prefix_property(spark):
    a = {r["record_id"]: r["signal"] for r in synthetic.cohort(spark, 3, fs=50, seconds=4).collect()}
    b = {r["record_id"]: r["signal"] for r in synthetic.cohort(spark, 12, fs=50, seconds=4).collect()}
    assert all(b[k] == v for k, v in a.items())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 800
    x, z = rng.normal(size=n), rng.normal(size=n)
    logit = -0.4 + x + 2.5 * z / 4 * 4
    pdf = pd.DataFrame({"record_id": range(n), "patient": np.arange(n) // 2, "x": x, "residual": z, "noise": rng.normal(size=n), "curve": x**2 + 0.1 * rng.normal(size=n), "label": (rng.uniform(size=n) < 1 / (1 + np.exp(-logit))).astype(int)})
    return splits.folds(spark.createDataFrame(pdf), "patient", 3).cache()


def test_boosted_trees_see_a_curve_that_a_line_does_not(table):
    r2 = {}
    for kind in ("linear", "boosted"):
        p = learners.out_of_fold(table, ["x"], "curve", "fold", kind).toPandas()
        r2[kind] = 1 - ((p["curve"] - p["predicted"]) ** 2).mean() / p["curve"].var(ddof=0)
    assert r2["boosted"] > 0.8 > 0.2 > r2["linear"]


def test_repeats_are_averaged(table):
    df = splits.stratified_folds(splits.stratified_folds(table, "patient", "label", 2, 0, "f0"), "patient", "label", 2, 1, "f1")
    one = {c: {r["record_id"]: r["p"] for r in learners.out_of_fold(df, ["x", "residual"], "label", c, "logistic", "p").collect()} for c in ("f0", "f1")}
    both = learners.repeated_out_of_fold(df, "record_id", ["x", "residual"], "label", ["f0", "f1"], "logistic").collect()
    assert len(both) == 800
    assert all(abs(r["predicted"] - (one["f0"][r["record_id"]] + one["f1"][r["record_id"]]) / 2) < 1e-9 for r in both)


def test_headers_and_metadata(spark, tmp_path):
    (tmp_path / "WFDB").mkdir()
    (tmp_path / "WFDB" / "r1.hea").write_text("r1 12 500 5000\n#Age: 61\n#Sex: Male\n")
    (tmp_path / "WFDB" / "r2.hea").write_text("r2 12 500 5000\n#Age: NaN\n#Sex: Unknown\n")
    rows = {r["record_id"]: (r["age"], r["sex"]) for r in tables.read_headers(spark, str(tmp_path)).collect()}
    assert rows == {"r1": (61.0, 0), "r2": (None, None)}
    (tmp_path / "m.csv").write_text("ecg_id,patient_id,age,sex,scp_codes,strat_fold,filename_lr,filename_hr\n1,7,300,1,\"{'NORM': 100.0}\",10,a,b\n")
    assert tables.read_metadata(spark, str(tmp_path / "m.csv")).collect()[0]["scp_codes"] == "{'NORM': 100.0}"
    (tmp_path / "s.csv").write_text("code,diagnostic,diagnostic_class\nNORM,1.0,NORM\nSR,,\n")
    assert [tuple(r) for r in tables.read_statements(spark, str(tmp_path / "s.csv")).collect()] == [("NORM", "NORM")]


def test_bandpass_keeps_the_band_and_moves_nothing(spark):
    t = np.arange(3000) / 250
    slow, own, fast = 2 * np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 100 * t)
    df = spark.createDataFrame([([(slow + own + fast).tolist()],), (None,)], "x array<array<double>>")
    out = df.select(filters.bandpass(F.col("x"), 250, 0.5, 40.0).alias("y")).collect()
    assert out[1]["y"] is None and np.abs(np.array(out[0]["y"][0])[750:-750] - own[750:-750]).max() < 0.05
    with pytest.raises(ValueError, match="band"):
        filters.bandpass(F.col("x"), 60, 0.5, 40.0)


def test_resampling_keeps_the_curve(spark):
    x = np.sin(2 * np.pi * 5 * np.arange(1000) / 500)
    df = spark.createDataFrame([([x.tolist()],)], "x array<array<double>>")
    for up, down in ((1, 5), (2, 1), (3, 2)):
        y = np.array(df.select(filters.resample(F.col("x"), up, down).alias("y")).collect()[0]["y"][0])
        want = np.sin(2 * np.pi * 5 * np.arange(len(y)) / (500 * up / down))
        assert len(y) == -(-1000 * up // down) and np.abs(y - want)[20:-20].max() < 0.02


@pytest.fixture(scope="module")
def beats(spark):
    r = synthetic.cohort(spark, 8, fs=250, seconds=6, noise=0.004, wander=0.02).withColumn("leads", F.array("signal", F.transform("signal", lambda v: -0.5 * v))).cache()
    return r, delineation.delineated(r, "record_id", "leads", "true_peaks", 250).cache()


def test_waves_are_found_where_they_are(beats):
    _, b = beats
    b = b.toPandas()
    for wave, centre, half in (("p", -0.16, 0.045), ("t", 0.26, 0.08)):
        own = b.dropna(subset=[f"{wave}_peak"])
        assert len(own) > 0.8 * len(b)
        assert ((own[f"{wave}_peak"] - own.r_peak) / 250 - centre).abs().median() < 0.01
        assert ((own[f"{wave}_onset"] - own.r_peak) / 250 - (centre - half)).abs().median() < 0.03
        assert ((own[f"{wave}_offset"] - own.r_peak) / 250 - (centre + half)).abs().median() < 0.03
    assert (b.qrs_onset < b.r_peak).all() and (b.qrs_offset > b.r_peak).all() and (b.qrs_offset - b.qrs_onset).median() / 250 < 0.14


def test_interval_and_amplitude_tables(beats):
    r, b = beats
    t = delineation.interval_table(r, b, "record_id", 250).join(r.select("record_id", "rate"), "record_id").toPandas()
    assert len(t) == 8 and (t.heart_rate_bpm - t.rate).abs().mean() < 2 and t.qtc_bazett_ms.notna().all() and (t.n_beats >= 3).all()
    a = delineation.amplitude_table(r, b, "record_id", "leads", ["II", "V1"], 250).toPandas()
    assert ((a.r_amplitude_mv - 1.1).abs() < 0.2).all() and ((a.t_amplitude_mv - 0.3).abs() < 0.1).all() and ((a.p_amplitude_mv - 0.12).abs() < 0.06).all()
    assert a.qrs_axis_deg.isna().all() and a.sokolow_lyon_mv.isna().all() and a.st_deviation_mv.notna().all()
    few = delineation.interval_table(r, b.where("beat < 2"), "record_id", 250).toPandas()
    assert len(few) == 8 and few.heart_rate_bpm.isna().all() and (few.n_beats == 0).all()


def test_prediction_files_are_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"test": {"index": [4, 2, 9],\n "age_gap": [2.0, -1.5]}, "validation": {"index": [1], "age_gap": [0.5]}}')
    assert [(r["index"], r["age_gap"]) for r in tables.read_predictions(spark, str(tmp_path / "p.json")).collect()] == [(4, 2.0), (2, -1.5)]
    assert tables.read_predictions(spark, str(tmp_path / "p.json"), "validation").count() == 1
    (tmp_path / "p.json").write_text('{"other": {"index": [4], "age_gap": [2.0]}}')
    assert tables.read_predictions(spark, str(tmp_path / "p.json")).count() == 0


def test_usable_headers(spark):
    heads = spark.createDataFrame([("a", 30.0, 1), ("b", 7.0, 0), ("c", 40.0, None)], "record_id string, age double, sex int")
    assert [r["record_id"] for r in tables.usable_headers(heads).collect()] == ["a"]
    with pytest.raises(ValueError, match="usable"):
        tables.usable_headers(heads.where("record_id = 'b'"))


@pytest.mark.parametrize("bins", [256, 2])
def test_scores_follow_the_greedy_rule_over_any_bins(spark, monkeypatch, bins):
    import random

    monkeypatch.setattr(waves, "BIN", bins)
    draw = random.Random(bins)
    marks = {k: [[draw.choice([1, 1, 0.5]) * draw.randint(0, 300) / 4 for _ in range(draw.randint(0, 90))] for _ in range(2)] for k in ["a", "b", None, "one"]}
    marks["one"] = [[5.0], []]
    rows = [(k, t, kind) for k, both in marks.items() for kind, own in enumerate(both) for t in own] + [("a", None, 0), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, t double, kind int").repartition(3)
    got = {r["k"]: r for r in waves.scored(df.where("kind = 0"), df.where("kind = 1"), "k", "t", 1.0).collect()}
    for k, (references, detections) in marks.items():
        free, errors = sorted(detections), []
        for r in sorted(references):
            near = min(((abs(d - r), d) for d in free if abs(d - r) <= 1.0), default=None)
            if near:
                free.remove(near[1])
                errors.append(near[0])
        r = got[k]
        assert (r["n_reference"], r["n_detected"], r["n_matched"]) == (len(references), len(detections), len(errors))
        assert r["max_error"] == max(errors, default=None) and (r["mean_error"] is None if not errors else r["mean_error"] == pytest.approx(sum(errors) / len(errors)))


def test_amplitudes_are_measured_inside_the_recordings_row(spark):
    # Beats out of order, a lead of one's own name twice, a lead beyond the names, a null lead, angles that pass 180 degrees.
    x = [0.0] * 6 + [1.0, -2.0, 0.5] + [0.0] * 12
    leads = [x, [-v for v in x], None, [0.5 * v for v in x], [3.0 * v for v in x]]
    r = spark.createDataFrame([(1, leads), (2, []), (3, leads), (None, leads)], "k int, leads array<array<double>>")
    beats = [(1, 1, 7, 6, 8, None, None, None, None), (1, 0, 6, 6, 7, 2, 9, 10, 11), (2, 0, 7, 6, 8, None, None, None, None), (None, 0, 7, 6, 8, None, None, None, None)]
    b = spark.createDataFrame(beats, "k int, beat int, r_peak int, qrs_onset int, qrs_offset int, p_peak int, t_onset int, t_peak int, t_offset int")
    df = delineation.amplitude_table(r, b, "k", "leads", ["II", "V1", "V5", "aVF"], 100)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # One meeting of recordings and beats: no row for each lead or beat, and nothing sorted by recording once more.
    assert plan.count("Join") == 1 and "Generate" not in plan and "Window" not in plan
    rows = df.collect()
    assert [x["k"] for x in rows] == [1]
    a = rows[0].asDict()
    assert a["r_amplitude_mv"] == 1.5 and a["p_amplitude_mv"] == 0 and a["t_amplitude_mv"] == 0 and a["sokolow_lyon_mv"] == 1.0
    assert a["r_progression_lead"] == 1.0 and a["qrs_axis_deg"] is None and a["t_axis_deg"] is None
    turned = spark.createDataFrame([([170.0, -170.0, 175.0, -100.0],), ([],)], "v array<double>").select(delineation.led_on(F.col("v")).alias("v")).collect()
    assert [x["v"] for x in turned] == [[170.0, 190.0, 175.0, 260.0], []]
