"""Replicates as matrices against draws row by row: ties, hot scores, groups, nulls, any cut of the order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import replicates


def auc(score, label, times):
    p, q = times * (label == 1), times * (label == 0)
    gap = (score[:, None] > score[None, :]) + (score[:, None] == score[None, :]) / 2
    return (p[:, None] * q[None, :] * gap).sum() / (p.sum() * q.sum()) if p.sum() and q.sum() else None


@pytest.mark.parametrize("parts", ["1", "7"])
def test_auc_of_replicates(spark, monkeypatch, parts):
    monkeypatch.setattr(replicates, "ROWS", 17)
    draw = np.random.default_rng(5)
    n = 400
    score = np.where(draw.random(n) < 0.4, 0.5, np.round(draw.random(n), 2))
    rows = [(["a", "b", None][i % 3], f"c{i // 4}" if i % 50 else None, int(draw.random() < 0.3 + 0.4 * score[i]) if i % 40 else None, float(score[i]) if i % 30 else None) for i in range(n)]
    rows += [("one", "c1", 1, 0.2), ("one", "c2", 1, 0.3)]
    df = spark.createDataFrame(rows, "g string, cluster string, y int, s double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r["g"], r["replicate"]): r for r in replicates.replicate_auc(df, ["g"], "cluster", "y", "s", 12).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    numbers = {r["cluster"]: r["h"] for r in df.where("cluster is not null").select("cluster", F.xxhash64("cluster").alias("h")).distinct().collect()}
    for g in ("a", "b", None, "one"):
        own = [r for r in rows if r[0] == g and None not in r[1:]]
        w = replicates.weights(np.array([numbers[r[1]] for r in own]), 12)
        y, s = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        for b in range(12):
            want, r = auc(s, y, w[:, b].astype(float)), got[g, b]
            assert (r["n_positive"], r["n_negative"]) == ((w[:, b] * (y == 1)).sum(), (w[:, b] * (y == 0)).sum())
            assert r["auc"] is None if want is None else r["auc"] == pytest.approx(want)
    assert replicates.replicate_auc(df.where("false"), [], "cluster", "y", "s", 3).count() == 0


def test_sums_of_replicates(spark):
    rows = [(i % 7 if i % 11 else None, float(i) if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "cluster int, x double").repartition(3)
    got = {r["replicate"]: (r["n"], r["x"]) for r in replicates.replicate_sums(df, "cluster", {"n": F.lit(1), "x": F.col("x")}, 20).collect()}
    own = [r for r in rows if r[0] is not None]
    w = replicates.weights(np.array([r[0] for r in own]), 20)
    assert got == {b: (w[:, b].sum(), pytest.approx(sum(k * (r[1] or 0) for k, r in zip(w[:, b].tolist(), own, strict=True)))) for b in range(20)}
