"""Beats of a stream against the walk over whole records, however the stream is cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import signals
from plumbline.sources import synthetic
from plumbline.streaming import peaks

FS = 100


@pytest.fixture(scope="module")
def records(spark):
    draw = np.random.default_rng(6)
    rows = [(r["record_id"], list(r["signal"])) for r in synthetic.cohort(spark, 5, fs=FS, seconds=8, noise=0.03, wander=0.2).collect()]
    # Beats that grow faint and come back, noise, a flat line, records shorter than learning and than half a second.
    faint = [v * (0.25 if 300 < i < 420 else 1.0) for i, v in enumerate(rows[0][1])]
    rows += [("faint", faint), ("noise", draw.normal(size=700).tolist()), ("flat", [1.0] * 500), ("short", rows[1][1][:150]), ("tiny", rows[1][1][:40]), ("one", [0.5])]
    return rows


@pytest.fixture(scope="module")
def whole(spark, records):
    df = spark.createDataFrame(records, "k string, x array<double>")
    return {r["k"]: r["b"] for r in df.select("k", signals.beat_places(F.col("x"), FS).alias("b")).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_beats_of_the_whole_record(records, whole, seed):
    draw = random.Random(seed)
    for k, x in records:
        walk, got, at, most = peaks.Walk(), [], 0, 0
        while at < len(x):
            n = draw.choice([1, 3, 40, 200, len(x)])
            got += walk.feed(x[at : at + n], at + n >= len(x), FS)
            at += n
            most = max(most, len(walk.tail)) if walk.learned else most
        assert got == whole[k]
        assert most <= 2 * 20 + 2 * 6 + 4 or at <= 2 * FS + 200
    assert sum(map(len, whole.values())) > 40 and whole["flat"] == whole["tiny"] == whole["one"] == []


def test_a_replayed_table_gives_the_beats_of_the_batch_walk(spark, records, whole, tmp_path):
    rows = [(k, i, float(v), i == len(x) - 1) for k, x in records for i, v in enumerate(x)]
    cuts = {k: sorted(random.Random(k).sample(range(len(x) + 1), min(3, len(x)))) for k, x in records}
    schema = "k string, at long, v double, last boolean"
    for part in range(4):
        own = [r for r in rows if sum(c <= r[1] for c in cuts[r[0]]) == part]
        random.Random(part).shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = peaks.beat_stream(stream, "k", "at", "v", "last", FS).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    found = {}
    for r in spark.table("beats").collect():
        found.setdefault(r["k"], []).append(r["at"])
    assert {k: sorted(b) for k, b in found.items()} == {k: b for k, b in whole.items() if b}
