"""What operators share."""

import types

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common


def test_key_filter_keeps_every_key_and_few_others(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.lit("x").alias("text"))
    keys = rows.where("key is null or key % 10 = 3").select("key")
    kept = [r["key"] for r in common.likely_among(rows, F.col("key"), keys).select("key").collect()]
    wanted = {None, *range(3, 20_000, 10)}
    assert len(kept) == len(set(kept)) and wanted <= set(kept)
    assert len(kept) < len(wanted) + 20_000 // 12
    # Beyond the bound, more rows stay, and still every key's.
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 12)
    assert wanted <= {r["key"] for r in common.likely_among(rows, F.col("key"), keys).collect()}
    assert common.likely_among(rows, F.col("key"), keys.where("false")).isEmpty()


def test_batches_are_bounded_by_bytes_unless_the_job_sets_them(spark):
    name, size = common.BATCH_BYTES
    common.share_package(spark)
    assert spark.conf.get(name) == size


def test_a_cluster_needs_a_shared_folder(spark):
    conf = types.SimpleNamespace(get=lambda name, default: "")
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(cluster)
    assert common.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="local[2]"))) == common.own_folder()


def test_workers_get_the_package_and_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text("some words")
    common.share_package(spark)
    name = common.share_file(spark, str(tmp_path / "words.txt"))

    def read(batches):
        import plumbline.llm.common as there

        for batch in batches:
            yield batch.assign(text=open(there.shared_path(name)).read(), where=there.__file__)

    row = spark.range(1).mapInPandas(read, "id long, text string, where string").collect()[0]
    assert row["text"] == "some words" and "plumbline" in row["where"]
