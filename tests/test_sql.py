"""One SQL query over events that uses what is registered, against the DataFrame form."""

import pytest
from pyspark.sql import functions as F

from plumbline import sql
from plumbline.functions import signals
from plumbline.operators import waves
from tests.test_records import write

FOLDER = "/root/testdata/sf0.01"


def test_sql_equals_the_dataframe_form(spark):
    sql.register_all(spark)
    spark.read.parquet(f"{FOLDER}/events.parquet").createOrReplaceTempView("own_events")
    got = spark.sql("""
        with r as (select user_id, transform(array_sort(collect_list(struct(ts, event_id, value))), e -> e.value / 100) as x from own_events group by user_id),
        b as (select user_id, count(*) as n, max(at) as latest from r, lateral beat_places(x, 100) group by user_id),
        m as (select user_id, circular_median(value * 3.6 - 180, unix_micros(cast(ts as timestamp)) * 1000 + event_id % 1000) as middle from own_events group by user_id)
        select r.user_id, coalesce(n, 0) as n, latest, middle from r left join b using (user_id) join m using (user_id)""").collect()
    e = spark.table("own_events")
    r = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    r = r.select("user_id", signals.beat_places(F.transform("e", lambda x: x["value"] / 100), 100).alias("b"))
    beats = {x["user_id"]: x["b"] for x in r.collect()}
    middle = {x["user_id"]: x["median"] for x in waves.circular_median(e.withColumn("a", F.col("value") * 3.6 - 180), "user_id", "a", ["ts", "event_id"]).collect()}
    assert {x["user_id"]: (x["n"], x["latest"]) for x in got} == {k: (len(b), max(b, default=None)) for k, b in beats.items()}
    assert {x["user_id"]: x["middle"] for x in got} == {k: pytest.approx(v) for k, v in middle.items()} and sum(map(len, beats.values())) > 50


def test_nulls_in_sql(spark):
    sql.register_all(spark)
    assert spark.sql("select * from beat_places(null, 100)").count() == 0
    assert spark.sql("select * from beat_places(array(1.0d, null), 100)").count() == 0
    rows = spark.sql("select g, circular_median(d, o) as m from values ('a', 170.0d, 1), ('a', -170.0d, 2), ('a', null, 3), ('b', null, 1) t(g, d, o) group by g").collect()
    assert {r["g"]: r["m"] for r in rows} == {"a": 180.0, "b": None}


def test_records_in_sql(spark, tmp_path):
    import numpy as np

    sql.register_all(spark)
    x = np.round(np.random.default_rng(2).normal(size=(12, 300)) * 0.3, 3)
    for name in ("a", "b"):
        write(tmp_path / "r", name, x)
    spark.sql(f"create or replace temporary view own_records using wfdb options (path '{tmp_path}')")
    got = spark.sql("select record_id, round(aggregate(signal[0], 0d, (s, v) -> s + v), 3) as total from own_records where n_leads = 12").collect()
    assert {r["record_id"]: r["total"] for r in got} == {n: pytest.approx(round(float(x[0].sum()), 3), abs=0.01) for n in ("a", "b")}
