"""Records written to files and read back: formats, missing samples, unreadable ones, limit, filters, resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import filters
from plumbline.sources import records
from plumbline.sources.tables import read_headers


def write(folder, name, x, kind="16", fs=500, gain=1000.0, baseline=0, offset=0, age="50", sex="Male", cut=0):
    """x: leads by samples in physical units, NaN for missing ones."""
    folder.mkdir(parents=True, exist_ok=True)
    n = np.where(np.isnan(x), records.MISSING.get(kind, 0), np.round(np.nan_to_num(x) * gain + baseline)).astype(np.int64).T.ravel()
    if kind == "212":
        n = np.r_[n, np.zeros(len(n) % 2, np.int64)].reshape(-1, 2) & 0xFFF
        raw = np.column_stack([n[:, 0] & 0xFF, (n[:, 0] >> 8) | (n[:, 1] >> 8) << 4, n[:, 1] & 0xFF]).astype(np.uint8).tobytes()
    elif kind == "24":
        raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in n)
    elif kind == "80":
        raw = (n + 128).astype(np.uint8).tobytes()
    else:
        raw = n.astype({"16": "<i2", "61": ">i2", "32": "<i4"}[kind]).tobytes()
    (folder / f"{name}.dat").write_bytes(b"\0" * offset + raw[: len(raw) - cut])
    lines = [f"{name} {len(x)} {fs} {x.shape[1]}"] + [f"{name}.dat {kind}{f'+{offset}' if offset else ''} {gain}({baseline})/mV 16 0 0 0 0 L{i}" for i in range(len(x))]
    (folder / f"{name}.hea").write_text("\n".join([*lines, f"#Age: {age}", f"#Sex: {sex}", "#Dx: 1,2"]) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, draw = tmp_path_factory.mktemp("records"), np.random.default_rng(1)
    x = np.round(draw.normal(size=(12, 1000)) * 0.3, 3)
    x[3, 10:20] = np.nan
    kinds = [("16", 0), ("16", 24), ("61", 0), ("32", 0), ("24", 0), ("212", 0), ("80", 0)]
    for i, (kind, offset) in enumerate(kinds):
        gain = {"212": 500.0, "80": 50.0}.get(kind, 1000.0)
        write(top / f"0{i % 3}" / "0", f"r{i}", x, kind, gain=gain, baseline=7 if kind == "16" else 0, offset=offset, age=str(30 + i))
    write(top / "00" / "0", "short", x, cut=50)
    write(top / "01" / "0", "two", x[:2])
    write(top / "02" / "0", "child", x, age="7")
    write(top / "02" / "0", "nameless", x, sex="Unknown")
    (top / "02" / "0" / "rubbish.hea").write_text("not a header\n#Age: 40\n#Sex: Female\n")
    (top / "01" / "0" / "absent.hea").write_text("absent 12 500 10\n" + "absent.dat 16 1000/mV 16 0 0 0 0 I\n" * 12 + "#Age: 44\n#Sex: F\n")
    return top, x


def test_formats_are_read_back(spark, folder):
    top, x = folder
    got = {r["record_id"]: r for r in records.with_signals(read_headers(spark, str(top))).collect()}
    assert len(got) == 13
    for i, step in enumerate((0.001, 0.001, 0.001, 0.001, 0.001, 0.002, 0.02)):
        r = got[f"r{i}"]
        assert r["problem"] is None and r["fs"] == 500 and np.abs(np.array(r["signal"]) - np.nan_to_num(x)).max() <= step / 2 + 1e-6
    assert all(got[name]["signal"] is None and got[name]["problem"] for name in ("short", "two", "rubbish", "absent"))
    assert "cut short" in got["short"]["problem"] and "2 leads" in got["two"]["problem"]
    kept = records.with_signals(read_headers(spark, str(top)).where("record_id = 'r0'"), fill=None).first()
    assert np.isnan(np.array(kept["signal"])[3, 10:20]).all() and np.isnan(np.array(kept["signal"])).sum() == 10
    with pytest.raises(Exception, match="cut short"):
        records.with_signals(read_headers(spark, str(top)).where("record_id = 'short'"), fail=True).collect()


def test_cohort_is_limited_before_samples_are_read(spark, folder):
    top, x = folder
    assert {r["record_id"] for r in records.cohort_records(spark, str(top)).collect()} == {f"r{i}" for i in range(7)}
    got = records.cohort_records(spark, str(top), limit=4, rate=100).collect()
    # The first four usable headers, of which one has too few samples.
    assert [r["record_id"] for r in sorted(got, key=lambda r: r["path"])] == ["r0", "r3", "r6"] and {r["fs"] for r in got} == {100.0}
    got = sorted(got, key=lambda r: r["path"])
    want = filters.resampled(np.nan_to_num(x[0]), 1, 5)
    assert np.allclose(np.array(got[0]["signal"])[0], want, atol=1e-3) and len(want) == 200
    with pytest.raises(ValueError, match="usable"):
        records.cohort_records(spark, str(top), low=95, high=99)


def test_resampling_is_the_whole_convolution_at_the_kept_samples():
    draw = np.random.default_rng(3)
    for n, up, down in ((1000, 1, 5), (333, 2, 1), (251, 3, 2), (100, 5, 7), (3, 4, 1), (1, 1, 3)):
        x, h = draw.normal(size=n), filters.kernel(up, down)
        spread = np.zeros(n * up)
        spread[::up] = x
        want = np.convolve(spread, h)[len(h) // 2 :][: len(spread)][::down]
        assert np.allclose(filters.resampled(x, up, down), want)


def test_data_source(spark, folder):
    top, x = folder
    records.register(spark)
    source = spark.read.format("wfdb").option("folders", 2)
    every = source.load(str(top))
    assert every.count() == 13 and every.where("problem is not null").count() == 3
    heads = source.option("samples", "false").load(str(top))
    assert heads.columns == ["record_id", "path", "fs", "n_leads", "problem"] and heads.where("n_leads = 2").count() == 1
    # Records that aren't named stay closed: with fail, the unreadable ones would end the job.
    strict = spark.read.format("wfdb").option("fail", "true")
    some = strict.option("ids", "r1,r4").load(str(top)).where("n_leads = 12").collect()
    assert sorted(r["record_id"] for r in some) == ["r1", "r4"] and np.abs(np.array(some[0]["signal"]) - np.nan_to_num(x)).max() < 0.001
    # A filter of one scan leaves the next alone.
    assert every.where("record_id = 'r1'").count() == 1 and every.count() == 13
    with pytest.raises(Exception, match="rubbish|absent|short"):
        strict.option("ids", "r1,short,absent,rubbish").load(str(top)).count()
    spark.sql(f"create or replace temporary view recorded using wfdb options (path '{top}', samples 'false')")
    assert spark.sql("select count(*) n from recorded where record_id = 'r2' and fs = 500").first()["n"] == 1
