"""The whole way from samples to the table of intervals, against the same rules over plain arrays, beat by beat."""

import math
from statistics import median, stdev

import numpy as np
import pytest

from plumbline.functions.filters import banded
from plumbline.operators import delineation
from plumbline.plans import queries as plans
from plumbline.sources import synthetic


def samples(ms, fs):
    return round(ms / 1000.0 * fs)


def mean_around(x, half):
    return [float(np.mean(x[max(i - half, 0) : i + half + 1])) for i in range(len(x))]


def walk(envelope, found, fs):
    head = envelope[: 2 * fs]
    s, n = max(max(head) * 0.25, np.mean(head) * 0.5 + 1e-12), float(np.mean(head)) * 0.5
    rr, missed, beats = 0.0, None, []
    for at in found:
        height, limit = envelope[at], n + 0.25 * (s - n)
        last = beats[-1] if beats else None
        late = missed is not None and last is not None and rr > 0 and at - last > 1.66 * rr and envelope[missed] > limit / 2 and missed - last > 0.2 * fs
        if late:
            beats.append(missed)
        before = missed if late else last
        taken = height > limit and (before is None or at - before > 0.2 * fs)
        if taken and last is not None and not late:
            rr = 0.875 * rr + 0.125 * (at - last) if rr > 0 else float(at - last)
        if taken:
            s = 0.125 * height + 0.875 * s
            beats.append(at)
        else:
            n = 0.125 * height + 0.875 * n
        # What was missed is forgotten with every beat; of what follows, the highest is kept.
        if taken or late:
            missed = None
        elif missed is None or height > envelope[missed]:
            missed = at
    return beats


def peaks_of(x, fs):
    x = [float(v) for v in x]
    if len(x) < fs // 2 or max(x) <= min(x):
        return []
    slope = [0.0] + [((x[i + 1] - x[i - 1]) * (fs / 2.0)) ** 2 for i in range(1, len(x) - 1)] + [0.0]
    envelope, apart, half = mean_around(slope, round(0.06 * fs)), round(0.2 * fs), max(round(0.1 * fs), 1)
    high = lambda part: max(part, default=-1.0)
    found = [i for i, v in enumerate(envelope) if v > 0 and v > high(envelope[max(i - apart, 0) : i]) and v >= high(envelope[i + 1 : i + 1 + apart])]
    beats, level = walk(envelope, found, fs), sorted(x)[len(x) // 2]
    near = lambda b: range(max(b - half, 0), min(max(b - half, 0) + 2 * half + 1, len(x)))
    flat = [v - level for v in x]
    up, down = (max((max(sign * flat[i] for i in near(b)) for b in beats), default=0.0) for sign in (1, -1))
    sign = 1 if up >= down else -1
    return sorted({max(near(b), key=lambda i: (sign * flat[i], -i)) for b in beats})


def quiet(values, level, run):
    return next((i for i in range(len(values) - run + 1) if max(values[i : i + run]) < level), None)


def gradient(x):
    n = len(x)
    return [(x[min(i + 1, n - 1)] - x[max(i - 1, 0)]) / (2.0 if 0 < i < n - 1 else 1.0) for i in range(n)] if n > 1 else [0.0] * n


def bounds(wave, peak, base, low, high, share, run):
    level = abs(wave[peak] - base) * share + 1e-12
    back = quiet([abs(v - base) for v in wave[low:peak]][::-1], level, run)
    on = quiet([abs(v - base) for v in wave[peak + 1 : high + 1]], level, run)
    return (low if back is None else peak - 1 - back), (high if on is None else peak + 1 + on)


def tangent(wave, peak, limit, base, otherwise, forward):
    low, high = (peak, limit) if forward else (limit, peak)
    sign = (1 if wave[peak] > base else -1 if wave[peak] < base else 0) * (-1 if forward else 1)
    slopes = gradient(wave[low : high + 1])
    if high - low < (3 if forward else 2) or not slopes:
        return otherwise
    at = max(range(len(slopes)), key=lambda i: (slopes[i] * sign, -i))
    a, b = (low + at + 1, limit) if forward else (limit, low + at - 1)
    if slopes[at] * sign <= 0 or a > b:
        return otherwise
    return min(max(round(low + at + (base - wave[low + at]) / slopes[at]), a), b)


def beats_of(leads, peaks, fs, lead=0):
    search, run, before, half = samples(120.0, fs), max(samples(12.0, fs), 1), max(samples(40.0, fs), 1), max(samples(160.0, fs) // 2, 1)
    p_near, p_far, t_near, t_far = (samples(ms, fs) for ms in (40.0, 320.0, 40.0, 500.0))
    band = [banded(np.asarray(x, float), fs, 0.5, 40.0, 2) for x in leads]
    wave = [float(v) for v in band[lead]]
    magnitude = [math.sqrt(sum(b[i] ** 2 for b in band)) / math.sqrt(len(band)) for i in range(len(wave))] if len(band) > 1 else wave
    envelope, n, out, t_end = mean_around([abs(v) * fs for v in gradient(magnitude)], max(samples(16.0, fs), 1) // 2), len(wave), [], 0
    for i, r in enumerate(peaks):
        rr = r - peaks[i - 1] if i else peaks[1] - r if len(peaks) > 1 else fs
        low, high = max(r - search, 0), min(r + search, n - 1)
        level = max(envelope[low : high + 1]) * 0.10
        if high - low < 3 or level <= 0:
            continue
        back, on = quiet(envelope[low : r + 1][::-1], level, run), quiet(envelope[r : high + 1], level, run)
        q_on, q_off = (low if back is None else r - back), (high if on is None else r + on)
        if q_off <= q_on:
            continue
        last = max(q_on - 1, 0)
        base = median(wave[max(last - before, 0) : last + 1])
        end = min(v for v in (q_off + max(math.floor(rr * 0.65), t_near + 1), q_off + t_far, n - 1, peaks[i + 1] - search // 2 if i + 1 < len(peaks) else None) if v is not None)
        t = p = None
        if end - (q_off + t_near) >= 3:
            at = max(range(q_off + t_near, end + 1), key=lambda j: (abs(wave[j] - base), -j))
            if abs(wave[at] - base) >= 0.04:
                a, b = bounds(wave, at, base, q_off, end, 0.15, 1)
                a, b = tangent(wave, at, q_off, base, a, False), tangent(wave, at, end, base, b, True)
                t = (a, at, b) if b > a else None
        p_low, p_high = max(q_on - p_far, t_end, 0), q_on - p_near
        if p_high - p_low >= 3:
            at = max(range(p_low, p_high + 1), key=lambda j: (abs(wave[j] - base), -j))
            if abs(wave[at] - base) >= 0.02:
                a, b = bounds(wave, at, base, max(p_low, at - half), min(p_high, at + half), 0.20, run)
                p = (a, at, b) if b > a else None
        t_end = t[2] if t else 0
        out.append((r, q_on, q_off, p, t))
    return out


def table_of(beats, fs):
    if len(beats) < 3:
        return {"n_beats": 0}
    ms, none = 1000.0 / fs, {"n_beats": len(beats)}
    of = lambda values: median(values) if values else None
    rr = [(b[0] - a[0]) * ms for a, b in zip(beats[:-1], beats[1:], strict=True)]
    qt = of([(t[2] - q) * ms for _, q, _, _, t in beats if t and t[2] > q])
    seconds = median(rr) / 1000.0
    return none | {
        "rr_interval_ms": median(rr), "rr_sd_ms": stdev(rr), "p_duration_ms": of([(p[2] - p[0]) * ms for _, _, _, p, _ in beats if p]), "pr_interval_ms": of([(q - p[0]) * ms for _, q, _, p, _ in beats if p and q > p[0]]),
        "qrs_duration_ms": median([(o - q) * ms for _, q, o, _, _ in beats]), "qt_interval_ms": qt, "p_detection_rate": sum(b[3] is not None for b in beats) / len(beats), "t_detection_rate": sum(b[4] is not None for b in beats) / len(beats),
        "heart_rate_bpm": 60.0 / seconds, "qtc_bazett_ms": qt and qt / math.sqrt(seconds), "qtc_fridericia_ms": qt and qt / seconds ** (1 / 3),
    }


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_recording_of_the_query(spark, folder):
    users = {}
    for e in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda e: (e["ts"], e["event_id"])):
        users.setdefault(e["user_id"], []).append(e["value"] / 100.0)
    got = {r["user_id"]: r for r in plans.QUERIES["signal_pipeline"](spark, folder).collect()}
    assert set(got) == set(users) and sum(r["n_beats"] >= 3 for r in got.values()) >= (10 if folder.endswith("sf0.01") else 0)
    for user, x in users.items():
        own, peaks = got[user], peaks_of(x, plans.EVENT_RATE)
        for name, value in table_of(beats_of([x], peaks, plans.EVENT_RATE) if peaks else [], plans.EVENT_RATE).items():
            assert own[name] is None if value is None else own[name] == pytest.approx(value, abs=2e-6), (user, name)


@pytest.mark.parametrize("FS", [100, 250, 500])
def test_beats_of_made_recordings(spark, FS):  # noqa: N803
    r = synthetic.cohort(spark, 6, fs=FS, seconds=6, noise=0.02, wander=0.05)
    rows = [(x["record_id"], [list(x["signal"]), [-0.5 * v for v in x["signal"]]]) for x in r.collect()]
    rows = [(k, leads, peaks_of(leads[0], FS)) for k, leads in rows]
    df = spark.createDataFrame(rows, "k string, leads array<array<double>>, peaks array<int>")
    from plumbline.functions import signals

    assert {x["k"]: x["p"] for x in df.select("k", signals.r_peaks(df["leads"][0], FS).alias("p")).collect()} == {k: p for k, _, p in rows}
    got = {}
    for b in delineation.delineated(df, "k", "leads", "peaks", FS).collect():
        wave = lambda w, b=b: None if b[f"{w}_peak"] is None else (b[f"{w}_onset"], b[f"{w}_peak"], b[f"{w}_offset"])
        got.setdefault(b["k"], []).append((b["r_peak"], b["qrs_onset"], b["qrs_offset"], wave("p"), wave("t")))
    for k, leads, peaks in rows:
        assert sorted(got[k]) == beats_of(leads, peaks, FS) and len(peaks) >= 4
    table = {x["k"]: x for x in delineation.interval_table(df, delineation.delineated(df, "k", "leads", "peaks", FS), "k", FS).collect()}
    for k, leads, peaks in rows:
        for name, value in table_of(beats_of(leads, peaks, FS), FS).items():
            assert table[k][name] is None if value is None else table[k][name] == pytest.approx(value), (k, name)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_peaks_and_slopes_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import signals

    spark.conf.set("spark.sql.maxPlanStringLength", 10**8)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10**6)
    try:
        # A smoothed expression isn't repeated for every sample.
        marked = F.transform(F.array(*[F.col("id").cast("double")] * 9), lambda v: v * 1234.5)
        df = spark.range(2).select(signals.moving_mean(marked, 1).alias("x"))
        assert plan_of(df).count("1234.5") == 1
        assert df.collect()[1]["x"] == pytest.approx([1234.5] * 9)
        # The query's plan has one walk; a filter on its result would bring in another.
        walk = plan_of(spark.createDataFrame([([0.0],)], "x array<double>").select(signals.r_peaks(F.col("x"), plans.EVENT_RATE).alias("p"))).count("1.66")
        assert walk > 0 and plan_of(plans.QUERIES["signal_pipeline"](spark, "/root/testdata/sf0.001")).count("1.66") == walk
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_recordings_without_peaks_or_leads_have_no_beats(spark):
    rows = [(1, [[0.0, 1.0, 0.0] * 40], []), (2, None, None), (3, [None], []), (4, [[]], [])]
    df = spark.createDataFrame(rows, "k long, leads array<array<double>>, peaks array<int>")
    assert delineation.delineated(df, "k", "leads", "peaks", 100).collect() == []
