import math
import random
from statistics import median, stdev

import pytest
from pyspark.sql import functions as F

from plumbline.operators import atrial
from plumbline.plans import queries as plans


def bump(n, at, width, height):
    return [height * math.exp(-0.5 * ((i - at) / width) ** 2) for i in range(n)]


def test_terminal_force_is_length_times_depth_of_the_last_run(spark):
    rows = [(0, [0.1, 0.05, -0.05, -0.02, -0.05, -0.01]), (1, [-0.1, 0.2]), (2, [-0.1, -0.2]), (3, [])]
    out = spark.createDataFrame(rows, "id int, t array<double>").select("id", atrial.terminal_force(F.col("t"), 2.0).alias("f"))
    got = {r.id: r.f for r in out.collect()}
    assert [round(got[i], 9) for i in range(3)] == [-0.4, 0.0, -0.8] and got[3] is None


def notch(trace, width):
    """The notch by its rule, over plain lists."""
    if len(trace) < 5:
        return None
    height = max(map(abs, trace))
    if height == 0:
        return 0.0
    sign = 1 if trace[[abs(v) for v in trace].index(height)] >= 0 else -1
    t = [0.0] * width + [sign * v for v in trace] + [0.0] * width
    s = [sum(t[i + width - width // 2 : i + width + (width - 1) // 2 + 1]) / width for i in range(len(trace))]
    tops = sorted((i for i in range(1, len(s) - 1) if s[i] > s[i - 1] and s[i] >= s[i + 1]), key=lambda i: -s[i])[:2]
    if len(tops) < 2 or abs(tops[0] - tops[1]) < 2:
        return 0.0
    depth = min(s[i] for i in tops) - min(s[min(tops) : max(tops) + 1])
    return depth if depth >= 0.08 * height else 0.0


def test_notch_follows_its_rule(spark):
    draw = random.Random(3)
    two = lambda gap: [a + b for a, b in zip(bump(40, 20 - gap, 4, 0.1), bump(40, 20 + gap, 4, 0.1), strict=True)]
    rows = [bump(40, 20, 6, 0.1), two(6), two(8), [0.1, 0.0, 0.1], [-v for v in two(8)], [0.0] * 9, [0.1, 0.0, 0.1, 0.0, 0.1]]
    rows += [[draw.gauss(0, 0.1) for _ in range(draw.randint(5, 30))] for _ in range(60)]
    for width in (1, 3, 4):
        out = spark.createDataFrame(list(enumerate(rows)), "id int, t array<double>").select("id", atrial.notch_depth(F.col("t"), width).alias("d"))
        got = {r.id: r.d for r in out.collect()}
        for i, t in enumerate(rows):
            want = notch(t, width)
            assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
        assert got[0] == 0 and got[3] is None and 0 < got[1] < got[2] < 0.1 and abs(got[4] - got[2]) < 1e-12 and got[5] == 0


def durations(leads, beat, fs):
    """P duration by lead for one beat (p_onset, p_offset, qrs_onset), by its rule."""
    half, quiet, before, out = max(round(0.16 * fs) // 2, 1), max(round(0.012 * fs), 1), max(round(0.04 * fs), 1), []
    for x in leads:
        high = max(beat[2] - 1, 0)
        low = max(high - before, 0)
        base = median(x[low : high + 1]) if high > low else 0.0
        a, b = max(beat[0] - half, 0), min(beat[1] + half, len(x) - 1)
        off = [abs(v - base) for v in x]
        peak = max(range(a, b + 1), key=lambda i: (off[i], -i)) if b - a >= 3 else None
        if peak is None or off[peak] < 0.02:
            out.append(None)
            continue
        a, b, edges = max(a, peak - half), min(b, peak + half), []
        for step, limit in ((-1, a), (1, b)):
            found = limit
            for i in range(peak + step, limit + step, step):
                run = range(i, i + step * quiet, step)
                if all(a <= j <= b and off[j] <= 0.2 * off[peak] for j in run):
                    found = i
                    break
            edges.append(found)
        out.append((edges[1] - edges[0]) * 1000.0 / fs if edges[1] > edges[0] else None)
    return out


def spread_of(leads, beats, fs):
    each = []
    for b in beats:
        d = [v for v in durations(leads, b, fs) if v is not None]
        if len(d) >= max(3, len(leads) // 2):
            each.append(max(d) - min(d))
    return median(each) if each else None


@pytest.mark.parametrize("fs", [100, 500])
def test_durations_follow_their_rule_on_both_sides_of_each_bound(spark, fs):
    draw = random.Random(fs)
    rows, beats, want = [], [], {}
    for k in range(30):
        n = draw.randint(60, 120) * fs // 100
        at = draw.randint(0, n // 2)
        beat = (at, at + draw.randint(2, 12) * fs // 100, at + draw.randint(5, 25) * fs // 100)
        leads = [[v + draw.gauss(0, noise) for noise in [draw.choice([0.002, 0.02])] for v in bump(n, at + draw.randint(-4, 8), draw.uniform(1, 8) * fs / 100, draw.choice([0.0, 0.05, -0.1, 0.2]))] for _ in range(4)]
        rows.append((k, leads))
        beats.append((k, 0, beat[0], beat[0] + 1, beat[1], beat[2]))
        want[k] = durations(leads, beat, fs)
    r = spark.createDataFrame(rows, "k int, leads array<array<double>>")
    b = spark.createDataFrame(beats, "k int, beat int, p_onset int, p_peak int, p_offset int, qrs_onset int")
    got = {(w["k"], w["at"]): w["duration_ms"] for w in atrial.p_waves(r, b, "k", "leads", ["II"], fs).collect()}
    assert got == {(k, i): None if v is None else pytest.approx(v) for k, d in want.items() for i, v in enumerate(d)}
    assert len({v is None for d in want.values() for v in d}) == 2


def test_dispersion_is_judged_against_recordings_without_any(spark):
    draw, fs, rows = random.Random(7), 500, {}
    for k in range(40):
        widths = [12, 12 + k % 9, 12, 12 - k % 5]
        rows[k] = [[v + draw.gauss(0, 0.002) for v in bump(300, 100, w, h)] for w, h in zip(widths, (0.2, 0.15, -0.2, 0.25), strict=True)]
    r = spark.createDataFrame(list(rows.items()), "k int, leads array<array<double>>")
    b = spark.createDataFrame([(k, 0, 75, 100, 125, 180) for k in rows], "k int, beat int, p_onset int, p_peak int, p_offset int, qrs_onset int")
    got = atrial.dispersion_reliability(r, b, "k", "leads", ["II", "V1", "I", "aVF"], fs).first()
    real = [spread_of(v, [(75, 125, 180)], fs) for v in rows.values()]
    null = atrial.without_dispersion(r, "leads", fs).collect()
    floor = median([spread_of(x["leads"], [(75, 125, 180)], fs) for x in null])
    assert got["n_real"] == got["n_null"] == 40 and got["observed_sd_ms"] == pytest.approx(stdev(real)) and got["noise_floor_ms"] == pytest.approx(floor)
    assert got["usable"] == (got["observed_sd_ms"] > 2 * got["noise_floor_ms"]) and floor < median(real)
    # Every lead has the reference's timing and its own size.
    x = null[8]["leads"]
    assert all(abs(max(range(300), key=lambda i: abs(lead[i])) - 100) <= 6 for lead in x) and max(x[1]) < max(x[3]) and min(x[2]) < -0.15
    same = atrial.dispersion_reliability(r.where("k = 0"), b, "k", "leads", ["II"], fs).first()
    assert same["observed_sd_ms"] is None and not same["usable"]


def test_queries_over_vectors_follow_the_rules(spark):
    folder = "/root/testdata/sf0.001"
    r, b = plans._recordings(spark, folder)
    beats = [(1, 3, 3), (9, 11, 12)]
    own = {x["vec_id"]: x["leads"] for x in r.collect()}
    got = {x["vec_id"]: x for x in plans.QUERIES["atrial_features"](spark, folder).collect()}
    assert set(got) == set(own)
    for k, leads in own.items():
        areas, notches = [], []
        for p, q, qrs in beats:
            low = max(qrs - 1 - 4, 0)
            base = median(leads[0][low:qrs])
            areas.append(sum(v - base for v in leads[0][p : q + 1]) * 10.0)
            notches.append(notch([v - base for v in leads[0][p : q + 1]], 1))
        want = spread_of(leads, beats, 100)
        assert got[k]["p_area"] == pytest.approx(median(areas), abs=1e-6) and got[k]["p_notch_mv"] is None and notches == [None, None]
        assert got[k]["p_dispersion_ms"] is None if want is None else got[k]["p_dispersion_ms"] == pytest.approx(want)
    floor = plans.QUERIES["p_dispersion_floor"](spark, folder).first()
    assert floor["observed_sd_ms"] == pytest.approx(stdev([v for v in (spread_of(x, beats, 100) for x in own.values()) if v is not None]), abs=1e-6)


def test_table_of_waves_whose_width_differs_by_lead(spark):
    fs, names = 500, ["II", "V1", "V2", "V3"]
    widths = [8, 8, 10, 12]
    leads = [bump(300, 100, w, 0.2) for w in widths]
    flat = [[0.0] * 300 for _ in widths]
    r = spark.createDataFrame([(1, leads), (2, flat), (3, leads[:2])], "record_id int, leads array<array<double>>")
    b = spark.createDataFrame([(k, i, 80, 100, 120, 160) for k in (1, 2, 3) for i in (0, 1)] + [(2, 2, None, None, None, 160)], "record_id int, beat int, p_onset int, p_peak int, p_offset int, qrs_onset int")
    out = {x.record_id: x for x in atrial.atrial_table(r, b, "record_id", "leads", names, fs).collect()}
    waves = atrial.p_waves(r, b, "record_id", "leads", names, fs).where("record_id = 1 and beat = 0").collect()
    long = {w.lead: w.duration_ms for w in waves}
    assert long["II"] == long["V1"] < long["V2"] < long["V3"]
    assert out[1].p_dispersion_ms == long["V3"] - long["II"] and out[1].p_notch_mv == 0 and out[1].p_area > 0
    assert out[2].p_dispersion_ms is None and out[2].p_area == 0
    assert out[3].p_dispersion_ms is None
    assert atrial.atrial_table(r, b.limit(0), "record_id", "leads", names, fs).count() == 0


def test_amplitudes_over_vectors_follow_their_rules(spark):
    folder = "/root/testdata/sf0.001"
    r, _ = plans._recordings(spark, folder)
    got = {x["vec_id"]: x for x in plans.QUERIES["amplitude_features"](spark, folder).collect()}
    # qrs_onset, qrs_offset, r, p, t and the bounds of T; at 100 samples a second.
    beats = [(3, 6, 4, 2, 5, (4, 6)), (12, 14, 13, 10, None, None)]
    near = lambda v: None if v is None else pytest.approx(v, abs=2e-6)
    for record in r.collect():
        found = {c: [] for c in ("r", "t", "p", "st", "qrs", "axis_t", "progression")}
        for on, off, top, p, t, bounds in beats:
            base = [median(x[max(on - 5, 0) : on]) for x in record["leads"]]
            two, v1, one, foot = record["leads"]
            found["r"].append(abs(two[top] - base[0]))
            found["p"].append(two[p] - base[0])
            if t is not None:
                found["t"].append(two[t] - base[0])
            raised = [x[off + 6] - b for x, b in zip(record["leads"], base, strict=True) if off + 6 < len(x)]
            if raised:
                found["st"].append(max(raised, key=abs))
            net = lambda x, b, span: sum(v - b for v in x[span[0] : span[1] + 1])
            found["qrs"].append(math.degrees(math.atan2(net(foot, base[3], (on, off)), net(one, base[2], (on, off)))))
            if bounds:
                found["axis_t"].append(math.degrees(math.atan2(net(foot, base[3], bounds), net(one, base[2], bounds))))
            qrs = v1[on : off + 1]
            if max(max(qrs) - base[1], 0) > max(base[1] - min(qrs), 0):
                found["progression"].append(1.0)
        a, b = found["qrs"]
        led = b - 360 * math.floor((b - a + 180) / 360)
        own = got[record["vec_id"]]
        want = {"r_amplitude_mv": median(found["r"]), "t_amplitude_mv": found["t"][0], "p_amplitude_mv": median(found["p"]), "st_deviation_mv": median(found["st"]), "qrs_axis_deg": (a + led) / 2, "t_axis_deg": found["axis_t"][0], "sokolow_lyon_mv": None, "r_progression_lead": 1.0 if found["progression"] else None}
        assert {c: own[c] for c in want} == {c: near(v) for c, v in want.items()}
