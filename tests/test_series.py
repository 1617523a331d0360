"""Checks and resampling against plain Python, and literal vectors."""

import random
from fractions import Fraction

import numpy as np
import pytest

from trailmark.operators import checks, gates, resample
from trailmark.operators.frames import access_units, frame_stats

SECOND = 1_000_000_000


def stream(spark, times, values, topic="t", episode=1):
    rows = [(episode, topic, t, k, float(v), "{}") for k, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, "episode_id bigint, topic string, log_time_ns bigint, seq bigint, value double, data string")


def grid(frame):
    return [(r["grid_ns"] / SECOND, r["value"]) for r in frame.orderBy("grid_ns").collect()]


def test_ramp(spark):
    ramp = stream(spark, [1250000000, 2250000000, 3250000000], [0, 10, 20])
    assert grid(resample.to_grid(ramp, 1.0)) == [(2.0, 7.5), (3.0, 17.5)]
    assert grid(resample.to_grid(ramp, 1.0, policy="nearest")) == [(2.0, 10.0), (3.0, 20.0)]
    assert grid(resample.to_grid(ramp, 0.01)) == []
    with pytest.raises(ValueError):
        resample.to_grid(ramp, 0.0)
    with pytest.raises(ValueError):
        resample.to_grid(ramp, 1.0, policy="spline")


def test_last_sample_and_duplicates(spark):
    s = stream(spark, [SECOND, 2 * SECOND, 2 * SECOND, 3 * SECOND], [10, 20, 30, 40])
    assert grid(resample.to_grid(s, 2.0)) == [(1.0, 10.0), (1.5, 15.0), (2.0, 30.0), (2.5, 35.0), (3.0, 40.0)]
    assert grid(resample.to_grid(s, 2.0, policy="nearest")) == [(1.0, 10.0), (1.5, 10.0), (2.0, 20.0), (2.5, 30.0), (3.0, 40.0)]


@pytest.mark.parametrize("rate", [1.0, 3.0, 0.1, 29.97, 100.0])
def test_grid_points_are_exact(spark, rate):
    rng = random.Random(int(rate * 100))
    start = 1_755_000_000_000_000_000
    times = sorted(start + rng.randrange(int(30 * SECOND / rate)) for _ in range(20))
    step = Fraction(SECOND) / Fraction(rate)
    want = [round(k * step) for k in range(-((-times[0]) // step), times[-1] // step + 1)]
    got = resample.to_grid(stream(spark, times, range(20)), rate).orderBy("grid_ns")
    assert [r["grid_ns"] for r in got.collect()] == want


def test_checks_against_numpy(spark):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 50, 60)) * SECOND // 4
    values = rng.normal(size=60)
    m = stream(spark, times.tolist(), values.tolist())
    dt = np.diff(times) / 1e9
    r = checks.regularity(m, tolerance_s=0.1).first()
    assert r["median_dt_s"] == np.median(dt) and r["max_gap_s"] == dt.max()
    assert r["violation_pct"] == pytest.approx(100 * np.mean(np.abs(dt - np.median(dt)) > 0.1))
    speed = np.where(dt > 0, np.abs(np.diff(values)) / np.where(dt > 0, dt, 1), np.nan)
    d = checks.discontinuity(m, velocity_limit=2.0).first()
    assert d["violation_count"] == np.sum(speed > 2) and d["nonpositive_dt_count"] == np.sum(dt <= 0)
    assert d["max_abs_velocity"] == pytest.approx(np.nanmax(speed))
    i = checks.idle(m, epsilon=1.0).first()
    assert i["idle_total_s"] == pytest.approx(dt[speed < 1].sum())
    runs, k = [], 0
    while k < len(dt):
        if speed[k] > 2:
            a = k
            while k < len(dt) and speed[k] > 2:
                k += 1
            runs.append((times[a], times[k]))
        k += 1
    got = checks.discontinuity_runs(m, velocity_limit=2.0).orderBy("start_ns").collect()
    assert [(x["start_ns"], x["end_ns"]) for x in got] == runs


def test_single_message(spark):
    m = stream(spark, [5], [1.0])
    r = checks.regularity(m).first()
    assert (r["message_count"], r["median_dt_s"], r["violation_pct"]) == (1, None, None)
    assert checks.action_rate(m).first()["action_rate_hz"] == 0.0
    assert checks.gaps(m).count() == checks.idle_runs(m, epsilon=1.0).count() == 0
    assert resample.fps_estimate(m).first()["fps"] is None


def test_digests(spark):
    a, b = stream(spark, [1, 2], [0, 0]), stream(spark, [1, 3], [0, 0])
    one = lambda m: checks.digest(m).first()["content_digest"]
    assert one(a) == one(stream(spark, [1, 2], [0, 0])) != one(b)


def test_planning():
    sizes = [900, 850, 500, 400, 300, 250, 200, 150, 100, 50]
    lanes = gates.lanes(sizes, gates.by_count(3))
    loads = [sum(s for s, k in zip(sizes, lanes) if k == lane) for lane in range(3)]
    assert max(loads) - min(loads) <= 150 and sum(loads) == 3700
    assert gates.lanes([1000, 400, 350, 300], gates.by_bytes(700)) == [0, 1, 2, 1]
    assert [gates.allowed_errors(n) for n in (0, 100, 10000)] == [8, 8, 100]
    assert gates.lane_plan(2, online=True) == [(0, 0.0)] and len(gates.lane_plan(9)) == 4
    assert gates.sample_places(10, 4) == [0, 3, 6, 9] and gates.sample_places(2, 4) == [0, 1]


def first_fit(sizes, target):
    loads, out = [], []
    for s in sizes:
        k = next((k for k, load in enumerate(loads) if load + s <= target), len(loads))
        if k == len(loads):
            loads.append(0)
        loads[k] += s
        out.append(k)
    return out


def test_first_fit_by_tree():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 7, 50, 99, 100, 101, rng.randrange(150)]) for _ in range(rng.randrange(80))]
        for order in (sizes, sorted(sizes, reverse=True)):
            assert gates.lanes(order, gates.by_bytes(100)) == first_fit(order, 100)


def test_deal_and_chunks_over_batches(spark):
    """Streams go on over Arrow batches; keys begin anew, null keys, items and sizes included."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k if k else None, rng.choice([None, 0, rng.randrange(60)])) for k in range(400)]
    items = spark.createDataFrame(rows, "g string, item bigint, size int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for pack in (gates.by_count(3), gates.by_bytes(100)):
            want = set()
            for g in ("a", "b", None):
                own = sorted(((i, s or 0) for x, i, s in rows if x == g), key=lambda r: (-r[1], r[0] is None, r[0]))
                batches = {}
                for (i, s), lane in zip(own, gates.lanes([s for _, s in own], pack)):
                    batches.setdefault(lane, []).append((i, s))
                ranked = sorted(batches.values(), key=lambda b: (-sum(s for _, s in b), min(i for i, _ in b if i is not None)))
                want |= {(g, i, s, k) for k, b in enumerate(ranked) for i, s in b}
            assert {tuple(r) for r in gates.deal(items, pack, key="g", item="item", size="size").collect()} == want
            known = {(r["g"], r["batch"]): (r["total_bytes"], len(r["items"])) for r in gates.plan(items, pack, key="g", item="item", size="size").collect()}
            assert {k: v[0] for k, v in known.items()} == {(g, k): sum(s for a, _, s, b in want if (a, b) == (g, k)) for g, _, _, k in want}
        got = gates.chunks(items.where("item is not null"), "size", 50, keys=("g",), order=("item",)).collect()
        for g in ("a", "b", None):
            at, held = 0, 0
            for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["item"]):
                assert r["chunk"] == at
                held += r["size"]
                if held > 50:
                    at, held = at + 1, 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gate(spark):
    rows = [(1, 1, False, True, None), (1, 2, True, False, None), (1, 3, False, True, None), (2, 1, True, None, None), (2, 2, True, None, "boom"), (2, 3, False, False, None)]
    got = gates.gate(spark.createDataFrame(rows, "episode_id int, step_order int, critical boolean, verdict boolean, error string")).orderBy("episode_id", "step_order")
    assert [r["status"] for r in got.collect()] == ["passed", "failed", "skipped", "measured", "error", "failed"]
    with pytest.raises(RuntimeError):
        gates.enforce(spark.createDataFrame([(3, 3)], "error bigint, total bigint"))


def test_access_units():
    nal = lambda kind: b"\x00\x00\x00\x01" + bytes([kind]) + b"xyz"
    units = access_units(nal(9) + nal(7) + nal(8) + nal(5) + nal(9) + nal(1))
    assert [(u["is_keyframe"], u["has_parameter_sets"], u["begins_with_delimiter"]) for u in units] == [(True, True, True), (False, False, True)]
    assert access_units(b"") == []


def test_frame_stats(spark):
    text = """frame:0 pts:0 pts_time:0
lavfi.signalstats.YAVG=10
lavfi.blackframe.pblack=99
frame:1 pts:1 pts_time:0.5
lavfi.signalstats.YAVG=40
lavfi.freezedetect.freeze_start=0.5
frame:2 pts:2 pts_time:1
lavfi.signalstats.YAVG=240
lavfi.freezedetect.freeze_end=0.8
lavfi.freezedetect.freeze_start=1.2"""
    lines = spark.createDataFrame([(1, "cam", k, x) for k, x in enumerate(text.split("\n"))], "episode_id int, topic string, line_no int, line string")
    r = frame_stats(lines).first()
    assert (r["frame_count"], r["duration_s"], r["black_frame_count"], r["overexposed_frame_count"]) == (3, 1.5, 1, 1)
    assert [tuple(x) for x in r["freeze_intervals"]] == [(0.5, 0.8), (1.2, 1.5)] and r["freeze_total_s"] == pytest.approx(0.6)
