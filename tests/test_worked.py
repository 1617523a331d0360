"""Worked checks over synthetic episodes with declared faults, alone and through an app."""

import pytest
from pyspark.sql import functions as F

from trailmark.app import App
from trailmark.operators import worked
from trailmark.operators.frames import frame_stats
from trailmark.plans.catalog import Catalog
from trailmark.sources.synthetic import EpisodeSpec, corpus, frames, instrument_lines, joint_states

START = 1_755_000_000_000_000_000
SPECS = [
    EpisodeSpec(1, 4.0, cameras=("/a", "/b")),
    EpisodeSpec(2, 4.0, cameras=("/a",), black_s=(0.0, 3.0)),
    EpisodeSpec(3, 4.0, cameras=("/a",), frozen_s=(1.0, 3.4), black_s=(0.0, 0.1)),
    EpisodeSpec(4, 4.0, cameras=("/a",), late_s=(2.0, 3.0), image_hz=10, jump_at_s=1.5),
]


@pytest.fixture(scope="module")
def seen(spark):
    return frames(spark, SPECS).cache()


@pytest.fixture(scope="module")
def stats(seen):
    return frame_stats(instrument_lines(seen)).cache()


def test_faults_are_as_declared(seen, stats):
    got = {(r["episode_id"], r["topic"]): r for r in stats.collect()}
    assert {k: (r["frame_count"], r["black_frame_count"]) for k, r in got.items()} == {(1, "/a"): (60, 0), (1, "/b"): (60, 0), (2, "/a"): (60, 45), (3, "/a"): (60, 2), (4, "/a"): (40, 0)}
    assert [tuple(x) for x in got[3, "/a"]["freeze_intervals"]] == [(1.0, 3.4)] and got[1, "/a"]["freeze_total_s"] == 0
    late = worked.late_frames(seen, F.col("topic") == "/a", expected_hz=10, tolerance_s=0.002).where("episode_id = 4").collect()
    assert sorted(r["log_time_ns"] for r in late) == [START + 2_000_000_000 + k * 100_000_000 + 3_000_000 for k in range(10)]


def test_camera_checks(seen, stats):
    blackout = {r["episode_id"]: (r["measurements"]["black_pct"], r["verdict"]) for r in worked.camera_blackout(stats).collect()}
    assert blackout == {1: (0.0, True), 2: (75.0, False), 3: (pytest.approx(100 / 30), True), 4: (0.0, True)}
    health = {r["episode_id"]: r for r in worked.camera_health(stats.where("topic = '/a'"), seen).collect()}
    assert {k: r["verdict"] for k, r in health.items()} == {1: True, 2: False, 3: False, 4: True}
    assert [tuple(x) for x in health[3]["intervals"]] == [("camera_freeze", START + 1_000_000_000, START + 3_400_000_000)] and health[1]["intervals"] is None


def test_joint_smoothness(spark):
    rows = [(1, "j", k, k, v) for k, v in enumerate(([0.0, 0.0], [0.01, -0.03], [0.01, 0.0]))] + [(2, "j", 0, 0, [1.0])]
    frame = spark.createDataFrame(rows, "episode_id bigint, topic string, log_time_ns bigint, seq bigint, value array<double>")
    got = {r["episode_id"]: r["measurements"] for r in worked.joint_smoothness(frame, rate_hz=100).collect()}
    assert got[1] == {"max_velocity_rad_s": pytest.approx(3.0), "mean_velocity_rad_s": pytest.approx(7 / 4)} and got[2] == {"max_velocity_rad_s": None, "mean_velocity_rad_s": None}


def test_hand_visibility(spark):
    rows = [(1, 12, " 9 "), (2, 12, "99"), (3, 12, "about nine"), (4, 12, "0"), (5, 12, "9" * 30)]
    got = {r["episode_id"]: r for r in worked.hand_visibility(spark.createDataFrame(rows, "episode_id bigint, tiles int, answer string")).collect()}
    assert {k: r["measurements"].get("hands_visible_fraction") for k, r in got.items()} == {1: 0.75, 2: 1.0, 3: None, 4: 0.0, 5: 1.0}
    assert got[3]["tags"] == ["hands_visible_unparsed"] and got[1]["tags"] == [] and got[3]["labels"] == {"hands_visible_raw_answer": "about nine"}


def test_a_corpus_through_an_app(spark, tmp_path):
    """Every declared blackout is quarantined, every jump is measured, and nothing else is."""
    plan = corpus(40, 42)
    assert plan == corpus(40, 42) and sum(s.black_s is not None for s in plan) > 3 and len({len(s.cameras) for s in plan}) == 3
    shown = frames(spark, plan)
    app = App(spark, f"file://{tmp_path}/catalog")

    @app.check("blackout", critical=True, version="v1")
    def blackout(messages):
        return worked.camera_blackout(frame_stats(instrument_lines(shown)), most_pct=1.0)

    @app.check("smooth", version="v1")
    def smooth(messages):
        return worked.joint_smoothness(messages)

    app.process(joint_states(spark, plan).withColumn("value", F.col("position")))
    catalog = Catalog(spark, app.root)
    black = {s.episode_id for s in plan if s.black_s and any(s.black_s[0] <= k / s.image_hz < s.black_s[1] for k in range(round(s.duration_s * s.image_hz)))}
    expected = {k for k in black if 100 * sum(s.black_s[0] <= j / s.image_hz < s.black_s[1] for s in plan if s.episode_id == k for j in range(round(s.duration_s * s.image_hz))) / next(round(s.duration_s * s.image_hz) for s in plan if s.episode_id == k) >= 1}
    assert {int(r["episode_id"]) for r in catalog.episodes().where("quarantined").collect()} == expected
    fast = {int(r["episode_id"]) for r in catalog.table("measurements").where("key = 'max_velocity_rad_s' and value_double > 50").collect()}
    jumps, gaps = ({s.episode_id for s in plan if getattr(s, c) is not None} - expected for c in ("jump_at_s", "gap_s"))
    assert jumps <= fast <= jumps | gaps  # a gap holds up to half a second of motion in one step
