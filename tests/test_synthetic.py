"""Synthetic episodes: injected defects are found; vectors on grids; channels."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators import channels, checks, resample
from trailmark.operators.series import islands, speed, steps
from trailmark.sources.synthetic import EpisodeSpec, corpus, joint_states

SECOND = 1_000_000_000
START = 1_755_000_000_000_000_000


@pytest.fixture(scope="module")
def episodes(spark):
    specs = [EpisodeSpec(1, 4.0), EpisodeSpec(2, 4.0, jump_at_s=1.5), EpisodeSpec(3, 4.0, gap_s=(2.0, 2.5))]
    return joint_states(spark, specs).withColumn("value", F.get("position", F.lit(0))).cache()


def test_shape(episodes):
    counts = {r["episode_id"]: r["count"] for r in episodes.groupBy("episode_id").count().collect()}
    assert counts == {1: 400, 2: 400, 3: 350}
    assert episodes.agg(F.max(F.abs(F.get("position", F.lit(3))))).first()[0] <= 0.5


def test_defects_are_found(episodes):
    jumps = checks.discontinuity(episodes, velocity_limit=3.0).where("violation_count > 0").collect()
    assert [(r["episode_id"], r["violation_count"]) for r in jumps] == [(2, 1)]
    gaps = checks.gaps(episodes).collect()
    assert [(r["episode_id"], r["start_ns"], r["end_ns"]) for r in gaps] == [(3, START + 1_990_000_000, START + 2_500_000_000)]
    runs = islands(speed(steps(episodes)), F.col("speed") > 3.0, "jump").collect()
    assert [(r["start_ns"], r["end_ns"], r["label"]) for r in runs] == [(START + 1_490_000_000, START + 1_500_000_000, "jump:/joint_states")]


def test_corpus_is_deterministic():
    assert corpus(20, 42) == corpus(20, 42) != corpus(20, 43)


def test_vector_grid(spark):
    rows = [(1, "t", k * SECOND, k, [10.0 * (k - 1), 100.0 * (k - 1)]) for k in (1, 2, 3)]
    m = spark.createDataFrame(rows, "episode_id bigint, topic string, log_time_ns bigint, seq bigint, position array<double>")
    got = resample.vector_to_grid(m, "position", 2, 2.0).orderBy("grid_ns").collect()
    assert [r["position_0"] for r in got] == [0, 5, 10, 15, 20] and [r["position_1"] for r in got] == [0, 50, 100, 150, 200]
    with pytest.raises(ValueError):
        resample.vector_to_grid(m, "orientation", 4, 2.0)


def test_channels(spark):
    rows = [("a", "/wrist_cam", channels.CAMERA_SCHEMAS[0]), ("a", "/joint", "x"), ("a", "/joint", "x")]
    c = spark.createDataFrame(rows, "path string, topic string, schema_name string")
    assert [r["topic"] for r in channels.cameras(c).collect()] == ["/wrist_cam"]
    assert [r["topic"] for r in channels.ambiguous_topics(c).collect()] == ["/joint"]
    assert channels.resolve("wrist", ["/wrist_cam", "/other"]) == "/wrist_cam"
    for bad in ("cam", "none"):
        with pytest.raises(LookupError):
            channels.resolve(bad, ["/a_cam", "/b_cam"])
