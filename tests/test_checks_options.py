"""Options of the checks against plain versions: rates by topic, vectors, freezes, the digest's framing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import channels, checks, gates
from trailmark.operators.frames import frame_stats
from trailmark.operators.series import speed, steps
from trailmark.plans import views

SECOND = 1_000_000_000


def plain_digest(channels, rows):
    """rows: (topic, channel, time, place, data); in the framing that the digest declares."""
    h = hashlib.sha256()
    for topic, number in sorted(channels):
        own = sorted((t, p, d) for c, k, t, p, d in rows if (c, k) == (topic, number))
        h.update(topic.encode() + len(own).to_bytes(8, "big"))
        for t, _, d in own:
            h.update(t.to_bytes(8, "big", signed=True) + len(d or b"").to_bytes(8, "big") + (d or b""))
    return h.hexdigest()


def test_digest(spark):
    rng = random.Random(3)
    rows = [(e, rng.choice("aéb"), rng.randrange(3), rng.randrange(-5, 40), p, rng.choice([None, b"", rng.randbytes(rng.randrange(300))])) for e in range(3) for p in range(200)]
    frame = spark.createDataFrame(rows, "episode_id bigint, topic string, channel_id int, log_time_ns bigint, seq bigint, data binary").repartition(7)
    known = {e: {(r[1], r[2]) for r in rows if r[0] == e} for e in range(3)}
    got = {r["episode_id"]: r["content_digest"] for r in checks.digest(frame).collect()}
    assert got == {e: plain_digest(known[e], [r[1:] for r in rows if r[0] == e]) for e in range(3)}
    quiet = {e: known.get(e, set()) | {("quiet", 9)} for e in range(4)}
    table = spark.createDataFrame([(e, t, k) for e, own in quiet.items() for t, k in own], "episode_id bigint, topic string, channel_id int")
    got = {r["episode_id"]: r["content_digest"] for r in checks.digest(frame, table).collect()}
    assert got == {e: plain_digest(quiet[e], [r[1:] for r in rows if r[0] == e]) for e in range(4)}
    one = frame.where("episode_id = 0")
    assert checks.digest(one.withColumn("seq", F.col("seq") + 1000)).first() == checks.digest(one.repartition(1)).first()
    assert checks.digest(frame.where("false")).count() == 0


def test_digest_of_a_long_stream(spark):
    """Many more messages than a batch holds, in one stream."""
    frame = spark.range(0, 300_000, 1, 9).select(F.lit(1).cast("bigint").alias("episode_id"), F.lit("t").alias("topic"), (299_999 - F.col("id")).alias("log_time_ns"), F.col("id").alias("seq"), F.col("id").cast("string").alias("data"))
    h = hashlib.sha256(b"t" + (300_000).to_bytes(8, "big"))
    for t in range(300_000):
        raw = str(299_999 - t).encode()
        h.update(t.to_bytes(8, "big") + len(raw).to_bytes(8, "big") + raw)
    assert checks.digest(frame).first()["content_digest"] == h.hexdigest()


def stream(spark, topics):
    rows = [(1, t, int(s * SECOND), k, float(k)) for t, times in topics.items() for k, s in enumerate(times)]
    return spark.createDataFrame(rows, "episode_id bigint, topic string, log_time_ns bigint, seq bigint, value double")


def test_rates_by_topic(spark):
    frame = stream(spark, {"a": [0, 1, 2, 3, 9], "b": [0, 2, 4, 6, 8], "c": [0]})
    got = {r["topic"]: r for r in checks.regularity(frame, expected_hz={"a": 0.5, "b": 0, "z": 9}, tolerance_s=0.1).collect()}
    assert got["a"]["violation_pct"] == 100.0 and got["a"]["median_dt_s"] == 1.0 and got["b"]["violation_pct"] == 0.0
    assert (got["c"]["message_count"], got["c"]["violation_pct"]) == (1, None)
    assert {r["topic"]: r["violation_pct"] for r in checks.regularity(frame, expected_hz=1.0, tolerance_s=0.1).collect()} == {"a": 25.0, "b": 100.0, "c": None}
    spans = lambda **k: sorted((r["label"], r["start_ns"] // SECOND, r["end_ns"] // SECOND) for r in checks.gaps(frame, **k).collect())
    assert spans() == [("gap:a", 3, 9)] and spans(expected_hz={"a": 0.1}) == [] and spans(expected_hz={"b": 2.0}, gap_factor=3.0) == [("gap:a", 3, 9), *[("gap:b", k, k + 2) for k in (0, 2, 4, 6)]]
    deficit = lambda **k: {r["topic"]: (r["expected_frame_count"], r["frame_deficit_pct"]) for r in checks.frame_deficit(frame, **k).collect()}
    assert deficit() == {"a": (10, 50.0), "b": (5, 0.0), "c": (None, None)}
    assert deficit(expected_hz={"b": 0.25}) == {"a": (10, 50.0), "b": (3, pytest.approx(-200 / 3)), "c": (None, None)}


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.0, 0.0]), (1, [1.0, -3.0]), (2, [1.0, nan]), (3, [nan, nan]), (3, [5.0, 5.0]), (4, [5.0, 5.5]), (5, None), (6, [1.0])]
    frame = spark.createDataFrame([(1, "j", t * SECOND, k, v) for k, (t, v) in enumerate(rows)], "episode_id bigint, topic string, log_time_ns bigint, seq bigint, value array<float>")
    got = [r["speed"] for r in speed(steps(frame)).orderBy("log_time_ns", "seq").collect()]
    assert got == [None, 3.0, 0.0, None, None, 0.5, None, None]
    assert checks.discontinuity(frame, velocity_limit=0.4).first()["violation_count"] == 2
    assert [(r["start_ns"], r["end_ns"]) for r in checks.discontinuity_runs(frame, velocity_limit=0.4).orderBy("start_ns").collect()] == [(0, SECOND), (3 * SECOND, 4 * SECOND)]


def test_freezes_on_the_log_clock(spark):
    text = "frame:0 pts:0 pts_time:0\nlavfi.freezedetect.freeze_start=0.5\nframe:1 pts:1 pts_time:1\nlavfi.freezedetect.freeze_end=1.0\nframe:2 pts:2 pts_time:2\nlavfi.freezedetect.freeze_start=2.0"
    lines = spark.createDataFrame([(e, "cam", k, x) for e in (1, 2) for k, x in enumerate(text.split("\n"))], "episode_id bigint, topic string, line_no int, line string")
    log = spark.createDataFrame([(1, "cam", 7 * SECOND), (1, "cam", 8 * SECOND), (1, "other", 1)], "episode_id bigint, topic string, log_time_ns bigint")
    got = sorted((r["episode_id"], r["label"], r["start_ns"], r["end_ns"]) for r in checks.freezes(frame_stats(lines), log).collect())
    assert got == [(1, "freeze:cam", 7_500_000_000, 8_000_000_000), (1, "freeze:cam", 9_000_000_000, 10_000_000_000)]


def test_places_in_a_column(spark):
    for most in (1, 2, 8):
        got = spark.range(0, 40).select("id", gates.spread(F.col("id"), most).alias("p")).collect()
        assert all(r["p"] == gates.sample_places(r["id"], most) for r in got)


def test_duplicates_as_rows(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"own {k}") for k in range(9)], "id bigint, text string")
    assert views.duplicates(docs, F.md5("text"), "id").select("n", "first").collect() == [(6, 1)]
    assert sorted(r["id"] for r in views.duplicate_members(docs, F.md5("text"), "id").collect()) == [1, 2, 4, 5, 7, 8]
    assert channels.sizes(docs.withColumnRenamed("text", "topic"), size=F.lit(5), bulk_bytes=4).where("topic = 'same'").select("n", "bytes", "kind").collect() == [(6, 30, "bulk")]


def test_new_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b")], "id int, k string")
    assert sorted(r["id"] for r in views.new_rows(rows, rows.where("id = 1"), "k").collect()) == [2, 4]
