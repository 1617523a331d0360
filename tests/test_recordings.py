"""MCAP files written, read back and checked; CDR decoding."""

import struct

import pytest
from pyspark.sql import functions as F

from trailmark.functions import cdr
from trailmark.operators import doctor
from trailmark.sources import mcap

COLUMNS = "path string, channel_id int, topic string, schema_name string, schema_encoding string, message_encoding string, offset bigint, log_time_ns bigint, publish_time_ns bigint, data binary"


CHANNELS = (
    (1, "/cam", "cdr", doctor.CAMERA_SCHEMAS[0], "ros2msg", b"uint8[] data", {"fps": "15"}),
    (2, "/joint", "json", "joint", "jsonschema", b"{}", {}),
    (3, "/joint", "json", "joint", "jsonschema", b"{}", {"arm": "left"}),
    (4, "/quiet", "raw", None, None, None, {}),
)
ATTACHED = [{"name": "calibration.json", "media_type": "application/json", "log_time_ns": 5, "create_time_ns": 4, "data": b'{"a": 1}'}, {"name": "empty", "media_type": "", "log_time_ns": 6, "create_time_ns": 6, "data": b""}]


def recording(limit=200, metadata=True, mixed=False):
    fields = ("channel_id", "topic", "message_encoding", "schema_name", "schema_encoding", "schema_data", "channel_metadata")
    topics = [dict(zip(fields, c)) for c in CHANNELS]
    rows = sorted(((c[0], 7 * k + 5, 1000 * k + c[0], 1000 * k + c[0] + 3, bytes([c[0], k]) * 10) for k in range(20) for c in CHANNELS[:3]), key=lambda r: r[2])
    records = {doctor.EPISODE: {"task": "fold"}, doctor.PROVENANCE: {"schema_version": "1", "pipeline_version": "x"}} if metadata else {}
    return mcap.packed(topics, rows, {} if mixed else {"/cam": "camera"}, records, limit, ATTACHED), rows


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.mcap").write_bytes(recording()[0])
    return f"file://{tmp_path}/a.mcap"


def test_round_trip(spark, path):
    rows = recording()[1]
    got = mcap.messages(spark, path).orderBy("log_time_ns").collect()
    assert [(r["channel_id"], r["sequence"], r["log_time_ns"], r["publish_time_ns"], bytes(r["data"])) for r in got] == rows
    assert mcap.messages(spark, path, topics=["/cam"], start_ns=5000, end_ns=7001).count() == 2
    assert mcap.channels(spark, path).count() == 4 and mcap.channels(spark, path, topics=["/cam"]).first()["schema_name"] == doctor.CAMERA_SCHEMAS[0]
    assert {r["record"]: r["entries"] for r in mcap.metadata(spark, path).collect()}[doctor.EPISODE] == {"task": "fold"}
    assert [{k: v for k, v in r.asDict().items() if k != "path"} for r in mcap.attachments(spark, path).orderBy("name").collect()] == [{**x, "data": bytearray(x["data"])} for x in ATTACHED]


def test_files_from_messages(spark, path, tmp_path):
    """Every field of messages, channels, metadata and attachments survives a rewrite, and the result conforms."""
    read = {k: getattr(mcap, k)(spark, path) for k in ("messages", "channels", "metadata", "attachments")}
    content = mcap.to_files(read["messages"], channels=read["channels"], metadata=read["metadata"], attachments=read["attachments"], groups={"/cam": "camera"}, limit=100).first()["content"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/b.mcap").write_bytes(bytes(content))
    for name, before in read.items():
        after = getattr(mcap, name)(spark, f"file://{tmp_path}/b")
        key = [F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in before.dtypes if c not in ("path", "offset")]
        assert after.count() == before.count() > 0
        assert after.select(key).exceptAll(before.select(key)).count() == 0
    assert doctor.findings(spark, f"file://{tmp_path}/b").count() == 0


def test_doctor_survives_damage(spark, tmp_path):
    whole = recording()[0]
    at = next(k for k, c, _ in mcap.records(whole, 8) if c == mcap.CHUNK)
    for k in range(0, 80, 8):
        hurt = bytearray(whole)
        hurt[at + 60 + k] ^= 0x55
        (tmp_path / f"{k}.mcap").write_bytes(bytes(hurt))
    (tmp_path / "cut.mcap").write_bytes(whole[: len(whole) // 2])
    got = doctor.findings(spark, f"file://{tmp_path}/*.mcap").where("level = 'error'").collect()
    assert {r["path"].rpartition("/")[2] for r in got} == {f"{k}.mcap" for k in range(0, 80, 8)} | {"cut.mcap"}
    assert "read-failed" in {r["code"] for r in got}


def test_doctor(spark, path, tmp_path):
    assert doctor.findings(spark, path).count() == 0
    (tmp_path / "mixed.mcap").write_bytes(recording(metadata=False, mixed=True)[0])
    (tmp_path / "short.mcap").write_bytes(recording()[0][:-20])
    got = {(r["path"].rpartition("/")[2], r["code"]): (r["level"], r["suppressed"]) for r in doctor.findings(spark, f"file://{tmp_path}/*.mcap").collect()}
    assert ("short.mcap", "unreadable") in got and ("mixed.mcap", "missing-provenance") in got
    assert got[("mixed.mcap", "missing-episode-record")][0] == "warning"
    assert not any(p == "a.mcap" for p, _ in got)


def test_bad_files():
    with pytest.raises(ValueError):
        list(mcap.walk(b"nothing"))


def test_joint_state(spark):
    text = lambda s: struct.pack("<I", len(s) + 1) + s.encode() + b"\0"
    body = struct.pack("<iI", 7, 5) + text("base")
    body += b"\0" * (-len(body) % 4) + struct.pack("<I", 1) + text("elbow")
    body += b"\0" * (-len(body) % 4) + struct.pack("<I", 2)
    body += b"\0" * (-len(body) % 8) + struct.pack("<dd", 1.5, -2.0) + struct.pack("<II", 0, 0)
    data = b"\0\1\0\0" + body
    r = spark.createDataFrame([(bytearray(data),), (None,)], "data binary").select(cdr.decoded(F.col("data")).alias("s")).collect()
    assert r[0]["s"]["stamp_ns"] == 7_000_000_005 and r[0]["s"]["name"] == ["elbow"] and r[0]["s"]["position"] == [1.5, -2.0]
    assert r[1]["s"] is None
    with pytest.raises(ValueError):
        cdr.joint_state(b"\0\0\0\0")
