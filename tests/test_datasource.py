"""Recordings as a data source: pruned reads, canonical writes, and what the doctor says of them."""

import json
import os
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from trailmark.operators import doctor, frames
from trailmark.sources import canonical, datasource, indexed, mcap

from .test_recordings import ATTACHED, CHANNELS, recording


def nal(kind, body=b"xyz"):
    return b"\x00\x00\x00\x01" + bytes([kind]) + body


KEY = nal(9) + nal(7) + nal(8) + nal(5)
DELTA = nal(9) + nal(1)


def video(stream, form="h264"):
    """A protobuf message: time, frame id, data, format."""
    field = lambda k, raw: bytes([k << 3 | 2]) + (bytes([len(raw)]) if len(raw) < 128 else bytes([len(raw) & 127 | 128, len(raw) >> 7])) + raw
    return field(1, b"\x08\x05") + field(2, b"cam") + field(3, stream) + field(4, form.encode())


def episode(streams, *, records=None, limit=800, groups=None, form="h264", schema=frames.VIDEO_SCHEMA):
    """A recording with a video topic of these streams and a state topic."""
    channels = [
        {"channel_id": 1, "topic": "/cam", "schema_name": schema, "schema_encoding": "protobuf", "schema_data": b"d", "message_encoding": "protobuf", "channel_metadata": {}},
        {"channel_id": 2, "topic": "/state", "schema_name": "s", "schema_encoding": "jsonschema", "schema_data": b"{}", "message_encoding": "json", "channel_metadata": {}},
    ]
    rows = sorted([(1, k, 10 * k, 10 * k, video(s, form)) for k, s in enumerate(streams)] + [(2, k, 10 * k + 1, 10 * k + 1, b"{}") for k in range(len(streams))], key=lambda r: r[2])
    records = {doctor.EPISODE: {"task": "fold"}, doctor.PROVENANCE: {"schema_version": "1", "pipeline_version": "x"}} if records is None else records
    return mcap.packed(channels, rows, {"/cam": "cameras"} if groups is None else groups, records, limit)


@pytest.fixture
def folder(tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"in/{name}").mkdir(parents=True)
    (tmp_path / "in/a/one.mcap").write_bytes(recording()[0])
    (tmp_path / "in/b/one.mcap").write_bytes(recording(limit=90, metadata=False)[0])
    return tmp_path


def test_tables(spark, folder):
    """Each table equals that of a whole-file read, with files cut into many ranges."""
    tables = canonical.read(spark, f"file://{folder}/in", split_bytes=500)
    for name, frame in tables.items():
        want = getattr(mcap, name)(spark, f"file://{folder}/in/*/*.mcap")
        shared = [c for c in want.columns if c != "path"]
        plain = lambda f: f.select(F.regexp_extract("path", "in/(.*)", 1).alias("path"), *[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in f.dtypes if c in shared])  # noqa: E731, B023
        assert frame.count() == want.count() > 0
        assert plain(frame).exceptAll(plain(want)).count() == plain(want).exceptAll(plain(frame)).count() == 0
    assert {(r["topic"], r["channel_id"], r["message_count"], r["has_schema"]) for r in tables["channels"].collect()} == {(c[1], c[0], 0 if c[0] == 4 else 20, c[3] is not None) for c in CHANNELS}
    chunks = spark.read.format("mcap").option("table", "chunks").load(f"file://{folder}/in/a/one.mcap")
    assert chunks.count() > 5 and chunks.agg(F.sum("bytes")).first()[0] == 60 * (20 + 31)
    narrow = spark.read.format("mcap").schema("log_time_ns bigint, topic string").load(f"file://{folder}/in/*/one.mcap")
    assert narrow.columns == ["log_time_ns", "topic"] and narrow.count() == 120
    with pytest.raises(Exception, match="no table"):
        spark.read.format("mcap").option("table", "nothing").load(f"file://{folder}/in").count()


def test_filters_are_pushed_down(spark, folder):
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda: spark.read.format("mcap").option("pushFilters", "true").load(f"file://{folder}/in/a")
    rows = recording()[1]
    for condition, keep in (
        ("topic = '/cam' and log_time_ns >= 5000 and log_time_ns < 7001", lambda r: r[0] == 1 and 5000 <= r[2] < 7001),
        ("topic in ('/cam', '/none') and channel_id = 1 and sequence > 40", lambda r: r[0] == 1 and r[1] > 40),
        ("channel_id in (2, 3) and log_time_ns > 4002 and log_time_ns <= 9003", lambda r: r[0] in (2, 3) and 4002 < r[2] <= 9003),
        ("log_time_ns = 3001", lambda r: r[2] == 3001),
        ("topic = '/cam' and topic = '/joint'", lambda r: False),
        ("topic is null or log_time_ns < 0", lambda r: False),
        ("topic like '/j%'", lambda r: r[0] in (2, 3)),
    ):
        got = load().where(condition).select("channel_id", "sequence", "log_time_ns").collect()
        assert sorted(tuple(r) for r in got) == sorted((r[0], r[1], r[2]) for r in rows if keep(r)), condition
    plan = load().where("topic = '/cam' and log_time_ns >= 5000")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_limits(spark, folder):
    uri = f"file://{folder}/in/a"
    count = lambda **limits: datasource.scan(spark, uri, **limits).count()
    assert count() == 60 and count(topics=["/cam"]) == 20 and count(topics=[]) == 0 and count(channel_ids=[2, 3]) == 40
    assert count(topics=["/joint"], channel_ids=[1, 2], start_ns=5000, end_ns=7002) == 2
    assert datasource.scan(spark, [uri, f"file://{folder}/in/b/one.mcap"], "channels", topics=["/cam"]).count() == 2
    # One table in several filtered uses.
    frame = datasource.scan(spark, uri)
    assert frame.where("topic = '/cam'").count() == 20 and frame.count() == 60
    assert frame.where("topic = '/cam'").unionByName(frame.where("topic = '/joint'")).count() == 60


def test_a_time_filter_reads_fewer_bytes(tmp_path):
    noise = random.Random(1).randbytes
    uri = _put(tmp_path / "x.mcap", episode([KEY[:-3] + noise(3000).replace(b"\0", b"x") for _ in range(100)], limit=9_000))

    def fetched(**wanted):
        file = indexed.Ranges(uri)
        found = sum(1 for _ in indexed.messages(file, indexed.index(file), indexed.Wanted(**wanted)))
        return found, *file.fetched

    every, reads, size = fetched()
    few, fewer_reads, less = fetched(start_ns=500, end_ns=520)
    assert every == 200 and few == 4 and fewer_reads < reads / 2 and less < size / 10
    assert fetched(topics=frozenset(["/state"]))[2] < size / 10 and fetched(channel_ids=frozenset([9]))[0] == 0


def test_a_file_beyond_2_gb(spark, tmp_path):
    """A sparse file whose last chunk lies behind 3 GB; only what is asked for is read."""
    whole = recording(limit=200)[0]
    file = indexed.Ranges(_put(tmp_path / "small.mcap", whole))
    own = indexed.index(file)
    last = own.chunks[-1]
    gap = 3 << 30
    pad = mcap.HEADER + 0x80  # an opcode that readers skip
    tail = whole[last.offset :]
    summary = struct.unpack_from("<Q", whole, len(whole) - 28)[0]
    moved = bytearray()
    for at, code, body in mcap.records(whole, summary):
        body = bytearray(body)
        if code == mcap.CHUNK_INDEX and struct.unpack_from("<Q", body, 16)[0] == last.offset:
            struct.pack_into("<Q", body, 16, last.offset + gap)
        if code == mcap.FOOTER:
            struct.pack_into("<Q", body, 0, summary + gap)
        moved += struct.pack("<BQ", code, len(body)) + body
    path = tmp_path / "large.mcap"
    with open(path, "wb") as f:
        f.write(whole[: last.offset] + struct.pack("<BQ", pad, gap - 9))
        f.seek(last.offset + gap)
        f.write(tail[: summary - last.offset] + bytes(moved) + mcap.MAGIC)
    assert path.stat().st_size > 3 << 30
    datasource.register(spark)
    frame = spark.read.format("mcap").load(f"file://{path}")
    assert frame.count() == 60
    big = indexed.Ranges(f"file://{path}")
    assert len(list(indexed.messages(big, indexed.index(big), indexed.Wanted(start_ns=last.first_ns)))) >= 1 and big.fetched[1] < 1 << 20


def _put(path, data):
    path.write_bytes(data)
    return f"file://{path}"


def test_files_that_cannot_be_read(spark, tmp_path):
    datasource.register(spark)
    whole = recording()[0]
    summary = struct.unpack_from("<Q", whole, len(whole) - 28)[0]
    bare = whole[:summary] + struct.pack("<BQQQI", mcap.FOOTER, 20, 0, 0, 0) + mcap.MAGIC
    for data, told in ((b"nothing", "not an MCAP"), (whole[:-30], "cut off"), (bare, "no summary")):
        with pytest.raises(Exception, match=told):
            spark.read.format("mcap").load(_put(tmp_path / "x.mcap", data)).count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("mcap").load(f"file://{tmp_path}/nowhere").count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("mcap").load(f"file://{tmp_path}/empty").count() == 0


def test_a_file_without_chunks(spark, tmp_path):
    """Messages in the data section itself, and lz4."""
    import pyarrow as pa

    whole = recording(limit=1 << 30)[0]
    loose, chunked = bytearray(whole[:8]), bytearray(whole[:8])
    for _, code, body in mcap.records(whole, 8):
        if code == mcap.CHUNK:
            inner = mcap.unpacked(body)
            loose += inner
            first, last, size, crc = struct.unpack_from("<QQQI", body)
            packed = pa.Codec("lz4").compress(inner, asbytes=True)
            chunk = struct.pack("<QQQI", first, last, size, crc) + mcap._text("lz4") + struct.pack("<Q", len(packed)) + packed
            chunked += mcap._record(mcap.CHUNK, chunk)
        elif code == mcap.DATA_END:
            break
        elif code in (mcap.SCHEMA, mcap.CHANNEL):
            chunked += mcap._record(code, bytes(body))
    own = [(c, b) for _, c, b in mcap.records(whole, struct.unpack_from("<Q", whole, len(whole) - 28)[0]) if c in (mcap.SCHEMA, mcap.CHANNEL, mcap.STATISTICS)]
    for name, data in (("loose", loose), ("lz4", chunked)):
        data += mcap._record(mcap.DATA_END, b"\0\0\0\0")
        start = len(data)
        for code, body in own:
            data += mcap._record(code, bytes(body))
        data += mcap._record(mcap.FOOTER, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC
        (tmp_path / f"{name}.mcap").write_bytes(bytes(data))
    datasource.register(spark)
    got = spark.read.format("mcap").load(f"file://{tmp_path}/loose.mcap").orderBy("log_time_ns").collect()
    assert [(r["channel_id"], r["sequence"], r["log_time_ns"], r["publish_time_ns"], bytes(r["data"])) for r in got] == recording()[1]
    assert mcap.messages(spark, f"file://{tmp_path}/lz4.mcap").count() == 60


def test_canonical_episodes(spark, folder):
    """All messages, schemas, metadata and attachments come through; provenance is replaced; the doctor has nothing to say."""
    good = episode([KEY, DELTA, DELTA, KEY], records={doctor.EPISODE: {"task": "fold", "robot_software_version": "7"}, "other": {"k": "v"}, doctor.PROVENANCE: {"schema_version": "0", "old": "1"}})
    (folder / "in/a/video.mcap").write_bytes(good)
    tables = canonical.read(spark, f"file://{folder}/in")
    tables["metadata"] = tables["metadata"].unionByName(tables["metadata"].where("false"))
    derived = tables["messages"].where("topic = '/state'").select("path", F.lit("/sum").alias("topic"), "log_time_ns", F.lit('{"x": 1}').alias("data"))
    rows = canonical.rows(tables, pipeline_version="p1", groups={"/joint": "arm"}, derived=derived, derived_versions={"/sum": "d1"})
    out = f"file://{folder}/out"
    canonical.write(rows, out, chunk_bytes=300)
    names = sorted(canonical.published(out))
    assert len(names) == 3 and sum(n.startswith("one-") for n in names) == 2 and sorted(os.listdir(folder / "out")) == sorted([*names, datasource.PUBLISHED])
    after = canonical.read(spark, out)
    plain = lambda f: sorted((r["topic"], r["sequence"], r["log_time_ns"], r["publish_time_ns"], bytes(r["data"])) for r in f.where("topic != '/sum'").collect())
    assert plain(after["messages"]) == plain(tables["messages"])
    assert after["messages"].where("topic = '/sum'").count() == 4
    schemas = lambda f: sorted((r["topic"], str(r["schema_name"]), bytes(r["schema_data"] or b""), r["has_schema"], r["message_count"], str(r["channel_metadata"])) for r in f.where("topic != '/sum'").collect())
    assert schemas(after["channels"]) == schemas(tables["channels"])
    assert after["channels"].where("topic = '/sum'").select("schema_name", "message_encoding").distinct().collect() == [("derived/v1", "json")]
    attached = lambda f: sorted((r["name"], r["media_type"], r["log_time_ns"], bytes(r["data"])) for r in f.collect())
    assert attached(after["attachments"]) == attached(tables["attachments"]) and len(attached(after["attachments"])) == 2 * len(ATTACHED)
    records = {r["record"]: r["entries"] for r in after["metadata"].where("path like '%video%'").collect()}
    assert records["other"] == {"k": "v"} and records[doctor.EPISODE]["task"] == "fold"
    assert records[doctor.PROVENANCE] == {"schema_version": "1", "pipeline_version": "p1", "ffmpeg_version": "not-used", "resample_policy_version": "1", "derived//sum": "d1", "source_uri": f"file://{folder}/in/a/video.mcap"}
    assert {(r["code"], r["level"]) for r in doctor.findings(spark, f"{out}/*.mcap").collect()} <= {("missing-episode-record", "warning")}
    chunks = spark.read.format("mcap").option("table", "chunks").load(out)
    topics = after["channels"].select("path", "channel_id", "topic")
    mixed = chunks.select("path", "offset", F.explode("channel_ids").alias("channel_id")).join(topics, ["path", "channel_id"]).groupBy("path", "offset").agg(F.collect_set("topic").alias("t"))
    assert not [r for r in mixed.collect() if "/joint" in r["t"] and len(r["t"]) > 1 or "/cam" in r["t"] and len(r["t"]) > 1]
    held = canonical.merged(after["metadata"])
    own = held.where("path like '%video%'").first()["metadata"]
    assert own["task"] == "fold" and canonical.stamps(own) == canonical.Stamps("1", "p1", "not-used", "7")
    assert canonical.stamp_columns(held).count() == 3
    with pytest.raises(ValueError, match="pipeline_version"):
        canonical.stamps({"schema_version": "1", "ffmpeg_version": "x"})
    with pytest.raises(Exception, match="lacks pipeline_version"):
        canonical.stamp_columns(canonical.merged(tables["metadata"].where("path like '%video%'"))).collect()


def test_metadata_overlay(spark):
    frame = spark.createDataFrame([("p", 1, doctor.EPISODE, {"a": "1"}), ("p", 9, doctor.EPISODE, {"a": "2", "b": "3"}), ("p", 5, doctor.PROVENANCE, {"b": "4"}), ("q", 1, "other", {"z": "1"}), ("r", 1, doctor.PROVENANCE, {"c": "5"})], mcap.METADATA_ROWS)
    assert {r["path"]: r["metadata"] for r in canonical.merged(frame).collect()} == {"p": {"a": "2", "b": "4"}, "r": {"c": "5"}}


def test_what_canonical_refuses(spark, folder):
    bad = folder / "bad"
    for k, (data, told) in enumerate(
        (
            (episode([KEY], schema="foxglove.RawImage"), "raw images"),
            (episode([KEY], form="h265"), "video-format"),
            (episode([nal(5)]), "video-not-aud-delimited"),
            (episode([KEY + DELTA]), "video-multiple-access-units"),
            (episode([nal(9) + nal(5)]), "video-keyframe-missing-parameter-sets"),
        )
    ):
        (bad / str(k)).mkdir(parents=True)
        (bad / f"{k}/x.mcap").write_bytes(data)
        with pytest.raises(Exception, match=told):
            canonical.write(canonical.rows(canonical.read(spark, f"file://{bad}/{k}"), pipeline_version="p"), f"file://{bad}/{k}-out")
        assert not (bad / f"{k}-out").exists() or os.listdir(bad / f"{k}-out") == []
    rows = canonical.rows(canonical.read(spark, f"file://{folder}/in/a"), pipeline_version="p", derived_versions={"/joint": "1"})
    with pytest.raises(Exception, match="in the recording already"):
        canonical.write(rows, f"file://{folder}/never")


def test_publishing_again(spark, folder):
    rows = canonical.rows(canonical.read(spark, f"file://{folder}/in/a"), pipeline_version="p")
    out = f"file://{folder}/out"
    with pytest.raises(FileNotFoundError):
        canonical.published(f"file://{folder}/in")
    canonical.write(rows, out)
    first = canonical.published(out)
    with pytest.raises(Exception, match="are there already"):
        canonical.write(rows, out)
    assert canonical.published(out) == first and sorted(os.listdir(folder / "out")) == sorted([*first, datasource.PUBLISHED])
    canonical.write(canonical.rows(canonical.read(spark, f"file://{folder}/in"), pipeline_version="p"), out, overwrite=True)
    assert len(canonical.published(out)) == 2
    (folder / "out" / next(iter(first))).write_bytes(b"short")
    with pytest.raises(ValueError, match="isn't whole"):
        canonical.published(out)


def test_a_failed_task_leaves_no_file(spark, folder):
    tables = canonical.read(spark, f"file://{folder}/in")
    rows = canonical.rows(tables, pipeline_version="p").withColumn("sequence", F.when(F.col("log_time_ns") > 9000, F.raise_error(F.lit("planted")).cast("bigint")).otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="planted"):
        canonical.write(rows, f"file://{folder}/half")
    assert not (folder / "half").exists() or os.listdir(folder / "half") == []


def test_every_code_of_the_doctor(spark, tmp_path):
    """A planted file for each code, and nothing else in it that isn't meant."""
    fine = episode([KEY, DELTA])
    summary = struct.unpack_from("<Q", fine, len(fine) - 28)[0]

    def rebuilt(drop=(), change=None):
        """The file with other records in its summary; ``change`` gives a record's new body."""
        body = b"".join(struct.pack("<BQ", c, len(x)) + x for c, x in ((c, change(c, bytes(b)) if change else bytes(b)) for _, c, b in mcap.records(fine, summary) if c not in drop and c != mcap.FOOTER))
        footer = struct.pack("<QQ", summary, 0)
        crc = zlib.crc32(body + struct.pack("<BQ", mcap.FOOTER, 20) + footer)
        return fine[:summary] + body + mcap._record(mcap.FOOTER, footer + struct.pack("<I", crc)) + mcap.MAGIC

    def bare_chunk(code, body):
        return body[:32] + struct.pack("<I", 0) + body[36 + struct.unpack_from("<I", body, 32)[0] :] if code == mcap.CHUNK_INDEX else body

    hurt = bytearray(fine)
    at = next(k for k, c, _ in mcap.records(fine, 8) if c == mcap.CHUNK)
    hurt[at + 60] ^= 0x55
    back = mcap.packed([{"channel_id": 1, "topic": "/s", "schema_name": None, "message_encoding": "json"}], [(1, 0, 9, 9, b""), (1, 1, 5, 5, b"")], {}, {doctor.EPISODE: {}, doctor.PROVENANCE: {"schema_version": "1", "pipeline_version": "x"}})
    stamped = {"schema_version": "1", "pipeline_version": "x"}
    planted = {
        "unreadable": b"nothing",
        "no-summary": fine[:summary] + struct.pack("<BQQQI", mcap.FOOTER, 20, 0, 0, 0) + mcap.MAGIC,
        "no-statistics": rebuilt(drop=(mcap.STATISTICS,)),
        "no-chunk-indexes": rebuilt(drop=(mcap.CHUNK_INDEX,)),
        "chunk-missing-message-indexes": rebuilt(change=bare_chunk),
        "chunk-mixes-video-and-state": episode([KEY, DELTA], groups={"/none": "x"}),
        "missing-provenance": episode([KEY], records={doctor.EPISODE: {}}),
        "provenance-missing-key": episode([KEY], records={doctor.EPISODE: {}, doctor.PROVENANCE: {"schema_version": "1"}}),
        "missing-episode-record": episode([KEY], records={doctor.PROVENANCE: stamped}),
        "topic-time-order": back,
        "read-failed": bytes(hurt),
        "video-format": episode([KEY], form="hevc"),
        "video-not-aud-delimited": episode([nal(5) + nal(9)] * 5),
        "video-multiple-access-units": episode([KEY + KEY]),
        "video-keyframe-missing-parameter-sets": episode([nal(9) + nal(5)]),
        "video-stream-starts-mid-gop": episode([DELTA, KEY]),
    }
    assert set(planted) == set(doctor.CODES)
    for code, data in planted.items():
        (tmp_path / f"{code}.mcap").write_bytes(data)
    (tmp_path / "fine.mcap").write_bytes(fine)
    # Parameter sets in front of the delimiter belong to its unit.
    (tmp_path / "early.mcap").write_bytes(episode([nal(7) + nal(8) + nal(9) + nal(5), DELTA]))
    got = doctor.findings(spark, f"file://{tmp_path}/*.mcap").collect()
    assert {(r["path"].rpartition("/")[2][:-5], r["code"]) for r in got} == {(c, c) for c in planted}
    assert {r["level"] for r in got if r["code"] in doctor.WARNINGS} == {"warning"} and {r["level"] for r in got if r["code"] not in doctor.WARNINGS} == {"error"}
    delimited = [r for r in got if r["code"] == "video-not-aud-delimited"]
    assert len(delimited) == 3 and {r["suppressed"] for r in delimited} == {2}
    found = frames.video_findings(mcap.messages(spark, f"file://{tmp_path}/video-*.mcap"))
    assert {(r["path"].rpartition("/")[2][:-5], r["code"]) for r in found.collect()} == {(c, c) for c in planted if c.startswith("video-")}


def test_access_units_by_bytes():
    """Sizes add up, and the zero before a start code goes with it."""
    units = frames.access_units(nal(7) + nal(8) + nal(9) + nal(5) + nal(9) + nal(1))
    assert [u["size"] for u in units] == [32, 16] and units[0]["has_parameter_sets"] and units[0]["begins_with_delimiter"]
    assert not frames.access_units(nal(1) + nal(9) + nal(5))[0]["begins_with_delimiter"]
    cdr = b"\0\1\0\0" + struct.pack("<iI", 1, 2) + struct.pack("<I", 4) + b"cam\0" + struct.pack("<I", len(KEY)) + KEY + b"\0" * (-len(KEY) % 4) + struct.pack("<I", 5) + b"h264\0"
    assert frames.compressed_video(cdr, "cdr") == ("h264", KEY)
    assert json.loads(json.dumps(frames.video_faults("h264", KEY, True))) == []
    for raw in (b"\x0a\xff", b"\x0b", b"\xff" * 12):
        with pytest.raises(ValueError):
            frames.wire_fields(raw)
