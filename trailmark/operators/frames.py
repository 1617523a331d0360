"""Camera streams: H.264 access units, and per-frame instrument text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVEREXPOSED = 235.0
START_CODE = re.compile(rb"\x00?\x00\x00\x01")
#: NAL types of pictures, and schemas of encoded video.
PICTURES = {1, 2, 3, 4, 5}
VIDEO_SCHEMA = "foxglove.CompressedVideo"
VIDEO_SCHEMAS = (VIDEO_SCHEMA, "foxglove_msgs/msg/CompressedVideo")
UNITS = "array<struct<size:int,is_keyframe:boolean,has_parameter_sets:boolean,begins_with_delimiter:boolean>>"


def access_units(data: bytes) -> list[dict]:
    """The access units of an Annex B stream; a delimiter (NAL type 9) opens each.

    NALs in front of the first delimiter belong to its unit, unless one is a picture or there
    is no delimiter: then the first unit is one that doesn't begin with a delimiter. The zero
    in front of a three-byte start code belongs to that code.
    """
    marks = [(m.start(), data[m.end()] & 31) for m in START_CODE.finditer(data) if m.end() < len(data)]
    units: list[dict] = []
    for k, (at, kind) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(data)
        early = len(units) == 1 and not units[0]["begins_with_delimiter"] and not units[0]["types"] & PICTURES
        if kind == 9 and early:
            units[0]["begins_with_delimiter"] = True
        elif kind == 9 or not units:
            units.append({"size": at if not units else 0, "is_keyframe": False, "types": set(), "begins_with_delimiter": kind == 9})
        units[-1]["size"] += end - at
        units[-1]["types"].add(kind)
    for u in units:
        types = u.pop("types")
        u["is_keyframe"], u["has_parameter_sets"] = 5 in types, {7, 8} <= types
    return units


def wire_fields(data: bytes) -> dict[int, bytes | int]:
    """Fields of a protobuf message by number, the last of each: bytes, or a whole number. Damage is a ValueError."""
    out: dict[int, bytes | int] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("a protobuf message is cut off")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"protobuf wire type {kind}")
        n = number() if kind == 2 else 8 if kind == 1 else 4
        if at + n > len(data):
            raise ValueError("a protobuf message is cut off")
        out[key >> 3] = bytes(data[at : at + n])
        at += n
    return out


def compressed_video(data: bytes, encoding: str) -> tuple[str, bytes]:
    """``(format, stream)`` of a video message in protobuf or little-endian CDR."""
    if encoding == "protobuf":
        found = wire_fields(data)
        return bytes(found.get(4, b"")).decode(), bytes(found.get(3, b""))
    if encoding != "cdr" or data[:2] != b"\x00\x01":
        raise ValueError(f"video in message encoding {encoding!r} can't be decoded")
    at = 12  # behind the header and the time

    def block() -> bytes:
        nonlocal at
        at += -(at - 4) % 4
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            raise ValueError("a CDR message is cut off")
        at += 4 + n
        return bytes(data[at - n : at])

    block()
    stream = block()
    return block().rstrip(b"\0").decode(), stream


def video_faults(form: str, stream: bytes, first: bool) -> list[tuple[str, str]]:
    """``(code, message)`` of what keeps a message from being one decodable access unit; ``first`` of its stream must be a key frame."""
    if form != "h264":
        return [("video-format", f"format {form!r} isn't 'h264'")]
    units = access_units(stream)
    if not units or not units[0]["begins_with_delimiter"]:
        return [("video-not-aud-delimited", "no access unit delimiter in front of the first picture")]
    if len(units) > 1:
        return [("video-multiple-access-units", f"{len(units)} access units in a message")]
    out = []
    if units[0]["is_keyframe"] and not units[0]["has_parameter_sets"]:
        out.append(("video-keyframe-missing-parameter-sets", "a key frame without SPS and PPS"))
    if first and not units[0]["is_keyframe"]:
        out.append(("video-stream-starts-mid-gop", "the first message isn't a key frame"))
    return out


def video_fault(schema: str | None, encoding: str, data: bytes) -> tuple[str, str] | None:
    """What keeps a message of a video schema from passing into a canonical episode; None for others and for good ones."""
    if schema not in VIDEO_SCHEMAS:
        return None
    try:
        found = video_faults(*compressed_video(data, encoding), first=False)
    except (ValueError, UnicodeDecodeError) as e:
        return "video-format", str(e)
    return found[0] if found else None


def image_codec(form: Column) -> Column:
    """``png`` or ``mjpeg`` by what a compressed image's format says somewhere; any other is an error when it is read."""
    low = F.lower(form)
    told = F.concat(F.lit("no codec for images of format "), F.coalesce(form, F.lit("null")))
    return F.when(low.contains("png"), "png").when(low.contains("jpeg") | low.contains("jpg"), "mjpeg").otherwise(F.raise_error(told))


def units(data: Column) -> Column:
    def over(raw: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("size", pa.int32()), ("is_keyframe", pa.bool_()), ("has_parameter_sets", pa.bool_()), ("begins_with_delimiter", pa.bool_())]))
        return pa.array([None if x is None else access_units(x) for x in raw.to_pylist()], kind)

    return F.arrow_udf(over, UNITS)(data)


def video_findings(messages: DataFrame, *, keys=("path", "topic")) -> DataFrame:
    """``(keys..., code, message, log_time_ns)`` of messages that aren't one decodable access unit each.

    ``messages`` have a video schema and encoding, as ``mcap.messages`` gives them.
    """
    w = Window.partitionBy(*keys).orderBy("log_time_ns", "offset")

    def over(encodings: pa.Array, data: pa.Array, first: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("code", pa.string()), ("message", pa.string())]))
        out = []
        for encoding, raw, opens in zip(encodings.to_pylist(), data.to_pylist(), first.to_pylist()):
            try:
                found = video_faults(*compressed_video(raw or b"", encoding), first=opens)
            except (ValueError, UnicodeDecodeError) as e:
                found = [("video-format", str(e))]
            out.append([{"code": c, "message": m} for c, m in found])
        return pa.array(out, kind)

    placed = messages.where(F.col("schema_name").isin(*VIDEO_SCHEMAS)).withColumn("first", F.row_number().over(w) == 1)
    found = F.arrow_udf(over, "array<struct<code:string,message:string>>")("message_encoding", "data", "first")
    return placed.select(*keys, F.inline(found), "log_time_ns")


def frame_stats(lines: DataFrame, *, keys=("episode_id", "topic"), text: str = "line", order: str = "line_no") -> DataFrame:
    """Per-video figures from instrument text: frame lines followed by their ``lavfi`` keys.

    A line's keys belong to the frame line above it. The duration is the last time plus
    the median step; a freeze without an end lasts until then.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    value = lambda key: F.nullif(F.regexp_extract(text, rf"lavfi\.{key}=(.*)$", 1), F.lit("")).cast("double")
    stamped = lines.withColumn("pts", F.nullif(F.regexp_extract(text, r"pts_time:([-0-9.eE+]+)", 1), F.lit("")).cast("double"))
    stamped = stamped.withColumn("frame", F.sum(F.col("pts").isNotNull().cast("int")).over(w))
    one = lambda c: F.max(c)
    frames = stamped.groupBy(*keys, "frame").agg(
        one("pts").alias("pts"), one(value("signalstats\\.YAVG")).alias("luma"), one(value("blackframe\\.pblack")).alias("black"),
        one(value("freezedetect\\.freeze_start")).alias("freeze_start"), one(value("freezedetect\\.freeze_end")).alias("freeze_end"),
    ).where("frame > 0")
    step = Window.partitionBy(*keys).orderBy("frame")
    timed = frames.withColumn("dt", F.col("pts") - F.lag("pts").over(step))
    stats = timed.groupBy(*keys).agg(
        F.count("*").alias("frame_count"),
        (F.max("pts") + F.coalesce(F.median("dt"), F.lit(0.0))).alias("duration_s"),
        F.count("black").alias("black_frame_count"),
        F.sum((F.col("luma") >= OVEREXPOSED).cast("int")).alias("overexposed_frame_count"),
        F.avg("luma").alias("luma_mean"), F.min("luma").alias("luma_min"), F.max("luma").alias("luma_max"),
        F.array_sort(F.collect_list("freeze_start")).alias("starts"), F.array_sort(F.collect_list("freeze_end")).alias("ends"),
    )
    closed = F.transform("starts", lambda s, k: F.struct(s.alias("start_s"), F.coalesce(F.get("ends", k), F.col("duration_s")).alias("end_s")))
    total = F.aggregate(closed, F.lit(0.0), lambda a, f: a + f["end_s"] - f["start_s"])
    return stats.withColumns({"freeze_intervals": closed, "freeze_total_s": total}).drop("starts", "ends")
