"""Conformance of recordings: findings about files, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import mcap
from .frames import VIDEO_SCHEMA, compressed_video, video_faults

# Names of records and schemas, and the codes of findings below.
PROVENANCE = "provenance/v1"
EPISODE = "episode/v1"
PROVENANCE_KEYS = ("schema_version", "pipeline_version")
WARNINGS = ("chunk-mixes-video-and-state", "missing-episode-record")
CAMERA_SCHEMAS = ("sensor_msgs/msg/CompressedImage", "sensor_msgs/msg/Image", "foxglove.CompressedVideo", "foxglove.CompressedImage", "foxglove.RawImage", "foxglove_msgs/msg/CompressedVideo")
CAP = 3
CODES = (
    "unreadable", "no-summary", "no-statistics", "no-chunk-indexes", "chunk-missing-message-indexes", "chunk-mixes-video-and-state", "missing-provenance", "provenance-missing-key",
    "missing-episode-record", "topic-time-order", "read-failed", "video-format", "video-not-aud-delimited", "video-multiple-access-units", "video-keyframe-missing-parameter-sets", "video-stream-starts-mid-gop",
)


def structure(path: str, data: bytes) -> Iterator[tuple[str, str]]:
    """``(code, message)`` of what is wrong with a file, in one pass over it.

    What can't be read is a finding too: of the whole file (``unreadable``), or of the
    part behind which nothing more is known (``read-failed``). Video messages are judged in
    the order that the file has them, each stream by its channel.
    """
    try:
        if data[:8] != mcap.MAGIC or data[-8:] != mcap.MAGIC:
            raise ValueError("no magic bytes at both ends")
        found = list(mcap.records(data, 8))
        footer = next(mcap.Fields(body) for _, code, body in found if code == mcap.FOOTER)
        summary = footer.number("Q")
    except mcap.DAMAGE as e:
        yield "unreadable", f"not a whole recording: {e}"
        return
    if not summary:
        yield "no-summary", "the footer names no summary"
        return
    if not any(code == mcap.STATISTICS for at, code, _ in found if at >= summary):
        yield "no-statistics", "no statistics record"
    channels: dict[int, tuple[str, str | None, str]] = {}  # topic, schema, message encoding
    schemas: dict[int, str] = {}
    records: dict[str, dict[str, str]] = {}
    last: dict[int, int] = {}
    chunks: list[tuple[int, list[int]]] = []
    damaged = False
    for at, code, body in found:
        try:
            inner = mcap.records(mcap.unpacked(body)) if code == mcap.CHUNK else [(0, code, body)]
            for _, c, b in inner:
                f = mcap.Fields(memoryview(b))
                if c == mcap.MESSAGE:
                    number, _, time, _ = f.number("H"), f.number("I"), f.number("Q"), f.number("Q")
                    topic, schema, encoding = channels[number]
                    if time < last.get(number, time):
                        yield "topic-time-order", f"time goes back on {topic}: {last[number]}, then {time}"
                    if schema == VIDEO_SCHEMA:
                        for what, told in video_faults(*compressed_video(f.rest(), encoding), first=number not in last):
                            yield what, f"{topic} at {time}: {told}"
                    last[number] = time
                elif c == mcap.SCHEMA:
                    number = f.number("H")
                    schemas[number] = f.text()
                elif c == mcap.CHANNEL:
                    number, schema = f.number("H"), f.number("H")
                    channels[number] = (f.text(), schemas.get(schema), f.text())
                elif c == mcap.METADATA:
                    name = f.text()
                    records[name] = f.pairs()
                elif c == mcap.CHUNK_INDEX:
                    _, _, start, _ = (f.number("Q") for _ in range(4))
                    end, own = f.number("I") + f.at, []
                    while f.at < end:
                        own.append(f.number("H"))
                        f.number("Q")
                    chunks.append((start, own))
        except mcap.DAMAGE as e:
            damaged = True
            yield "read-failed", f"the record at {at}: {e or type(e).__name__}"
    if not chunks:
        yield "no-chunk-indexes", "no chunk indexes: the file has no chunks, or none can be found"
    for at, own in chunks:
        video = {channels.get(number, ("", None, ""))[1] == VIDEO_SCHEMA for number in own}
        if not own:
            yield "chunk-missing-message-indexes", f"the chunk at {at} has no message indexes"
        elif len(video) > 1:
            yield "chunk-mixes-video-and-state", f"the chunk at {at} holds {sorted(channels[n][0] for n in own if n in channels)}"
    if EPISODE not in records and not damaged:
        yield "missing-episode-record", f"no {EPISODE} record"
    if PROVENANCE not in records:
        if not damaged:
            yield "missing-provenance", f"no {PROVENANCE} record"
    else:
        for key in PROVENANCE_KEYS:
            if key not in records[PROVENANCE]:
                yield "provenance-missing-key", f"no key {key}"


def capped(rows: DataFrame, *keys: str, order: tuple[str, ...], cap: int = CAP) -> DataFrame:
    """The first ``cap`` rows of each key in order, with ``suppressed``, the number of the others.

    One shuffle: counts and places come from windows over the same rows.
    """
    by = Window.partitionBy(*keys)
    numbered = rows.withColumns({"_place": F.row_number().over(by.orderBy(*order)), "_n": F.count("*").over(by)}).where(F.col("_place") <= cap)
    return numbered.withColumn("suppressed", F.greatest(F.lit(0), F.col("_n") - cap).cast("bigint")).drop("_place", "_n")


def findings(spark: SparkSession, paths, *, cap: int = CAP) -> DataFrame:
    """``(path, level, code, message, suppressed)``: the first ``cap`` of each code and file."""
    return findings_of(spark.read.format("binaryFile").load(paths), cap=cap)


def findings_of(files: DataFrame, *, cap: int = CAP) -> DataFrame:
    """``findings`` of files that are rows already, ``(path, content)``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows = [(path.as_py(), k, *x) for k, x in enumerate(structure(path.as_py(), content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "place", "code", "message"])

    rows = files.select("path", "content").mapInArrow(over, "path string, place bigint, code string, message string")
    level = F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error")
    return capped(rows, "path", "code", order=("place", "message"), cap=cap).select("path", level.alias("level"), "code", "message", "suppressed")
