"""Recordings in MCAP files as DataFrames, and back.

Spark lists and reads the files; a task parses a file's records into rows, topic and
time filters skip whole chunks before they are decompressed.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What reading a damaged file may raise.
DAMAGE = (ValueError, IndexError, KeyError, StopIteration, struct.error, zstandard.ZstdError)
MAGIC = b"\x89MCAP0\r\n"
# Fixed values of the format: record opcodes.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, SUMMARY_OFFSET, DATA_END = range(1, 16)

MESSAGES = "path string, channel_id int, topic string, schema_name string, schema_encoding string, message_encoding string, offset bigint, sequence bigint, log_time_ns bigint, publish_time_ns bigint, data binary"
CHANNELS = "path string, channel_id int, topic string, schema_name string, schema_encoding string, message_encoding string, channel_metadata map<string,string>, schema_data binary"
METADATA_ROWS = "path string, offset bigint, record string, entries map<string,string>"
ATTACHMENTS = "path string, offset bigint, name string, media_type string, log_time_ns bigint, create_time_ns bigint, data binary"


class Fields:
    """Reads a record's fields one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, kind: str) -> int:
        (x,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += struct.calcsize("<" + kind)
        return x

    def raw(self, kind: str = "I") -> bytes:
        n = self.number(kind)
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def text(self) -> str:
        return self.raw().decode()

    def pairs(self) -> dict[str, str]:
        end = self.number("I") + self.at
        out = {}
        while self.at < end:
            key = self.text()
            out[key] = self.text()
        return out

    def rest(self) -> bytes:
        return bytes(self.data[self.at :])


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, memoryview]]:
    """``(offset, opcode, content)`` of each record."""
    view = memoryview(data)
    while at + 9 <= len(view) and bytes(view[at : at + 8]) != MAGIC:
        (n,) = struct.unpack_from("<Q", view, at + 1)
        yield at, view[at], view[at + 9 : at + 9 + n]
        at += 9 + n


def unpacked(chunk: memoryview, start_ns: int | None = None, end_ns: int | None = None) -> bytes | None:
    """A chunk's records, or None if its times lie outside ``[start_ns, end_ns)``."""
    f = Fields(chunk)
    first, last, size, crc = f.number("Q"), f.number("Q"), f.number("Q"), f.number("I")
    if start_ns is not None and last < start_ns or end_ns is not None and first >= end_ns:
        return None
    compression, body = f.text(), f.raw("Q")
    if compression == "zstd":
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    elif compression == "lz4":
        body = pa.Codec("lz4").decompress(body, size, asbytes=True)
    elif compression:
        raise ValueError(f"chunks compressed by {compression!r} can't be read here")
    if crc and zlib.crc32(body) != crc:
        raise ValueError("a chunk's checksum is wrong")
    return body


def walk(data: bytes, start_ns: int | None = None, end_ns: int | None = None) -> Iterator[tuple[int, int, memoryview]]:
    """All records of the data section, those within chunks included, in file order."""
    if data[:8] != MAGIC:
        raise ValueError("not an MCAP file")
    for at, code, body in records(data, 8):
        if code in (DATA_END, FOOTER):
            return
        if code == CHUNK:
            inner = unpacked(body, start_ns, end_ns)
            for k, c, b in records(inner) if inner is not None else ():
                yield at + k, c, memoryview(b)
        else:
            yield at, code, body


def _rows(path: str, data: bytes, what: int, topics: list[str] | None, start_ns: int | None, end_ns: int | None) -> Iterator[tuple]:
    schemas: dict[int, tuple[str, str, bytes]] = {}
    channels: dict[int, tuple] = {}
    for at, code, body in walk(data, start_ns, end_ns):
        f = Fields(body)
        if code == SCHEMA:
            number = f.number("H")
            schemas[number] = (f.text(), f.text(), f.raw())
        elif code == CHANNEL:
            number, schema = f.number("H"), schemas.get(f.number("H"), (None, None, None))
            if number not in channels:
                topic, encoding = f.text(), f.text()
                channels[number] = (number, topic, schema[0], schema[1], encoding)
                if what == CHANNEL and (topics is None or topic in topics):
                    yield (path, *channels[number], list(f.pairs().items()), schema[2])
        elif code == MESSAGE == what:
            own = channels[f.number("H")]
            sequence = f.number("I")
            log, publish = f.number("Q"), f.number("Q")
            if (topics is None or own[1] in topics) and (start_ns is None or log >= start_ns) and (end_ns is None or log < end_ns):
                yield (path, *own, at, sequence, log, publish, f.rest())
        elif code == METADATA == what:
            yield (path, at, f.text(), list(f.pairs().items()))
        elif code == ATTACHMENT == what:
            log, create = f.number("Q"), f.number("Q")
            yield (path, at, f.text(), f.text(), log, create, f.raw("Q"))


def _read(spark: SparkSession, paths: str | list[str], what: int, ddl: str, topics=None, start_ns=None, end_ns=None) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    fields = spark.createDataFrame([], ddl).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(fields)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                held, size = [], 0
                for row in _rows(path.as_py(), content.as_py(), what, topics, start_ns, end_ns):
                    held.append(row)
                    size += len(row[-1]) if isinstance(row[-1], bytes) else 0
                    if len(held) >= 1024 or size >= 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)

    return files.mapInArrow(over, ddl)


def messages(spark: SparkSession, paths, *, topics: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """A row per message; ``offset`` is its place in the file. Files of up to 2 GB."""
    return _read(spark, paths, MESSAGE, MESSAGES, topics, start_ns, end_ns)


def channels(spark: SparkSession, paths, *, topics: list[str] | None = None) -> DataFrame:
    """A row per channel; several channels may have one topic."""
    return _read(spark, paths, CHANNEL, CHANNELS, topics)


def metadata(spark: SparkSession, paths) -> DataFrame:
    """``(path, record, entries)``; of records of one name the last counts."""
    rows = _read(spark, paths, METADATA, METADATA_ROWS)
    return rows.groupBy("path", "record").agg(F.max_by("entries", "offset").alias("entries"))


def attachments(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, paths, ATTACHMENT, ATTACHMENTS).drop("offset")


def _text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack("<I", len(raw)) + raw


def _record(code: int, body: bytes) -> bytes:
    return struct.pack("<BQ", code, len(body)) + body


def _pairs(entries: dict[str, str]) -> bytes:
    raw = b"".join(_text(k) + _text(v) for k, v in sorted(entries.items()))
    return struct.pack("<I", len(raw)) + raw


def _chunked(group: list[tuple[int, int, int, int, bytes]], limit: int) -> Iterator[tuple[int, int, bytes, dict]]:
    """``(first, last, records, index)`` of chunks that are closed once they exceed ``limit`` bytes."""
    body, index, times = bytearray(), {}, []
    for channel, sequence, log, publish, data in group:
        index.setdefault(channel, []).append((log, len(body)))
        body += _record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log, publish) + data)
        times.append(log)
        if len(body) > limit:
            yield min(times), max(times), bytes(body), index
            body, index, times = bytearray(), {}, []
    if times:
        yield min(times), max(times), bytes(body), index


def _described(channels: list[dict]) -> tuple[bytes, int]:
    """Schema and channel records, and the number of schemas: channels share equal ones, and 0 is none."""
    numbers: dict[tuple, int] = {}
    out = b""
    for c in sorted(channels, key=lambda c: c["channel_id"]):
        schema = (c["schema_name"], c.get("schema_encoding") or "", c.get("schema_data") or b"")
        if c["schema_name"] is not None and schema not in numbers:
            numbers[schema] = len(numbers) + 1
            out += _record(SCHEMA, struct.pack("<H", numbers[schema]) + _text(schema[0]) + _text(schema[1]) + struct.pack("<I", len(schema[2])) + schema[2])
        out += _record(CHANNEL, struct.pack("<HH", c["channel_id"], numbers.get(schema, 0)) + _text(c["topic"]) + _text(c["message_encoding"] or "") + _pairs(dict(c.get("channel_metadata") or {})))
    return out, len(numbers)


class EpisodeFile:
    """One episode's file, written as its parts come: channels, then messages group by group in order of time, then the rest.

    No more than one chunk is held. ``sink`` takes bytes by ``write``.
    """

    def __init__(self, sink, limit: int = 800_000):
        self.sink, self.limit, self.at = sink, limit, 0
        self.hash = hashlib.sha256()
        self.described, self.schemas, self.channels = b"", 0, 0
        self.indexes, self.chunks, self.counts, self.other = b"", 0, {}, [0, 0]
        self.times: tuple[int, int] | None = None
        self.group: str | None = None
        self.held: list[tuple[int, int, int, int, bytes]] = []
        self.size = 0
        self._put(MAGIC + _record(HEADER, _text("") + _text("trailmark")))

    def _put(self, data: bytes) -> tuple[int, int]:
        start = self.at
        self.sink.write(data)
        self.hash.update(data)
        self.at += len(data)
        return start, len(data)

    def describe(self, channels: list[dict]) -> None:
        """Schemas and channels, with the fields of ``CHANNELS`` rows; before any message."""
        self.described, self.schemas = _described(channels)
        self.channels = len(channels)
        self._put(self.described)

    def message(self, group: str, channel: int, sequence: int, log: int, publish: int, data: bytes) -> None:
        if group != self.group:
            self._close()
            self.group = group
        self.held.append((channel, sequence, log, publish, data))
        self.size += 9 + 22 + len(data)
        self.counts[channel] = self.counts.get(channel, 0) + 1
        self.times = (log, log) if self.times is None else (min(self.times[0], log), max(self.times[1], log))
        if self.size > self.limit:
            self._close()

    def _close(self) -> None:
        """Writes the chunk that is held, its message indexes and, for later, its index."""
        for first, last, body, index in _chunked(self.held, 1 << 62):
            small = zstandard.ZstdCompressor().compress(body)
            start, length = self._put(_record(CHUNK, struct.pack("<QQQI", first, last, len(body), zlib.crc32(body)) + _text("zstd") + struct.pack("<Q", len(small)) + small))
            after, offsets = self.at, b""
            for channel, entries in sorted(index.items()):
                pairs = b"".join(struct.pack("<QQ", *e) for e in entries)
                at, _ = self._put(_record(MESSAGE_INDEX, struct.pack("<HI", channel, len(pairs)) + pairs))
                offsets += struct.pack("<HQ", channel, at)
            self.indexes += _record(CHUNK_INDEX, struct.pack("<QQQQI", first, last, start, length, len(offsets)) + offsets + struct.pack("<Q", self.at - after) + _text("zstd") + struct.pack("<QQ", len(small), len(body)))
            self.chunks += 1
        self.held, self.size = [], 0

    def attachment(self, x: dict) -> None:
        """One with the fields of an ``ATTACHMENTS`` row; after all messages."""
        self._close()
        data = x["data"] or b""
        body = struct.pack("<QQ", x["log_time_ns"], x["create_time_ns"]) + _text(x["name"]) + _text(x["media_type"]) + struct.pack("<Q", len(data)) + data
        start, length = self._put(_record(ATTACHMENT, body + struct.pack("<I", zlib.crc32(body))))
        self.indexes += _record(ATTACHMENT_INDEX, struct.pack("<QQQQQ", start, length, x["log_time_ns"], x["create_time_ns"], len(data)) + _text(x["name"]) + _text(x["media_type"]))
        self.other[0] += 1

    def metadata(self, name: str, entries: dict[str, str]) -> None:
        self._close()
        start, length = self._put(_record(METADATA, _text(name) + _pairs(entries)))
        self.indexes += _record(METADATA_INDEX, struct.pack("<QQ", start, length) + _text(name))
        self.other[1] += 1

    def finish(self) -> tuple[int, str]:
        """Writes the summary; the file's size and SHA-256."""
        self._close()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = self.at
        pairs = b"".join(struct.pack("<HQ", *x) for x in sorted(self.counts.items()))
        first, last = self.times or (0, 0)
        statistics = struct.pack("<QHIIIIQQI", sum(self.counts.values()), self.schemas, self.channels, *self.other, self.chunks, first, last, len(pairs)) + pairs
        summary = self.described + _record(STATISTICS, statistics) + self.indexes
        footer = struct.pack("<QQ", start, 0)
        crc = zlib.crc32(summary + struct.pack("<BQ", FOOTER, 20) + footer)
        self._put(summary + _record(FOOTER, footer + struct.pack("<I", crc)) + MAGIC)
        return self.at, self.hash.hexdigest()


def packed(channels: list[dict], rows: list[tuple[int, int, int, int, bytes]], groups: dict[str, str], metadata: dict[str, dict[str, str]], limit: int = 800_000, attachments: list[dict] = ()) -> bytes:
    """One episode's file: a stream of chunks per group of topics, indexes and a summary.

    ``channels`` have the fields of ``CHANNELS`` rows, ``attachments`` those of
    ``ATTACHMENTS`` rows; ``rows`` are (channel, sequence, log time, publish time, data) in order of time.
    """
    out = io.BytesIO()
    file = EpisodeFile(out, limit)
    file.describe(channels)
    topics = {c["channel_id"]: c["topic"] for c in channels}
    group = lambda row: groups.get(topics[row[0]], "state")
    for row in sorted(rows, key=group):
        file.message(group(row), *row)
    for x in attachments:
        file.attachment(x)
    for name, entries in sorted(metadata.items()):
        file.metadata(name, entries)
    file.finish()
    return out.getvalue()


def to_files(
    messages: DataFrame, *, channels: DataFrame | None = None, metadata: DataFrame | None = None, attachments: DataFrame | None = None, groups: dict[str, str] | None = None, limit: int = 800_000, key: str = "path"
) -> DataFrame:
    """``(key, content)``: each episode as one file, its messages by groups of topics.

    ``channels``, ``metadata`` and ``attachments`` are frames like those read here and
    are carried over whole, channels without messages included; without ``channels``
    the schemas have no data. ``groups`` names the group of topics; the others are
    ``state``. An episode is one task's work, as it is one file.
    """
    named = dict(groups or {})
    kind = dict(messages.dtypes)[key]
    held = None
    for label, frame in (("channels", channels), ("metadata", metadata), ("attachments", attachments)):
        if frame is None:
            continue
        rows = frame.groupBy(key).agg(F.collect_list(F.struct(*[c for c in frame.columns if c != key])).alias(label))
        held = rows if held is None else held.join(rows, key, "full")
    if held is None:
        held = messages.select(key).limit(0)

    def over(episode: pa.Table, other: pa.Table) -> pa.Table:
        rows = episode.sort_by([("log_time_ns", "ascending"), ("offset", "ascending")]).to_pylist()
        more = {k: v or [] for k, v in (other.to_pylist() or [{}])[0].items() if k != key}
        own = more.get("channels") or list({r["channel_id"]: r for r in rows}.values())
        records = {m["record"]: dict(m["entries"]) for m in more.get("metadata", [])}
        told = sorted(more.get("attachments", []), key=lambda x: (x["name"], x["log_time_ns"]))
        content = packed(own, [(r["channel_id"], r["sequence"], r["log_time_ns"], r["publish_time_ns"], r["data"]) for r in rows], named, records, limit, told)
        name = (episode if len(episode) else other)[key].slice(0, 1)
        return pa.table({key: name, "content": pa.array([content], pa.binary())})

    return messages.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(over, f"{key} {kind}, content binary")


def decoded_json(data: Column, ddl: str) -> Column:
    """A JSON message's fields; null for text that isn't JSON."""
    return F.from_json(data.cast("string"), ddl)
