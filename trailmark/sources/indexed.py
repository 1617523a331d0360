"""Recordings read by byte ranges: the summary first, then only what it says is wanted.

A task opens a file through pyarrow's file systems (local, s3, gs, hdfs with libhdfs), reads
the index at its end and then single chunks, records and attachments. No file is held whole.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs

from . import mcap
from .mcap import Fields

#: Bytes at the end of every file: the footer record and the magic.
TAIL = 9 + 20 + 8
BLOCK = 4 << 20
#: Schemes that pyarrow knows by another name.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def located(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a URI, the path within it, and what to put before paths to get URIs again."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        scheme, _, rest = uri.partition(":/")
        if not _ or scheme != "file":
            return fs.LocalFileSystem(), uri, ""
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    system, path = fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{rest}")
    return system, path, f"{scheme}://" + (rest[: rest.index("/")] if path.startswith("/") and "/" in rest else "")


def listed(uri: str) -> list[tuple[str, int]]:
    """``(uri, size)`` of a file, of the recordings in a folder and those below, or of a pattern's matches."""
    system, path, before = located(uri)
    if any(c in path for c in "*?["):
        whole = path[: min(path.index(c) for c in "*?[" if c in path)].rpartition("/")[0]
        infos = system.get_file_info(fs.FileSelector(whole or ".", recursive=True))
        infos = [i for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.path, path) and i.path.count("/") == path.count("/")]
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        infos = [info]
        if info.type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(path, recursive=True))
            hidden = lambda p: any(x[:1] in "._" for x in p[len(path) :].strip("/").split("/"))
            infos = [i for i in infos if i.type == fs.FileType.File and i.path.endswith(".mcap") and not hidden(i.path)]
    return sorted((before + i.path, i.size) for i in infos)


class Ranges:
    """A file of which parts are read; ``fetched`` counts reads and their bytes."""

    def __init__(self, uri: str):
        system, path, _ = located(uri)
        self.uri, self.file = uri, system.open_input_file(path)
        self.size = self.file.size()
        self.fetched = [0, 0]

    def read(self, at: int, n: int) -> bytes:
        self.fetched[0] += 1
        self.fetched[1] += n
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError(f"{self.uri} ends within a record")
        return data

    def record(self, at: int, length: int | None = None) -> tuple[int, memoryview, int]:
        """Opcode and content of the record at a place, and the place behind it."""
        if length is None:
            length = 9 + struct.unpack_from("<Q", self.read(at, 9), 1)[0]
        data = self.read(at, length)
        return data[0], memoryview(data)[9:], at + length

    def close(self) -> None:
        self.file.close()


@dataclass
class Chunk:
    first_ns: int
    last_ns: int
    offset: int
    length: int
    channels: tuple[int, ...]
    compression: str
    compressed: int
    size: int


@dataclass
class Index:
    """What a file's summary says."""

    channels: dict[int, dict] = field(default_factory=dict)
    #: Messages of each channel; None without statistics.
    counts: dict[int, int] | None = None
    messages: int | None = None
    chunks: list[Chunk] = field(default_factory=list)
    metadata: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, int]] = field(default_factory=list)


def index(file: Ranges) -> Index:
    """The index of a file; one that is damaged or without a summary is a ValueError."""
    if file.size < 8 + TAIL or file.read(0, 8) != mcap.MAGIC:
        raise ValueError(f"{file.uri} is not an MCAP file")
    tail = file.read(file.size - TAIL, TAIL)
    if tail[-8:] != mcap.MAGIC or tail[0] != mcap.FOOTER:
        raise ValueError(f"{file.uri} is cut off")
    (start,) = struct.unpack_from("<Q", tail, 9)
    if not start:
        raise ValueError(f"{file.uri} has no summary: it was cut off or written without an index")
    out, schemas = Index(), {}
    for _, code, body in mcap.records(file.read(start, file.size - TAIL - start)):
        f = Fields(body)
        if code == mcap.SCHEMA:
            number = f.number("H")
            schemas[number] = (f.text(), f.text(), f.raw())
        elif code == mcap.CHANNEL:
            number, schema = f.number("H"), f.number("H")
            name, encoding, data = schemas.get(schema, (None, None, None))
            out.channels[number] = {"channel_id": number, "topic": f.text(), "message_encoding": f.text(), "channel_metadata": f.pairs(), "schema_name": name, "schema_encoding": encoding, "schema_data": data}
        elif code == mcap.STATISTICS:
            out.messages = f.number("Q")
            f.at += struct.calcsize("<HIIIIQQ")
            end = f.number("I") + f.at
            out.counts = {}
            while f.at < end:
                number = f.number("H")
                out.counts[number] = f.number("Q")
        elif code == mcap.CHUNK_INDEX:
            first, last, at, length = (f.number("Q") for _ in range(4))
            end, own = f.number("I") + f.at, []
            while f.at < end:
                own.append(f.number("H"))
                f.number("Q")
            f.number("Q")
            out.chunks.append(Chunk(first, last, at, length, tuple(own), f.text(), f.number("Q"), f.number("Q")))
        elif code == mcap.METADATA_INDEX:
            out.metadata.append((f.number("Q"), f.number("Q")))
        elif code == mcap.ATTACHMENT_INDEX:
            out.attachments.append((f.number("Q"), f.number("Q")))
    out.chunks.sort(key=lambda c: c.offset)
    return out


@dataclass(frozen=True)
class Wanted:
    """Which messages are asked for: None is no limit; times are from ``start_ns`` and before ``end_ns``."""

    topics: frozenset[str] | None = None
    channel_ids: frozenset[int] | None = None
    start_ns: int | None = None
    end_ns: int | None = None

    def channel(self, c: dict) -> bool:
        return (self.topics is None or c["topic"] in self.topics) and (self.channel_ids is None or c["channel_id"] in self.channel_ids)

    def time(self, ns: int) -> bool:
        return (self.start_ns is None or ns >= self.start_ns) and (self.end_ns is None or ns < self.end_ns)

    def chunk(self, c: Chunk, channels: set[int]) -> bool:
        """Whether a chunk may hold such messages; one without message indexes may hold any."""
        late = self.start_ns is not None and c.last_ns < self.start_ns
        early = self.end_ns is not None and c.first_ns >= self.end_ns
        return not late and not early and (not c.channels or not channels.isdisjoint(c.channels))


def _loose(file: Ranges) -> Iterator[tuple[int, int, memoryview]]:
    """Records of the data section of a file without chunks, a block at a time."""
    at, held, start = 8, b"", 8
    while True:
        while at - start + 9 <= len(held):
            (n,) = struct.unpack_from("<Q", held, at - start + 1)
            if at - start + 9 + n > len(held):
                break
            code = held[at - start]
            if code in (mcap.DATA_END, mcap.FOOTER):
                return
            yield at, code, memoryview(held)[at - start + 9 : at - start + 9 + n]
            at += 9 + n
        held, start = held[at - start :], at
        more = min(max(BLOCK, 9 + (struct.unpack_from("<Q", held, 1)[0] if len(held) >= 9 else 0) - len(held)), file.size - start - len(held))
        if more <= 0:
            raise ValueError(f"{file.uri} ends within its data section")
        held += file.read(start + len(held), more)


def messages(file: Ranges, own: Index, wanted: Wanted, start: int = 0, end: int | None = None) -> Iterator[tuple[dict, int, int, int, int, memoryview]]:
    """``(channel, offset, sequence, log time, publish time, data)`` of wanted messages in chunks that begin in ``[start, end)``.

    ``offset`` is the place of the chunk plus that in its records, as in ``mcap.messages``. A
    file without chunks is read from its begin, all of it by the range that holds its begin.
    """
    channels = {number for number, c in own.channels.items() if wanted.channel(c)}
    if not channels:
        return
    if not own.chunks:
        parts = _loose(file) if start == 0 else ()
    else:
        asked = (c for c in own.chunks if start <= c.offset and (end is None or c.offset < end) and wanted.chunk(c, channels))
        parts = ((c.offset + k, code, body) for c in asked for k, code, body in mcap.records(mcap.unpacked(file.record(c.offset, c.length)[1])))
    head = struct.Struct("<HIQQ")
    for at, code, body in parts:
        if code == mcap.MESSAGE:
            number, sequence, log, publish = head.unpack_from(body)
            if number in channels and wanted.time(log):
                yield own.channels[number], at, sequence, log, publish, body[head.size :]


def metadata(file: Ranges, own: Index) -> dict[str, tuple[int, dict[str, str]]]:
    """``record: (offset, entries)``; of records of one name the last counts."""
    out = {}
    for at, length in sorted(own.metadata):
        f = Fields(file.record(at, length)[1])
        name = f.text()
        out[name] = (at, f.pairs())
    return out


def attachments(file: Ranges, own: Index) -> Iterator[dict]:
    for at, length in sorted(own.attachments):
        f = Fields(file.record(at, length)[1])
        log, create = f.number("Q"), f.number("Q")
        yield {"offset": at, "name": f.text(), "media_type": f.text(), "log_time_ns": log, "create_time_ns": create, "data": f.raw("Q")}
