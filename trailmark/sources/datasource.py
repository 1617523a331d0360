"""``spark.read.format("mcap")`` and ``df.write.format("mcap")``.

Reading: the option ``table`` names what a row is (``messages``, ``channels``, ``metadata``,
``attachments`` or ``chunks``). Planning lists files and their sizes; large files are cut
into byte ranges and small ones packed together. A task reads a file's index and then the
chunks that begin in its range, if topic, channel and time say that they may matter: as
limits given to ``scan``, or as filters of the query where the option ``pushFilters`` asks
for that. A schema with fewer columns is fine.

Spark 4.1 keeps pushed filters with the loaded table: a DataFrame that is used twice, once
with a filter, has it both times. So they are off by default, and a DataFrame loaded with
``pushFilters`` is for one filtered use; limits given to ``scan`` have no such trap.

Writing takes ``ROWS``, an episode's rows together and in order (``canonical.write`` makes
them so), and streams each episode into a file of its own. Files appear under their names
only when all tasks have succeeded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from . import indexed, mcap
from .indexed import Wanted

TABLES = {
    "messages": mcap.MESSAGES,
    "channels": f"{mcap.CHANNELS}, message_count bigint, has_schema boolean",
    "metadata": mcap.METADATA_ROWS,
    "attachments": mcap.ATTACHMENTS,
    "chunks": "path string, offset bigint, length bigint, first_ns bigint, last_ns bigint, compression string, compressed_bytes bigint, bytes bigint, channel_ids array<int>",
}
#: Rows of the writer, in this order within an episode: channels, messages by group and time, attachments, metadata.
KINDS = ("channel", "message", "attachment", "metadata")
ROWS = (
    "episode string, kind int, message_group string, channel_id int, topic string, schema_name string, schema_encoding string, message_encoding string, channel_metadata map<string,string>, schema_data binary, "
    "sequence bigint, log_time_ns bigint, publish_time_ns bigint, data binary, name string, media_type string, create_time_ns bigint, entries map<string,string>"
)
PUBLISHED = "_published.json"
SPLIT_BYTES = 128 << 20
#: What opening a file counts for when small ones are packed.
OPEN_BYTES = 4 << 20
BATCH_ROWS = 1_024
BATCH_BYTES = 32 << 20


def register(spark: SparkSession, source: type[ds.DataSource] | None = None) -> None:
    """Makes the format (or another source) known to a session, and to the thread's active one, where Spark looks names up."""
    active = SparkSession.getActiveSession()
    for session in (spark, active) if active is not None else (spark,):
        session.dataSource.register(source or McapSource)


def scan(
    spark: SparkSession, paths: str | list[str], table: str = "messages", *, topics: Iterable[str] | None = None, channel_ids: Iterable[int] | None = None, start_ns: int | None = None, end_ns: int | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """A table of recordings, within limits that intersect; times are from ``start_ns`` and before ``end_ns``."""
    register(spark)
    limits = {"topic": topics and sorted(topics), "channel_id": channel_ids and sorted(channel_ids), "start": start_ns, "end": end_ns}
    if topics is not None and not topics:
        limits["topic"] = []
    if channel_ids is not None and not channel_ids:
        limits["channel_id"] = []
    reader = spark.read.format("mcap").option("table", table).option("splitBytes", split_bytes).option("limits", json.dumps({k: v for k, v in limits.items() if v is not None}))
    return reader.option("uris", json.dumps([paths] if isinstance(paths, str) else list(paths))).load()


def names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


@dataclass
class Split(ds.InputPartition):
    """Byte ranges of files, (uri, first, end): one of a large file, or whole small files."""

    files: tuple[tuple[str, int, int], ...]


def splits(files: list[tuple[str, int]], most: int, cut: bool) -> list[Split]:
    """Ranges of up to ``most`` bytes, files below that packed; without ``cut`` a file stays whole."""
    out: list[Split] = []
    held: list[tuple[str, int, int]] = []
    filled = 0
    for uri, size in sorted(files, key=lambda x: (-x[1], x[0])):
        if cut and size > most:
            out += [Split(((uri, at, min(size, at + most)),)) for at in range(0, size, most)]
            continue
        if held and filled + size + OPEN_BYTES > most:
            out.append(Split(tuple(held)))
            held, filled = [], 0
        held.append((uri, 0, size))
        filled += size + OPEN_BYTES
    return out + ([Split(tuple(held))] if held else [])


def pushed(filters: Iterable[ds.Filter], names: dict[str, str]) -> tuple[dict, list[ds.Filter]]:
    """Limits from filters on the columns ``names`` (column: its kind), and the filters that stay with Spark."""
    limits: dict = {}
    rest = []

    def narrow(key: str, values: frozenset) -> None:
        limits[key] = limits[key] & values if key in limits else values

    for f in filters:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        kind = names.get(column)
        value = getattr(f, "value", None)
        if kind and isinstance(f, ds.IsNotNull):
            continue  # these columns are never null
        if kind == "set" and isinstance(f, ds.EqualTo) and value is not None:
            narrow(column, frozenset([value]))
        elif kind == "set" and isinstance(f, ds.In):
            narrow(column, frozenset(v for v in value if v is not None))
        elif kind == "range" and isinstance(value, int) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
            if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                first = value + isinstance(f, ds.GreaterThan)
                limits["start"] = max(limits.get("start", first), first)
            if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                end = value + (not isinstance(f, ds.LessThan))
                limits["end"] = min(limits.get("end", end), end)
        else:
            rest.append(f)
    return limits, rest


class McapReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.table = options.get("table", "messages")
        several = options.get("uris") or options.get("paths")
        self.uris = json.loads(several) if several else [options["path"]]
        self.most = int(options.get("splitBytes", SPLIT_BYTES))
        self.schema = schema
        self.limits = {k: frozenset(v) if isinstance(v, list) else v for k, v in json.loads(options.get("limits", "{}")).items()}

    def partitions(self) -> list[Split]:
        files = [f for uri in self.uris for f in indexed.listed(uri)]
        return splits(files, self.most, cut=self.table == "messages") or [Split(())]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, names = to_arrow_schema(self.schema), names_of(TABLES[self.table])
        if unknown := set(kind.names) - set(names):
            raise ValueError(f"{self.table} have no columns {sorted(unknown)}")
        kept = [names.index(c) for c in kind.names]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) for k, f in zip(kept, kind)], schema=kind)

        for uri, start, end in partition.files:
            file = indexed.Ranges(uri)
            try:
                for row in self.rows(file, start, end):
                    held.append(row)
                    size += len(row[-1]) if isinstance(row[-1], bytes) else 0
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
            finally:
                file.close()
        if held:
            yield batch()

    def rows(self, file: indexed.Ranges, start: int, end: int) -> Iterator[tuple]:
        """Rows of the table from a range of a file."""
        own = indexed.index(file)
        wanted = Wanted(self.limits.get("topic"), self.limits.get("channel_id"), self.limits.get("start"), self.limits.get("end"))
        if self.table == "messages":
            for c, at, sequence, log, publish, data in indexed.messages(file, own, wanted, start, end):
                yield (file.uri, c["channel_id"], c["topic"], c["schema_name"], c["schema_encoding"], c["message_encoding"], at, sequence, log, publish, bytes(data))
        elif self.table == "channels":
            for c in own.channels.values():
                if wanted.channel(c):
                    count = None if own.counts is None else own.counts.get(c["channel_id"], 0)
                    yield (file.uri, c["channel_id"], c["topic"], c["schema_name"], c["schema_encoding"], c["message_encoding"], list(c["channel_metadata"].items()), c["schema_data"], count, c["schema_name"] is not None)
        elif self.table == "metadata":
            for record, (at, entries) in indexed.metadata(file, own).items():
                yield (file.uri, at, record, list(entries.items()))
        elif self.table == "attachments":
            for x in indexed.attachments(file, own):
                yield (file.uri, x["offset"], x["name"], x["media_type"], x["log_time_ns"], x["create_time_ns"], x["data"])
        else:
            for c in own.chunks:
                yield (file.uri, c.offset, c.length, c.first_ns, c.last_ns, c.compression, c.compressed, c.size, list(c.channels))


class PushingReader(McapReader):
    """One that takes the query's filters, for a table that is used once."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        names = {"messages": {"topic": "set", "channel_id": "set", "log_time_ns": "range"}, "channels": {"topic": "set", "channel_id": "set"}}.get(self.table, {})
        found, rest = pushed(filters, names)
        for k, v in found.items():
            own = self.limits.get(k, v)
            self.limits[k] = own & v if isinstance(v, frozenset) else max(own, v) if k == "start" else min(own, v)
        return rest


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of a task: (temporary path, name, what the marker tells of it)."""

    files: list[tuple[str, str, dict]]


class PublishingWriter(ds.DataSourceArrowWriter):
    """Tasks write files to a folder of this job; the commit moves them to their names, writes the marker last and removes the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def _at(self, *names: str):
        system, path, _ = indexed.located("/".join((self.uri, *names)))
        return system, path

    def _new(self):
        """A file system and the path of a new temporary file."""
        system, folder = self._at(self.job)
        system.create_dir(folder, recursive=True)
        return system, f"{folder}/{uuid.uuid4().hex}"

    def commit(self, messages: list[Written | None]) -> None:
        """Moves all files to their names, or none if two have one name or one is there and not to be replaced."""
        files = [f for m in messages if m for f in m.files]
        system, root = self._at()
        system.create_dir(root, recursive=True)
        try:
            names = [name for _, name, _ in files]
            if len(set(names)) != len(names):
                raise ValueError(f"files that aren't in one piece: {sorted({n for n in names if names.count(n) > 1})}")
            there = {i.path for i in system.get_file_info([f"{root}/{n}" for n in names]) if i.type.name != "NotFound"} if names else set()
            if there and not self.overwrite:
                raise FileExistsError(f"{sorted(there)[:3]} and {max(0, len(there) - 3)} more are there already")
            marker = f"{root}/{PUBLISHED}"
            known = {}
            if system.get_file_info(marker).type.name != "NotFound":
                with system.open_input_stream(marker) as f:
                    known = json.loads(f.read())["files"]
                system.delete_file(marker)  # until all files are there, the folder isn't whole
            for temporary, name, told in files:
                system.move(temporary, f"{root}/{name}")
                known[name] = told
            with system.open_output_stream(marker) as f:
                f.write(json.dumps({"files": known}, sort_keys=True).encode())
        finally:
            self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, folder = self._at(self.job)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class McapWriter(PublishingWriter):
    """An episode per file."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if schema.fieldNames() != names_of(ROWS):
            raise ValueError("rows to write must have the columns of datasource.ROWS in their order")
        super().__init__(options, overwrite)
        self.limit = int(options.get("chunkBytes", 800_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str, dict]] = []
        now = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if now is None or row["episode"] != now.name:
                        if now:
                            done.append(now.finish())
                        now = _Episode(row["episode"], *self._new(), self.limit)
                    now.add(row)
            if now:
                done.append(now.finish())
        except BaseException:
            if now:
                now.sink.close()
            raise
        return Written(done)


class _Episode:
    """A file while its rows come."""

    def __init__(self, name: str, system, path: str, limit: int):
        from ..operators.frames import video_fault

        self.name, self.path, self.fault = name, path, video_fault
        self.sink = system.open_output_stream(path)
        self.file = mcap.EpisodeFile(self.sink, limit)
        self.channels: list[dict] = []
        self.numbers: dict[int, int] | None = None
        self.at = 0

    def _described(self) -> None:
        if self.numbers is None:
            self.channels.sort(key=lambda c: (c["topic"], c["channel_id"]))
            self.numbers = {c["channel_id"]: k + 1 for k, c in enumerate(self.channels)}
            self.schemas = {c["channel_id"]: (c["schema_name"], c["message_encoding"], c["topic"]) for c in self.channels}
            self.file.describe([{**c, "channel_id": k + 1} for k, c in enumerate(self.channels)])

    def add(self, row: dict) -> None:
        kind = KINDS[row["kind"]]
        if row["kind"] < self.at:
            raise ValueError(f"the rows of {self.name} aren't in order")
        self.at = row["kind"]
        if kind == "channel":
            self.channels.append(row)
            return
        self._described()
        if kind == "message":
            schema, encoding, topic = self.schemas[row["channel_id"]]
            if fault := self.fault(schema, encoding, row["data"] or b""):
                raise ValueError(f"{self.name}: a message on {topic} isn't canonical video ({fault[0]}: {fault[1]})")
            self.file.message(row["message_group"], self.numbers[row["channel_id"]], row["sequence"] or 0, row["log_time_ns"], row["publish_time_ns"], row["data"] or b"")
        elif kind == "attachment":
            self.file.attachment(row)
        else:
            self.file.metadata(row["name"], dict(row["entries"] or {}))

    def finish(self) -> tuple[str, str, dict]:
        self._described()
        size, digest = self.file.finish()
        self.sink.close()
        return self.path, self.name, {"bytes": size, "sha256": digest}


class McapSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        table = self.options.get("table", "messages")
        if table not in TABLES:
            raise ValueError(f"no table {table!r} in a recording; there are {sorted(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> McapReader:
        asked = str(self.options.get("pushFilters", "")).lower() == "true"
        return (PushingReader if asked else McapReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> McapWriter:
        return McapWriter(self.options, schema, overwrite)
