"""Tables as Arrow IPC files of equal numbers of rows, which training ranks map into memory.

Shards are contiguous in the given order. Spark finds the places of their ends and sorts
each shard's rows; a task streams them into a file. The marker of the write is the index: for each
file its first row, its number of rows, bytes and SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, LongType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from ..plans.views import shards
from . import indexed
from .canonical import published
from .datasource import PublishingWriter, Written, register

PLAIN = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType)


def plain(kind: DataType) -> bool:
    """Whether a column of this type is exported: a number, text, truth value, time, or numbers in a list."""
    return isinstance(kind, PLAIN) or isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)


class _Hashed:
    """A sink that counts and digests what goes through it."""

    def __init__(self, sink):
        self.sink, self.size, self.hash, self.closed = sink, 0, hashlib.sha256(), False

    def write(self, data) -> int:
        self.sink.write(data)
        self.hash.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.sink.close()


class ShardWriter(PublishingWriter):
    """Rows with ``_shard`` and ``_position`` in front, in order of both; a shard per file."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, now, sink, writer = [], None, None, None

        def finish() -> None:
            writer.close()
            sink.close()
            done.append((now["path"], f"shard-{now['shard']:06d}.arrow", {"first": now["first"], "rows": now["rows"], "bytes": sink.size, "sha256": sink.hash.hexdigest()}))

        try:
            for batch in iterator:
                numbers = batch.column(0).to_numpy()
                at = 0
                while at < len(numbers):
                    end = at + int((numbers[at:] != numbers[at]).argmax()) if (numbers[at:] != numbers[at]).any() else len(numbers)
                    part = pa.RecordBatch.from_arrays(batch.columns[2:], schema=pa.schema(list(batch.schema)[2:])).slice(at, end - at)
                    if now is None or now["shard"] != numbers[at]:
                        if now is not None:
                            finish()
                        system, path = self._new()
                        now = {"shard": int(numbers[at]), "path": path, "first": batch.column(1)[at].as_py(), "rows": 0}
                        sink = _Hashed(system.open_output_stream(path))
                        writer = pa.ipc.new_file(pa.PythonFile(sink, mode="w"), part.schema)
                    writer.write_batch(part)
                    now["rows"] += end - at
                    at = end
            if now is not None:
                finish()
        except BaseException:
            if sink is not None:
                sink.close()
            raise
        return Written(done)


class ShardSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def export(rows: DataFrame, path: str, order: list[str], count: int) -> dict[str, dict]:
    """Writes ``count`` shards of ``rows`` in ``order`` below ``path``; returns the index.

    Shards' counts are at most one apart; with fewer rows than shards some have no file. Nested
    columns are left out, but for lists of numbers. ``order`` should tell rows apart: equal ones
    are in any order. An existing export is refused.
    """
    kept = [f.name for f in rows.schema if plain(f.dataType)]
    if absent := [c for c in order if c not in kept]:
        raise ValueError(f"can't order by {absent}: no plain columns")
    register(rows.sparkSession, ShardSource)
    placed = shards(rows.select(*kept), order, count)
    placed = placed.select(F.col("shard").alias("_shard"), F.col("position").cast("bigint").alias("_position"), *kept)
    placed.repartition("_shard").sortWithinPartitions("_shard", "_position").write.format("arrow_shards").mode("append").save(path)
    return published(path)


def shard_of(path: str, rank: int) -> pa.Table:
    """A shard, mapped into memory where the file is local; without one, none of its rows."""
    files = published(path)
    name = f"shard-{rank:06d}.arrow"
    if name not in files:
        raise FileNotFoundError(f"{path} has no shard {rank}; there are {len(files)}")
    system, root, _ = indexed.located(path.rstrip("/"))
    local = system.type_name == "local"
    source = pa.memory_map(f"{root}/{name}") if local else system.open_input_file(f"{root}/{name}")
    return pa.ipc.open_file(source).read_all()


def channel_table(messages: DataFrame) -> DataFrame:
    """A channel's decoded messages as a flat table: ``log_time_ns`` and the plain fields of the struct ``decoded``."""
    fields = messages.schema["decoded"].dataType.fields
    return messages.select("log_time_ns", *[F.col("decoded")[f.name].alias(f.name) for f in fields if plain(f.dataType) and f.name != "log_time_ns"])


def read(spark: SparkSession, path: str, *, positions: bool = False) -> DataFrame:
    """An export as a DataFrame again, a task per shard; with ``positions`` each row's place in the order."""
    index = published(path)
    names = sorted(index)
    if not names:
        raise FileNotFoundError(f"{path} has no shards")
    from pyspark.sql.pandas.types import from_arrow_schema

    system, root, _ = indexed.located(path.rstrip("/"))
    with pa.ipc.open_file(system.open_input_file(f"{root}/{names[0]}")) as f:
        schema = from_arrow_schema(f.schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns)):
                system, root, _ = indexed.located(path.rstrip("/"))
                with pa.ipc.open_file(system.open_input_file(f"{root}/{name}")) as f:
                    for k in range(f.num_record_batches):
                        part = f.get_batch(k)
                        yield part.append_column("position", pa.array(range(at, at + len(part)), pa.int64())) if positions else part
                        at += len(part)

    shards_ = spark.createDataFrame([(n, index[n]["first"]) for n in names], "name string, first bigint").repartition(len(names))
    return shards_.mapInArrow(over, schema.add("position", LongType()) if positions else schema)
