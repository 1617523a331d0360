"""Files as rows without their content: lists to plan from, digests, and what channels they hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.doctor import CAMERA_SCHEMAS
from . import indexed

BLOCK = 8 << 20


def listing(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """``(path, size_bytes, modified)`` of files; Spark lists them and reads none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def digests(files: DataFrame, digits: int = 64) -> DataFrame:
    """``(path, digest)``: hex digits of each file's SHA-256, read in blocks by the task that has its row.

    With 16 digits of a canonical file this is the id of its episode.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at, _ = indexed.located(path)
                h = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while block := f.read(BLOCK):
                        h.update(block)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h.hexdigest()[:digits]])], names=["path", "digest"])

    return files.select("path").mapInArrow(over, "path string, digest string")


def published_artifacts(rows: DataFrame, root: str) -> DataFrame:
    """Copies the artifacts of ``rows(episode_id, check_name, check_version, artifacts)`` below ``root``.

    Gives ``(episode_id, check_name, name, uri, error)``. An artifact goes to a folder of its
    episode, step, version and name, so files of one name don't meet. One that can't be
    copied has an error and no URI: it is its step's failure, and the others go on. A task copies in blocks.
    """
    each = rows.select(F.col("episode_id").cast("string").alias("episode_id"), "check_name", "check_version", F.explode("artifacts").alias("name", "source"))
    short = lambda c: F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 8)
    key = F.concat_ws("/", F.lit("artifacts"), text.safe_topic(F.col("episode_id")), F.concat_ws("-", text.safe_topic(F.col("check_name")), "check_version"), F.concat_ws("-", text.safe_topic(F.col("name")), short("name")), F.regexp_extract("source", "([^/]*)$", 1))
    base = root.rstrip("/")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, key in zip(batch.column("source").to_pylist(), batch.column("key").to_pylist()):
                try:
                    system, at, _ = indexed.located(source)
                    target, to, _ = indexed.located(f"{base}/{key}")
                    with system.open_input_stream(at) as f:
                        target.create_dir(to.rpartition("/")[0], recursive=True)
                        with target.open_output_stream(to) as g:
                            while block := f.read(BLOCK):
                                g.write(block)
                    out.append((f"{base}/{key}", None))
                except (OSError, ValueError) as e:
                    out.append((None, f"{type(e).__name__}: {e}".split("\n")[0][:500]))
            columns = [batch.column(c) for c in ("episode_id", "check_name", "name")] + [pa.array([x[k] for x in out], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["episode_id", "check_name", "name", "uri", "error"])

    return each.withColumn("key", key).mapInArrow(over, "episode_id string, check_name string, name string, uri string, error string")


def name_of(path: str = "path"):
    """A path in the one form that listings and recordings' tables share."""
    return F.regexp_replace(path, r"^file:/+", "file:///")


def with_cameras(files: DataFrame, channels: DataFrame) -> DataFrame:
    """Those files that have a camera channel: media steps then open no others."""
    seen = channels.where(F.col("schema_name").isin(*CAMERA_SCHEMAS)).select(name_of().alias("_seen")).distinct()
    return files.join(seen, name_of() == F.col("_seen"), "left_semi")
