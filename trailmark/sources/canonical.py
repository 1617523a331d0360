"""Canonical episodes: recordings rewritten by groups of topics, with provenance.

The rewrite is one sort of all rows by episode, kind, group and time; the sink streams each
episode's rows into its file.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.doctor import CAMERA_SCHEMAS, EPISODE, PROVENANCE
from . import indexed
from .datasource import PUBLISHED, ROWS, register, scan

# Fixed values of the format: keys of the provenance record, the schema of derived topics, names of groups.
SCHEMA_VERSION = "1"
RESAMPLE_POLICY = "1"
DERIVED_SCHEMA = "derived/v1"
DERIVED_PREFIX = "derived/"
NOT_USED = "not-used"
CAMERA_GROUP, STATE_GROUP = "cameras", "state"
RAW_IMAGES = ("sensor_msgs/msg/Image", "foxglove.RawImage")


@dataclass(frozen=True)
class Stamps:
    """Versions that a canonical episode names."""

    schema_version: str
    pipeline_version: str
    ffmpeg_version: str
    robot_software_version: str | None


def merged(metadata: DataFrame, *, key: str = "path") -> DataFrame:
    """``(key, metadata)``: the entries of an episode's own record, then of its provenance, which wins where both name a key.

    Records of other names are left out; of records of one name the last counts. Recordings
    with neither have no row.
    """
    own = metadata.where(F.col("record").isin(EPISODE, PROVENANCE))
    last = own.groupBy(key, "record").agg(F.max_by("entries", "offset").alias("entries"))
    by = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("record", "entries"))).alias("m"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    first, second = (F.coalesce(F.try_element_at("m", F.lit(r)), none) for r in (EPISODE, PROVENANCE))
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return by.select(key, F.map_concat(kept, second).alias("metadata"))


def stamps(metadata: Mapping[str, str]) -> Stamps:
    """The stamps in an episode's merged metadata; a recording that isn't canonical lacks them and is refused."""
    absent = [k for k in ("schema_version", "pipeline_version", "ffmpeg_version") if k not in metadata]
    if absent:
        raise ValueError(f"not a canonical episode: its metadata lacks {', '.join(absent)}")
    return Stamps(metadata["schema_version"], metadata["pipeline_version"], metadata["ffmpeg_version"], metadata.get("robot_software_version"))


def stamp_columns(merged_metadata: DataFrame) -> DataFrame:
    """The stamps as columns; reading a row that lacks one is an error that names it."""
    one = lambda k: F.try_element_at("metadata", F.lit(k))
    needed = [F.coalesce(one(k), F.raise_error(F.concat(F.lit(f"not a canonical episode, its metadata lacks {k}: "), F.col(merged_metadata.columns[0])))).alias(k) for k in ("schema_version", "pipeline_version", "ffmpeg_version")]
    return merged_metadata.select(merged_metadata.columns[0], *needed, one("robot_software_version").alias("robot_software_version"))


def rows(
    tables: Mapping[str, DataFrame], *, pipeline_version: str, groups: Mapping[str, str] | None = None, derived: DataFrame | None = None, derived_versions: Mapping[str, str] | None = None, extra: Mapping[str, str] | None = None
) -> DataFrame:
    """``datasource.ROWS`` of canonical episodes from ``tables`` of ``format("mcap")``, unordered.

    Messages keep all their bytes and times, channels their schemas or the lack of one;
    metadata and attachments are carried over, the provenance record is replaced. Topics of
    camera schemas are one group, all others another; ``groups`` names that of single topics.
    ``derived(path, topic, log_time_ns, data)`` are messages of new topics in JSON; a topic
    that a recording has already, and raw images, are errors.
    """
    versions = dict(derived_versions or {})
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.mcap)?$", 1)
    name = F.concat(text.artifact_folder(stem, F.col("path")), F.lit(".mcap")).alias("episode")
    channels = tables["channels"]
    known = channels.select("path", F.explode(F.array(*map(F.lit, versions)) if versions else F.array().cast("array<string>")).alias("topic")).distinct()
    made = known.withColumns({"channel_id": -F.element_at(F.create_map(*[x for k, t in enumerate(sorted(versions)) for x in (F.lit(t), F.lit(k + 1))]), F.col("topic")), "schema_name": F.lit(DERIVED_SCHEMA), "schema_encoding": F.lit("jsonschema"), "message_encoding": F.lit("json"), "schema_data": F.lit(json.dumps({"type": "object"}).encode())}) if versions else None
    refused = F.when(F.col("schema_name").isin(*RAW_IMAGES), F.raise_error(F.concat(F.lit("raw images can't be made canonical: "), F.col("topic"))).cast("int"))
    if versions:
        refused = refused.when(F.col("topic").isin(*versions), F.raise_error(F.concat(F.lit("a derived topic is in the recording already: "), F.col("topic"))).cast("int"))
    parts = [channels.withColumn("channel_id", F.coalesce(refused, F.col("channel_id"))).withColumn("kind", F.lit(0))]
    if made is not None:
        parts.append(made.withColumn("kind", F.lit(0)))
    group = F.when(F.col("schema_name").isin(*CAMERA_SCHEMAS), CAMERA_GROUP).otherwise(STATE_GROUP)
    for topic, named in sorted((groups or {}).items()):
        group = F.when(F.col("topic") == topic, F.lit(named)).otherwise(group)
    parts.append(tables["messages"].withColumns({"kind": F.lit(1), "message_group": group}))
    if derived is not None:
        number = F.element_at(F.create_map(*[x for k, t in enumerate(sorted(versions)) for x in (F.lit(t), F.lit(-k - 1))]), F.col("topic"))
        plain = derived.select("path", "topic", "log_time_ns", F.col("log_time_ns").alias("publish_time_ns"), F.col("data").cast("binary").alias("data"), number.alias("channel_id"), F.lit(None).cast("string").alias("schema_name"))
        parts.append(plain.withColumns({"kind": F.lit(1), "message_group": group}))
    parts.append(tables["attachments"].withColumn("kind", F.lit(2)))
    parts.append(tables["metadata"].where(F.col("record") != PROVENANCE).select("path", "entries", F.col("record").alias("name"), F.lit(3).alias("kind")))
    told = {"schema_version": SCHEMA_VERSION, "pipeline_version": pipeline_version, "ffmpeg_version": NOT_USED} | dict(extra or {})
    if versions:
        told |= {"resample_policy_version": RESAMPLE_POLICY} | {f"{DERIVED_PREFIX}{t}": v for t, v in versions.items()}
    entries = F.create_map(*[x for k, v in sorted(told.items()) for x in (F.lit(k), F.lit(v))], F.lit("source_uri"), F.col("path"))
    parts.append(channels.select("path").distinct().select("path", entries.alias("entries"), F.lit(PROVENANCE).alias("name"), F.lit(3).alias("kind")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c.split() for c in ROWS.split(", ")]
    place = [F.col("offset") if "offset" in whole.columns else F.lit(None).cast("bigint").alias("offset")]
    return whole.select(name, *[F.col(c).cast(t).alias(c) if c in whole.columns else F.lit(None).cast(t).alias(c) for c, t in columns if c != "episode"], *place)


def write(unordered: DataFrame, path: str, *, chunk_bytes: int = 800_000, overwrite: bool = False, tasks: int | None = None) -> None:
    """Writes ``rows`` as files below ``path``, each named by its source's stem and a digest of its whole path.

    An episode is one task's stream and never held whole: Spark sorts, and spills where it
    has to. Files that are there already are refused unless they are to be replaced.
    """
    register(unordered.sparkSession)
    dealt = unordered.repartition(tasks, "episode") if tasks else unordered.repartition("episode")
    ordered = dealt.sortWithinPartitions("episode", "kind", "message_group", "log_time_ns", F.col("offset").asc_nulls_last(), "channel_id", "name")
    writer = ordered.drop("offset").write.format("mcap").mode("overwrite" if overwrite else "append").option("chunkBytes", chunk_bytes)
    writer.save(path)


def read(spark: SparkSession, paths: str | list[str], **limits) -> dict[str, DataFrame]:
    """All tables of recordings; ``limits`` are those of ``datasource.scan`` and hold for messages."""
    every = {k: v for k, v in limits.items() if k == "split_bytes"}
    return {t: scan(spark, paths, t, **(limits if t == "messages" else every)) for t in ("messages", "channels", "metadata", "attachments")}


def unpublish(path: str) -> None:
    """Takes the marker away: what lies below ``path`` isn't whole until the next write has ended."""
    system, root, _ = indexed.located(path.rstrip("/"))
    if system.get_file_info(f"{root}/{PUBLISHED}").type.name != "NotFound":
        system.delete_file(f"{root}/{PUBLISHED}")


def published(path: str) -> dict[str, dict]:
    """Files that the last write published below ``path``: name to bytes and SHA-256.

    A folder without the marker, or in which a file that it names is absent or of another
    size, isn't whole and is refused.
    """
    system, root, _ = indexed.located(path.rstrip("/"))
    if system.get_file_info(f"{root}/{PUBLISHED}").type.name == "NotFound":
        raise FileNotFoundError(f"{path} has no marker of a finished write")
    with system.open_input_stream(f"{root}/{PUBLISHED}") as f:
        files = json.loads(f.read())["files"]
    sizes = {i.path: i.size for i in system.get_file_info([f"{root}/{n}" for n in files])} if files else {}
    if wrong := sorted(n for n, x in files.items() if sizes.get(f"{root}/{n}") != x["bytes"]):
        raise ValueError(f"{path} isn't whole: {wrong[:3]} are absent or changed")
    return files
