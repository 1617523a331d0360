"""Channels: which are cameras, and what a caller's name for one means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .doctor import CAMERA_SCHEMAS


def cameras(channels: DataFrame) -> DataFrame:
    """Distinct camera topics of each recording."""
    return channels.where(F.col("schema_name").isin(*CAMERA_SCHEMAS)).select("path", "topic").distinct()


def ambiguous_topics(channels: DataFrame) -> DataFrame:
    """Topics that more than one channel of a recording has."""
    return channels.groupBy("path", "topic").agg(F.count("*").alias("n")).where("n > 1")


def topics(channels: DataFrame) -> DataFrame:
    """Channels by topic. A recording in which several channels have one topic can't be seen so: reading it is an error that names them."""
    by = channels.groupBy("path", "topic").agg(F.array_sort(F.collect_list("channel_id")).alias("ids"), F.min_by(F.struct(*[c for c in channels.columns if c not in ("path", "topic")]), "channel_id").alias("c"))
    told = F.concat(F.lit("several channels have the topic "), F.col("topic"), F.lit(": "), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit(" in "), F.col("path"))
    one = F.when(F.size("ids") > 1, F.raise_error(told)).otherwise(F.col("topic"))
    return by.select("path", one.alias("topic"), "c.*")


def channel(channels: DataFrame, wanted: int | str) -> DataFrame:
    """Each recording's channel of an id, or of a topic that only one channel has.

    Recordings that lack it have no row; several channels of the topic are an error.
    """
    if isinstance(wanted, int):
        return channels.where(F.col("channel_id") == wanted)
    return topics(channels.where(F.col("topic") == wanted)).select(*channels.columns)


def resolve(name: str, topics: list[str]) -> str:
    """The topic that is ``name``, or the only one that contains it."""
    if name in topics:
        return name
    found = [t for t in topics if name in t]
    if len(found) != 1:
        raise LookupError(f"{name!r} names {'no topic' if not found else 'several topics'}: {sorted(found or topics)}")
    return found[0]


def sizes(messages: DataFrame, *, bulk_bytes: int = 16_384, size: Column | None = None) -> DataFrame:
    """Messages, bytes and mean size of each topic, and the read group that it falls in; ``size`` is of a message's data."""
    size = F.length("data") if size is None else size
    by = messages.groupBy("topic").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.avg(size).alias("mean_bytes"))
    return by.withColumn("kind", F.when(F.col("mean_bytes") > bulk_bytes, "bulk").otherwise("state"))
