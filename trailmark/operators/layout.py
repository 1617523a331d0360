"""What a layout of recordings costs to read: seeded windows, and the chunks that they touch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts of topics in groups of chunks: each alone, all together, or cameras apart from the rest.
LAYOUTS = ("per-topic", "interleaved", "groups")
SECOND = 1_000_000_000


def groups(layout: str, topics: Iterable[str], cameras: Iterable[str]) -> dict[str, str]:
    """Group of each topic in a layout, as ``canonical.rows`` takes it."""
    if layout not in LAYOUTS:
        raise ValueError(f"no layout {layout!r}; there are {LAYOUTS}")
    seen = set(cameras)
    return {t: t if layout == "per-topic" else "all" if layout == "interleaved" else "cameras" if t in seen else "state" for t in topics}


def windows(ends: DataFrame, count: int, seconds: float, *, seed: int = 0, key: str = "path") -> DataFrame:
    """``(key, sample, start_ns, end_ns)``: ``count`` windows of each recording in ``ends(key, first_ns, last_ns)``.

    Their places come from a hash of the seed, the key and the sample's number, so they are
    the same in every run and for every layout. A recording shorter than a window has windows
    that begin where it begins.
    """
    length = int(seconds * SECOND)
    each = ends.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "sample").cast("binary"))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    room = F.greatest(F.lit(0), F.col("last_ns") - F.col("first_ns") - length)
    start = F.col("first_ns") + F.floor(share * (room + 1)).cast("bigint")
    return each.select(key, "sample", start.alias("start_ns"), (start + length).alias("end_ns"))


def read_cost(chunks: DataFrame, windows_: DataFrame, *, key: str = "path", wanted: Column | None = None, width_ns: int = 10 * SECOND) -> DataFrame:
    """``(key, sample, fetches, bytes)``: chunks that each window touches, and their compressed bytes.

    ``chunks(key, first_ns, last_ns, compressed_bytes, ...)``; ``wanted`` says which of them hold
    what is read. A range join made an equi-join: chunks and windows name the stretches of
    ``width_ns`` that they overlap, and a pair counts in the first that they share. Windows that touch nothing cost 0.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(width_ns)).cast("bigint")
    spread = lambda frame, a, b: frame.withColumn("_slot", F.explode(F.sequence(at(a), at(b))))
    held = chunks if wanted is None else chunks.where(wanted)
    held = spread(held.select(key, "first_ns", "last_ns", "compressed_bytes"), "first_ns", "last_ns")
    asked = spread(windows_.select(key, "sample", "start_ns", "end_ns"), "start_ns", "end_ns")
    met = asked.join(held, [key, "_slot"]).where((F.col("first_ns") <= F.col("end_ns")) & (F.col("last_ns") >= F.col("start_ns")) & (F.col("_slot") == F.greatest(at("first_ns"), at("start_ns"))))
    cost = met.groupBy(key, "sample").agg(F.count("*").alias("fetches"), F.sum("compressed_bytes").alias("bytes"))
    none = F.lit(0).cast("bigint")
    return windows_.select(key, "sample").join(cost, [key, "sample"], "left").select(key, "sample", F.coalesce("fetches", none).alias("fetches"), F.coalesce("bytes", none).alias("bytes"))


def storage(chunks: DataFrame, *, key: str = "path") -> DataFrame:
    """``(key, chunks, bytes, compressed_bytes, ratio)`` of each recording."""
    sums = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    return sums.withColumn("ratio", F.try_divide(F.col("compressed_bytes").cast("double"), F.col("bytes").cast("double")))
