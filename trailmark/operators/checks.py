"""Built-in checks: evidence about episodes from their messages, as DataFrames.

Each takes ``messages(episode_id, topic, log_time_ns, seq, value, ...)`` and gives a row
per stream or episode, or intervals. ``value`` is a number or a vector. All but the digest
stays in built-in expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import STREAM, islands, speed, steps


def declared_period(expected_hz: float | Mapping[str, float] | None) -> Column:
    """Seconds between messages by the rate that is declared, for all topics or by topic; null without one, or one of 0."""
    if isinstance(expected_hz, Mapping):
        pairs = [x for topic, hz in sorted(expected_hz.items()) if hz for x in (F.lit(topic), F.lit(1.0 / hz))]
        return F.try_element_at(F.create_map(*pairs), F.col("topic")) if pairs else F.lit(None).cast("double")
    return F.lit(1.0 / expected_hz if expected_hz else None).cast("double")


def regularity(messages: DataFrame, *, expected_hz: float | Mapping[str, float] | None = None, tolerance_s: float = 0.010) -> DataFrame:
    """Median step, share of steps off the period, and largest gap of each stream.

    The period is that of the declared rate, or the stream's median step without one.
    Streams of fewer than two messages have only their count.
    """
    dt = steps(messages)
    shape = dt.groupBy(*STREAM).agg(F.count("*").alias("message_count"), F.median("dt_s").alias("median_dt_s"), F.max("dt_s").alias("max_gap_s"))
    period = F.coalesce(declared_period(expected_hz), F.col("median_dt_s"))
    off = dt.join(shape, list(STREAM)).where("dt_s is not null").groupBy(*STREAM).agg(F.avg(F.when(F.abs(F.col("dt_s") - period) > tolerance_s, F.lit(100.0)).otherwise(F.lit(0.0))).alias("violation_pct"))
    return shape.join(off, list(STREAM), "left")


def gaps(messages: DataFrame, *, expected_hz: float | Mapping[str, float] | None = None, gap_factor: float = 3.0) -> DataFrame:
    """Steps longer than ``gap_factor`` periods, as intervals labelled ``gap:<topic>``."""
    dt = steps(messages)
    period = F.coalesce(declared_period(expected_hz), F.col("median_dt_s"))
    median = dt.groupBy(*STREAM).agg(F.median("dt_s").alias("median_dt_s"))
    long = dt.join(median, list(STREAM)).where(F.col("dt_s") > gap_factor * period)
    return long.select(*STREAM, F.concat(F.lit("gap:"), F.col("topic")).alias("label"), F.col("prev_ns").alias("start_ns"), F.col("log_time_ns").alias("end_ns"))


def sync_offsets(messages: DataFrame, camera: Column) -> DataFrame:
    """Offset of each camera's first and last message from the densest other stream's.

    ``camera`` says which topics are cameras. Equal densities go to the topic that sorts
    first. Episodes without another stream have no rows.
    """
    ends = messages.groupBy(*STREAM).agg(F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"), F.count("*").alias("n"))
    densest = Window.partitionBy("episode_id").orderBy(F.desc("n"), "topic")
    reference = ends.where(~camera).withColumn("place", F.row_number().over(densest)).where("place = 1")
    reference = reference.select("episode_id", F.col("topic").alias("reference"), F.col("first_ns").alias("ref_first"), F.col("last_ns").alias("ref_last"))
    seconds = lambda a, b: (F.col(a) - F.col(b)) / F.lit(1e9)
    return ends.where(camera).join(reference, "episode_id").select("episode_id", "topic", "reference", seconds("first_ns", "ref_first").alias("start_offset_s"), seconds("last_ns", "ref_last").alias("end_offset_s"))


def discontinuity(messages: DataFrame, *, velocity_limit: float) -> DataFrame:
    """Steps faster than the limit, and steps on which time doesn't advance, by stream."""
    fast = F.coalesce(F.col("speed") > velocity_limit, F.lit(False))
    return speed(steps(messages)).where("prev_ns is not null").groupBy(*STREAM).agg(
        F.max("speed").alias("max_abs_velocity"),
        F.sum(fast.cast("bigint")).alias("violation_count"),
        F.avg(F.when(fast, F.lit(100.0)).otherwise(F.lit(0.0))).alias("violation_pct"),
        F.sum((F.col("dt_s") <= 0).cast("bigint")).alias("nonpositive_dt_count"),
    )


def discontinuity_runs(messages: DataFrame, *, velocity_limit: float) -> DataFrame:
    return islands(speed(steps(messages)), F.col("speed") > velocity_limit, "joint_discontinuity")


def frame_deficit(messages: DataFrame, *, expected_hz: float | Mapping[str, float] | None = None) -> DataFrame:
    """Frames that a stream has against those that its declared rate, or else its median step, makes expected.

    The share that is absent is negative where there are more. Streams of fewer than two frames have only their count.
    """
    shape = steps(messages).groupBy(*STREAM).agg(F.count("*").alias("message_count"), F.median("dt_s").alias("median_dt_s"), ((F.max("log_time_ns") - F.min("log_time_ns")) / F.lit(1e9)).alias("span"))
    period = F.coalesce(declared_period(expected_hz), F.col("median_dt_s"))
    expected = F.when((F.col("message_count") > 1) & (period > 0), F.bround(F.col("span") / period, 0).cast("bigint") + 1)
    counted = shape.withColumn("expected_frame_count", expected)
    deficit = (F.col("expected_frame_count") - F.col("message_count")) * F.lit(100.0) / F.col("expected_frame_count")
    return counted.select(*STREAM, "message_count", "expected_frame_count", deficit.alias("frame_deficit_pct"))


def freezes(stats: DataFrame, messages: DataFrame) -> DataFrame:
    """Freezes of ``frames.frame_stats`` on the clock of the log, as intervals labelled ``freeze:<topic>``.

    An instrument counts seconds from the first frame, which has the time of the stream's
    first message. Streams without messages have no intervals.
    """
    first = messages.groupBy(*STREAM).agg(F.min("log_time_ns").alias("first_ns"))
    spans = stats.select(*STREAM, F.inline("freeze_intervals")).join(first, list(STREAM))
    at = lambda c: F.col("first_ns") + (F.col(c) * F.lit(1e9)).cast("bigint")
    return spans.select(*STREAM, F.concat(F.lit("freeze:"), F.col("topic")).alias("label"), at("start_s").alias("start_ns"), at("end_s").alias("end_ns"))


def idle(messages: DataFrame, *, epsilon: float) -> DataFrame:
    """Time-weighted share of a stream on which the value hardly moves."""
    still = F.coalesce(F.col("speed") < epsilon, F.lit(False))
    positive = F.greatest(F.lit(0), F.col("log_time_ns") - F.col("prev_ns"))
    # Integers until the end: sums don't depend on their order.
    sums = speed(steps(messages)).where("prev_ns is not null").groupBy(*STREAM).agg(F.sum(F.when(still, positive).otherwise(0)).alias("still_ns"), F.sum(positive).alias("total_ns"))
    return sums.select(*STREAM, (F.col("still_ns") / F.lit(1e9)).alias("idle_total_s"), F.coalesce(F.try_divide(F.col("still_ns").cast("double"), F.col("total_ns").cast("double")), F.lit(0.0)).alias("idle_fraction"))


def idle_runs(messages: DataFrame, *, epsilon: float, least_s: float = 1.0) -> DataFrame:
    return islands(speed(steps(messages)), F.col("speed") < epsilon, "idle", least_s=least_s)


def duration(messages: DataFrame) -> DataFrame:
    return messages.groupBy("episode_id").agg(
        ((F.max("log_time_ns") - F.min("log_time_ns")) / F.lit(1e9)).alias("duration_s"),
        F.count("*").alias("message_count_total"),
        F.countDistinct("topic").alias("topic_count"),
    )


def action_rate(messages: DataFrame) -> DataFrame:
    """Steps per second of an episode: messages less one for each stream; 0 without a span."""
    streams = messages.groupBy(*STREAM).agg(F.count("*").alias("n"), F.min("log_time_ns").alias("a"), F.max("log_time_ns").alias("b"))
    episodes = streams.groupBy("episode_id").agg((F.sum("n") - F.count("*")).alias("steps"), ((F.max("b") - F.min("a")) / F.lit(1e9)).alias("span"))
    return episodes.select("episode_id", F.when(F.col("span") > 0, F.try_divide(F.col("steps"), F.col("span"))).otherwise(F.lit(0.0)).alias("action_rate_hz"))


def digest(messages: DataFrame, channels: DataFrame | None = None, *, key: str = "episode_id", order: str = "seq") -> DataFrame:
    """SHA-256 of an episode's messages, whatever the layout of the file that held them.

    Channels come in order of topic and id (``channel_id``, where messages have one); of each
    the topic's bytes, the number of messages in eight bytes, and for each message in order of
    time its time and its length in eight bytes and its data: big-endian, times signed.
    With ``channels(key, topic, channel_id)`` those without messages take part too; null data is empty.

    A digest is sequential, so an episode is one task's stream: Spark sorts it, and the task
    holds a batch and the digest's state.
    """
    number = F.col("channel_id").cast("bigint") if "channel_id" in messages.columns else F.lit(0).cast("bigint")
    own = messages.select(key, "topic", number.alias("channel_id"), F.lit(1).alias("kind"), "log_time_ns", F.col(order).cast("bigint").alias("place"), F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"))
    stream = [key, "topic", "channel_id"]
    counts = own.groupBy(*stream).agg(F.count("*").alias("n"))
    if channels is not None:
        known = channels.select(key, "topic", (F.col("channel_id").cast("bigint") if "channel_id" in channels.columns else F.lit(0).cast("bigint")).alias("channel_id")).distinct()
        counts = known.join(counts, stream, "full").select(*stream, F.coalesce("n", F.lit(0)).alias("n"))
    heads = counts.select(*stream, F.lit(0).alias("kind"), F.col("n").alias("log_time_ns"), F.lit(0).cast("bigint").alias("place"), F.lit(b"").alias("data"))
    dealt = heads.unionByName(own).repartition(key).sortWithinPartitions(*stream, "kind", "log_time_ns", "place")
    kind = dict(messages.dtypes)[key]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, None, []
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), pa.field("content_digest", pa.string())])
            names, topics, kinds, numbers, data = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "topic", "kind", "log_time_ns", "data"))
            for name, topic, message, value, raw in zip(names, topics, kinds, numbers, data):
                if held is None or name != now:
                    if held is not None:
                        done.append((now, held.hexdigest()))
                    now, held = name, hashlib.sha256()
                head = value.to_bytes(8, "big", signed=True)
                held.update(head + len(raw).to_bytes(8, "big") + raw if message else (topic or "").encode() + head)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, held.hexdigest()), schema)], schema=schema)

    return dealt.mapInArrow(over, f"{key} {kind}, content_digest string")


def order_violations(messages: DataFrame) -> DataFrame:
    """Messages earlier than the one before them in the file, per stream."""
    w = Window.partitionBy(*STREAM).orderBy("seq", "log_time_ns")
    return messages.withColumn("before", F.lag("log_time_ns").over(w)).where("log_time_ns < before").select(*STREAM, "seq", "log_time_ns", F.col("before").alias("previous_ns"))
