"""Worked checks as a pipeline's author writes them: evidence by episode, with the author's own limits.

Each gives rows that an ``App`` takes: ``episode_id`` and what it has of measurements, intervals,
tags and a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks
from .series import STREAM, steps


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def joint_smoothness(messages: DataFrame, *, rate_hz: float = 100.0) -> DataFrame:
    """Largest and mean change per second of all components of a vector stream, at a declared rate.

    The mean is over all steps and components; episodes of one message have nulls.
    """
    moved = steps(messages).where("prev_ns is not null").select("episode_id", F.explode(F.zip_with("value", "prev_value", lambda a, b: F.abs(a.cast("double") - b.cast("double")) * F.lit(rate_hz))).alias("v"))
    found = moved.groupBy("episode_id").agg(F.max("v").alias("most"), F.avg("v").alias("mean"))
    every = messages.select("episode_id").distinct().join(found, "episode_id", "left")
    return every.select("episode_id", _map(max_velocity_rad_s=F.col("most"), mean_velocity_rad_s=F.col("mean")).alias("measurements"))


def black_pct(stats: DataFrame) -> Column:
    return F.col("black_frame_count") * F.lit(100.0) / F.col("frame_count")


def camera_blackout(stats: DataFrame, *, most_pct: float = 50.0) -> DataFrame:
    """Share of black frames of ``frames.frame_stats``; too large a share of any camera is a failure."""
    worst = stats.groupBy("episode_id").agg(F.max(black_pct(stats)).alias("pct"))
    return worst.select("episode_id", _map(black_pct=F.col("pct")).alias("measurements"), (F.col("pct") < most_pct).alias("verdict"))


def camera_health(stats: DataFrame, messages: DataFrame, *, most_black_pct: float = 5.0, most_freeze_s: float = 2.0) -> DataFrame:
    """Black frames, freezes on the log's clock and brightness of an episode's camera; both limits decide the verdict."""
    spans = checks.freezes(stats, messages).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("camera_freeze").alias("label"), "start_ns", "end_ns"))).alias("intervals"))
    told = stats.select("episode_id", black_pct(stats).alias("pct"), "freeze_total_s", "luma_mean", "frame_count")
    measured = told.select(
        "episode_id",
        _map(black_frame_pct=F.col("pct"), freeze_total_s=F.col("freeze_total_s"), luma_avg_mean=F.col("luma_mean"), frame_count=F.col("frame_count")).alias("measurements"),
        ((F.col("pct") < most_black_pct) & (F.col("freeze_total_s") < most_freeze_s)).alias("verdict"),
    )
    return measured.join(spans, "episode_id", "left")


def hand_visibility(answers: DataFrame) -> DataFrame:
    """The share of sampled frames on which a model saw hands, from ``answers(episode_id, tiles, answer)``.

    An answer that isn't a whole number is an unknown: its text and a tag stand for it, and no share.
    """
    text = F.trim("answer")
    number = F.when(text.rlike("^[0-9]+$"), text.cast("decimal(38,0)"))
    share = F.least(number, F.col("tiles").cast("decimal(38,0)")).cast("double") / F.col("tiles")
    counted = F.create_map(F.lit("hands_sampled_frame_count"), F.col("tiles").cast("double"))
    return answers.select(
        "episode_id",
        F.when(number.isNull(), counted).otherwise(F.map_concat(counted, F.create_map(F.lit("hands_visible_fraction"), share))).alias("measurements"),
        F.create_map(F.lit("hands_visible_raw_answer"), text).alias("labels"),
        F.when(number.isNull(), F.array(F.lit("hands_visible_unparsed"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def late_frames(messages: DataFrame, camera: Column, *, expected_hz: float, tolerance_s: float) -> DataFrame:
    """Frames that come off their camera's beat: ``(episode_id, topic, log_time_ns, off_s)`` against the first frame and the rate."""
    frames = messages.where(camera)
    timed = frames.join(frames.groupBy(*STREAM).agg(F.min("log_time_ns").alias("first_ns")), list(STREAM))
    beat = F.bround((F.col("log_time_ns") - F.col("first_ns")) / F.lit(1e9) * F.lit(expected_hz), 0)
    off = (F.col("log_time_ns") - F.col("first_ns")) / F.lit(1e9) - beat / F.lit(expected_hz)
    return timed.withColumn("off_s", off).where(F.abs("off_s") > tolerance_s).select(*STREAM, "log_time_ns", "off_s")
