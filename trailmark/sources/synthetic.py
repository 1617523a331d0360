"""Synthetic episodes with declared defects, made by expressions over ranges: joint states, and frames with what an instrument says of them."""

from __future__ import annotations

from dataclasses import dataclass
from random import Random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EpisodeSpec:
    """An episode's shape; ``jump_at_s`` and ``gap_s`` inject what checks should find."""

    episode_id: int
    duration_s: float = 8.0
    joint_hz: int = 100
    joints: int = 7
    start_ns: int = 1_755_000_000_000_000_000
    seed: int = 0
    jump_at_s: float | None = None
    jump_rad: float = 0.8
    gap_s: tuple[float, float] | None = None
    cameras: tuple[str, ...] = ()
    image_hz: int = 15
    #: Of the first camera: black frames, frames that are late by ``offset_s``, and frames that don't change.
    black_s: tuple[float, float] | None = None
    late_s: tuple[float, float] | None = None
    offset_s: float = 0.003
    frozen_s: tuple[float, float] | None = None


def corpus(n: int, seed: int) -> list[EpisodeSpec]:
    """A plan of ``n`` episodes, the same for a seed: some jump, some have a gap."""
    rng = Random(seed)
    out = []
    for k in range(n):
        duration = rng.choice((4.0, 8.0, 12.0))
        jump = rng.uniform(1, duration - 1) if rng.random() < 0.2 else None
        gap = (duration / 2, duration / 2 + 0.5) if rng.random() < 0.1 else None
        seed = rng.randrange(1 << 30)
        out.append(EpisodeSpec(k, duration, seed=seed, jump_at_s=jump, gap_s=gap, **_faults(Random(seed), duration)))
    return out


def _faults(rng: Random, duration: float) -> dict:
    """One to three cameras, and at most one fault of each kind on the first."""

    def span(share: float, longest: float) -> tuple[float, float] | None:
        if rng.random() >= share:
            return None
        start = rng.uniform(0, max(0.0, duration - longest))
        return start, min(duration, start + rng.uniform(longest / 4, longest))

    cameras = tuple(f"/cam_{k}" for k in range(rng.randint(1, 3)))
    return {"cameras": cameras, "image_hz": rng.choice((10, 15, 30)), "black_s": span(0.2, 2.0), "late_s": span(0.1, 1.0), "frozen_s": span(0.1, 3.0)}


def frames(spark: SparkSession, specs: list[EpisodeSpec]) -> DataFrame:
    """``(episode_id, topic, log_time_ns, seq, black, frozen, luma)``: the frames of each episode's cameras."""
    pair = lambda x: x or (None, None)
    rows = [(s.episode_id, c, k == 0, s.duration_s, s.image_hz, s.start_ns, s.seed, *pair(s.black_s), *pair(s.late_s), s.offset_s, *pair(s.frozen_s)) for s in specs for k, c in enumerate(s.cameras)]
    ddl = "episode_id bigint, topic string, first boolean, duration_s double, hz int, start_ns bigint, seed bigint, black_from double, black_to double, late_from double, late_to double, offset_s double, frozen_from double, frozen_to double"
    last = (F.bround(F.col("duration_s") * F.col("hz"), 0) - 1).cast("bigint")
    each = spark.createDataFrame(rows, ddl).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    t = F.col("seq") / F.col("hz")
    within = lambda name: F.col("first") & F.coalesce((t >= F.col(f"{name}_from")) & (t < F.col(f"{name}_to")), F.lit(False))
    late = F.when(within("late"), F.bround(F.col("offset_s") * 1e9, 0).cast("bigint")).otherwise(0)
    time = F.col("start_ns") + F.bround(F.col("seq") * 1e9 / F.col("hz"), 0).cast("bigint") + late
    luma = F.when(within("black"), 2.0).otherwise(80.0 + F.pmod(F.xxhash64("seed", "topic", "seq"), F.lit(100)))
    return each.select("episode_id", "topic", time.alias("log_time_ns"), "seq", within("black").alias("black"), within("frozen").alias("frozen"), luma.alias("luma"))


def instrument_lines(frames_: DataFrame) -> DataFrame:
    """``(episode_id, topic, line_no, line)``: what an instrument prints of each frame, as ``frames.frame_stats`` reads it."""
    w = Window.partitionBy("episode_id", "topic").orderBy("seq")
    seen = frames_.withColumns({"before": F.coalesce(F.lag("frozen").over(w), F.lit(False)), "first_ns": F.min("log_time_ns").over(Window.partitionBy("episode_id", "topic"))})
    at = ((F.col("log_time_ns") - F.col("first_ns")) / F.lit(1e9)).cast("string")
    lines = F.array(
        F.concat(F.lit("frame:"), F.col("seq").cast("string"), F.lit(" pts_time:"), at),
        F.concat(F.lit("lavfi.signalstats.YAVG="), F.col("luma").cast("string")),
        F.when(F.col("black"), F.lit("lavfi.blackframe.pblack=100")),
        F.when(F.col("frozen") & ~F.col("before"), F.concat(F.lit("lavfi.freezedetect.freeze_start="), at)),
        F.when(~F.col("frozen") & F.col("before"), F.concat(F.lit("lavfi.freezedetect.freeze_end="), at)),
    )
    spread = seen.select("episode_id", "topic", "seq", F.posexplode(F.array_compact(lines)).alias("k", "line"))
    return spread.select("episode_id", "topic", (F.col("seq") * 8 + F.col("k")).alias("line_no"), "line")


def joint_states(spark: SparkSession, specs: list[EpisodeSpec]) -> DataFrame:
    """``(episode_id, topic, log_time_ns, seq, position)``: a sine per joint.

    The specs are a small table; the messages come from an explode of each one's range.
    """
    rows = [(s.episode_id, s.duration_s, s.joint_hz, s.joints, s.start_ns, s.seed, s.jump_at_s, s.jump_rad, *(s.gap_s or (None, None))) for s in specs]
    ddl = "episode_id bigint, duration_s double, hz int, joints int, start_ns bigint, seed bigint, jump_at double, jump_rad double, gap_from double, gap_to double"
    last = (F.bround(F.col("duration_s") * F.col("hz"), 0) - 1).cast("bigint")
    each = spark.createDataFrame(rows, ddl).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    t = F.col("seq") / F.col("hz")
    share = lambda j, salt: F.pmod(F.xxhash64("seed", j, F.lit(salt)), F.lit(1000)) / 1000.0
    jump = F.when(t >= F.col("jump_at"), F.col("jump_rad")).otherwise(0.0)
    angle = lambda j: 0.5 * F.sin(2 * 3.141592653589793 * (0.2 + 0.3 * share(j, 1)) * t + 2 * 3.141592653589793 * share(j, 2)) + F.when(j == 0, jump).otherwise(0.0)
    position = F.transform(F.sequence(F.lit(0), F.col("joints") - 1), angle)
    time = F.col("start_ns") + F.bround(F.col("seq") * 1e9 / F.col("hz"), 0).cast("bigint")
    seen = each.where(F.coalesce(~((t >= F.col("gap_from")) & (t < F.col("gap_to"))), F.lit(True)))
    return seen.select("episode_id", F.lit("/joint_states").alias("topic"), time.alias("log_time_ns"), "seq", position.alias("position"))
