"""Streams on epoch-anchored time grids: linear interpolation or the nearest message.

Each time of a stream opens a segment up to the next one, and a grid point falls in
just one segment, so the as-of join is a window and an explode. Grid points are k times
an exact rational step, rounded half to even.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import STREAM, in_order

SECOND = 1_000_000_000
POLICIES = ("interpolate", "nearest")


def step_ns(rate_hz: float) -> Fraction:
    """The exact length of a grid step in nanoseconds."""
    if not rate_hz > 0:
        raise ValueError(f"rate_hz must be positive, not {rate_hz!r}")
    return Fraction(SECOND) / Fraction(rate_hz)


def _divided(top: Column, bottom: int) -> tuple[Column, Column]:
    """Floor and remainder of an integer division, in decimals of 38 digits."""
    wide, by = top.cast("decimal(38,0)"), F.lit(str(bottom)).cast("decimal(38,0)")
    rest = F.pmod(wide, by)
    return ((wide - rest) / by).cast("bigint"), rest


def _index(time: Column, step: Fraction) -> Column:
    """The largest k with k x step <= time."""
    if step.denominator == 1:
        return F.floor((time - F.pmod(time, F.lit(step.numerator))) / F.lit(step.numerator)).cast("bigint")
    return _divided(time.cast("decimal(19,0)") * F.lit(str(step.denominator)).cast("decimal(38,0)"), step.numerator)[0]


def _point(index: Column, step: Fraction) -> Column:
    if step.denominator == 1:
        return index * F.lit(step.numerator)
    down, rest = _divided(index.cast("decimal(19,0)") * F.lit(str(step.numerator)).cast("decimal(38,0)"), step.denominator)
    twice, whole = rest * 2, F.lit(str(step.denominator)).cast("decimal(38,0)")
    return down + F.when((twice > whole) | ((twice == whole) & (down % 2 == 1)), 1).otherwise(0)


def to_grid(messages: DataFrame, rate_hz: float, *, policy: str = "interpolate", keys=STREAM) -> DataFrame:
    """``(keys..., grid_ns, value)``: each stream's value at the grid points within its span.

    Of messages at one time, the last counts before what follows and the first after
    what precedes; a point on that very time takes the last one when interpolating and
    the first one as the nearest. Halfway between two, the earlier is the nearest. A
    stream that no grid point falls into has no rows.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    step = step_ns(rate_hz)
    times = messages.groupBy(*keys, "log_time_ns").agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"))
    w = in_order(keys, ("log_time_ns",))
    segments = times.withColumns({"next_ns": F.lead("log_time_ns").over(w), "next_first": F.lead("first").over(w)})
    # From the first point at or after this time to the last one before the next.
    low = _index(F.col("log_time_ns") - 1, step) + 1
    high = F.when(F.col("next_ns").isNull(), _index(F.col("log_time_ns"), step)).otherwise(_index(F.col("next_ns") - 1, step))
    bounded = segments.withColumns({"low": low, "high": high}).where("low <= high")
    points = bounded.withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("grid_ns", _point(F.col("k"), step))
    since, length = F.col("grid_ns") - F.col("log_time_ns"), F.col("next_ns") - F.col("log_time_ns")
    if policy == "nearest":
        value = F.when(since == 0, F.col("first")).when(F.col("next_ns").isNull() | (since <= F.col("next_ns") - F.col("grid_ns")), F.col("last")).otherwise(F.col("next_first"))
    else:
        value = F.when((since == 0) | F.col("next_ns").isNull(), F.col("last")).otherwise((F.col("next_first") - F.col("last")) / length * since + F.col("last"))
    return points.select(*keys, "grid_ns", value.alias("value"))


def fps_estimate(messages: DataFrame, keys=STREAM, *, strict: bool = False) -> DataFrame:
    """Frames per second from the median step; null for fewer than two messages or no step, or with ``strict`` an error that names the stream."""
    w = in_order(keys)
    step = messages.withColumn("d", F.col("log_time_ns") - F.lag("log_time_ns").over(w)).groupBy(*keys).agg(F.median("d").alias("median_ns"))
    told = F.concat(F.lit("no frame rate can be told of "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    none = F.raise_error(told).cast("double") if strict else F.lit(None).cast("double")
    return step.select(*keys, F.when(F.col("median_ns") > 0, F.lit(1e9) / F.col("median_ns")).otherwise(none).alias("fps"))


def gop_frames(fps: Column, seconds: float) -> Column:
    """Frames in a group of pictures of ``seconds``, at least one; halves to even."""
    return F.greatest(F.lit(1), F.bround(fps * F.lit(seconds), 0).cast("int"))


def looks_like_rotation(name: str, width: int, schema: str = "") -> bool:
    """Whether four numbers are likely a quaternion, by the field's name or the schema's, which must not be interpolated."""
    return width == 4 and (any(hint in name.lower() for hint in ("quat", "orient", "rotation")) or "quaternion" in schema.lower())


def vector_to_grid(messages: DataFrame, field: str, width: int, rate_hz: float, *, policy: str = "interpolate", keys=STREAM, schema: str = "") -> DataFrame:
    """``(keys..., grid_ns, <field>_0, <field>_1, ...)``: a vector field on the grid.

    The vectors' components go through ``to_grid`` as streams of their own and come
    back as columns.
    """
    if policy == "interpolate" and looks_like_rotation(field, width, schema):
        raise ValueError(f"{field!r} looks like a rotation: take the nearest message instead of interpolating")
    parts = messages.select(*keys, "log_time_ns", "seq", F.posexplode(field).alias("component", "value")).where(F.col("component") < width)
    placed = to_grid(parts, rate_hz, policy=policy, keys=(*keys, "component"))
    columns = placed.groupBy(*keys, "grid_ns").pivot("component", list(range(width))).agg(F.max("value"))
    return columns.select(*keys, "grid_ns", *[F.col(f"`{k}`").alias(f"{field}_{k}") for k in range(width)])
