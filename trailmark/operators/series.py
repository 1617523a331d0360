"""Building blocks over time-ordered streams: steps, runs of a mask, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ("episode_id", "topic")
ORDER = ("log_time_ns", "seq")


def in_order(keys=STREAM, order=ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def steps(messages: DataFrame, keys=STREAM, order=ORDER) -> DataFrame:
    """Adds the previous time and value of each message's stream and ``dt_s``, the step between.

    The first message of a stream has nulls. One shuffle by stream, which later
    aggregates by stream reuse.
    """
    w = in_order(keys, order)
    before = messages.withColumns({"prev_ns": F.lag("log_time_ns").over(w), "prev_value": F.lag("value").over(w), "step": F.row_number().over(w) - 1})
    return before.withColumn("dt_s", (F.col("log_time_ns") - F.col("prev_ns")) / F.lit(1e9))


def speed(steps_: DataFrame, value: Column | None = None) -> DataFrame:
    """Adds ``speed``, the change of the value per second; null where time doesn't advance.

    A vector's change is that of the component that changes most; components that are null or
    NaN on either side are left out, and a step without any other has none. Null rather than
    NaN: comparisons with NaN hold in Spark, while a step of no duration is neither fast nor idle.
    """
    if value is not None:
        change = value
    elif steps_.schema["value"].dataType.typeName() == "array":
        each = F.zip_with("value", "prev_value", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
        change = F.array_max(F.filter(each, lambda x: ~F.isnan(x)))
    else:
        change = F.abs(F.col("value") - F.col("prev_value"))
    return steps_.withColumn("speed", F.when(F.col("dt_s") > 0, change / F.col("dt_s")))


def islands(steps_: DataFrame, mask: Column, label: str, keys=STREAM, order=ORDER, least_s: float = 0.0) -> DataFrame:
    """Maximal runs of steps on which ``mask`` holds, as intervals of ``least_s`` or longer.

    A step spans the times of its two messages, so a run goes from the earlier message of
    its first step to the later message of its last.
    """
    w = in_order(keys, order)
    marked = steps_.where("prev_ns is not null").withColumn("on", F.coalesce(mask, F.lit(False)))
    turned = marked.withColumn("turn", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int"))
    numbered = turned.withColumn("run", F.sum("turn").over(w)).where("on")
    runs = numbered.groupBy(*keys, "run").agg(F.min("prev_ns").alias("start_ns"), F.max("log_time_ns").alias("end_ns"))
    runs = runs.where((F.col("end_ns") - F.col("start_ns")) / F.lit(1e9) >= least_s)
    return runs.select(*keys, F.concat(F.lit(label + ":"), F.col("topic")).alias("label"), "start_ns", "end_ns")
