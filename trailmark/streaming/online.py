"""The online lane: the same evidence over files as they land."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..adapters import nanoseconds

EMITTED = "episode_id bigint, topic string, message_count bigint, max_gap_s double, span_s double"
#: How much later than others a message may land, in event time.
DELAY = "1 hour"


def _folded(times: list[int], last: int | None, n: int, gap: int | None, span: int) -> tuple[int | None, int, int | None, int]:
    """The state after messages in order of time."""
    for t in times:
        if last is not None:
            step = t - last
            gap, span = step if gap is None else max(gap, step), span + step
        last, n = t, n + 1
    return last, n, gap, span


class GapState(StatefulProcessor):
    """Keeps a stream's last time, count, largest gap and span.

    Messages wait until the watermark has passed them and are then taken in order of time, so
    files may land in any order within the delay. A message that comes later than one that
    was taken in and has an earlier time is left out; Spark drops most of these before they
    come here, and all up to 1970. Each trigger gives what the waiting messages would make of the
    state too. What waits is bounded by the delay; a timer takes it in when the stream falls silent.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, as each access is a round trip; ``timer`` is the one that is set, 0 for none.
        self.state = handle.getValueState("stream", "last bigint, n bigint, gap bigint, span bigint, waiting array<bigint>, timer bigint")

    def _moved(self, key, fresh: list[int], watermark_ms: int, fired: bool = False) -> Row:
        *held, waiting, timer = self.state.get() or (None, 0, None, 0, [], 0)
        timer = 0 if fired else timer
        kept = [t for t in fresh if held[0] is None or t >= held[0]]
        times = sorted([*(waiting or []), *kept])
        passed = [t for t in times if t // 1_000_000 < watermark_ms]
        rest = times[len(passed) :]
        held = _folded(passed, *held)
        if rest and not timer:
            timer = rest[-1] // 1_000_000 + 1
            self.handle.registerTimer(timer)
        self.state.update((*held, rest, timer))
        _, n, gap, span = _folded(rest, *held)
        return Row(episode_id=key[0], topic=key[1], message_count=n, max_gap_s=None if gap is None else gap / 1e9, span_s=span / 1e9)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [r["log_time_ns"] for r in rows]
        yield self._moved(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._moved(key, [], timerValues.getCurrentWatermarkInMs(), fired=True)

    def close(self) -> None:
        pass


def work_folder(spark: SparkSession) -> str:
    """A new folder that all machines share: in that of ``spark.checkpoint.dir``, or made here under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
    return f"{named.rstrip('/')}/online-{uuid.uuid4().hex}"


def stream_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The state of every stream after all files of ``path`` went through a streaming query."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name)
    rows = source.parquet(folder).select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("topic"), nanoseconds("ts").alias("log_time_ns"))
    return run_to_table(spark, rows, work_folder(spark))


def emit(rows: DataFrame, folder: str, *, delay: str = DELAY):
    """Starts the query over ``rows(episode_id, topic, log_time_ns)`` to the end of what is there.

    Each trigger's rows go to a folder named by the trigger's number, which a trigger that runs
    again replaces: each is there once. A query that starts again in ``folder`` goes on from its checkpoint.
    """
    spark = rows.sparkSession
    timed = rows.withColumn("at", F.timestamp_micros(F.expr("log_time_ns div 1000"))).withWatermark("at", delay)
    kept = timed.groupBy("episode_id", "topic").transformWithState(GapState(), EMITTED, "Update", "EventTime")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/trigger={number}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return kept.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(store, before)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each stream in the table that ``emit`` writes."""
    latest = Window.partitionBy("episode_id", "topic").orderBy(F.desc("trigger"))
    rows = spark.read.schema(f"{EMITTED}, trigger bigint").parquet(f"{folder}/table")
    return rows.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place", "trigger")


def run_to_table(spark: SparkSession, rows: DataFrame, folder: str, *, delay: str = DELAY) -> DataFrame:
    """Runs ``emit`` to its end and gives the table's latest rows."""
    emit(rows, folder, delay=delay).awaitTermination()
    return current(spark, folder)


def append_landed(spark: SparkSession, folder: str, schema: str, append: Callable[[DataFrame], int], checkpoint: str):
    """Starts the online lane: each trigger's landed rows go to an idempotent ``append``.

    A trigger that runs again after a failure appends what isn't there yet, so each run
    is in the catalog once.
    """
    landed = spark.readStream.schema(schema).parquet(folder)
    return landed.writeStream.foreachBatch(lambda rows, _: append(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
