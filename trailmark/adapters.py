"""The driver's star-schema tables in the shapes that episode operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: str) -> Column:
    """Nanoseconds since the epoch of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) * 1000L")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages: a user is an episode, an event type a topic.

    ``(episode_id, topic, log_time_ns, seq, value, data)``; ``seq`` is the order in the
    file, which settles equal times.
    """
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"),
        F.col("event_type").alias("topic"),
        nanoseconds("ts").alias("log_time_ns"),
        F.col("event_id").alias("seq"),
        "value",
        F.col("props").alias("data"),
    )


TOPICS = ("click", "error", "purchase", "signup", "view")


def recordings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``events`` as the tables of recordings: a user is a file, an event type a channel in JSON."""
    m = messages(spark, sf_dir)
    path = F.concat(F.lit("user-"), F.col("episode_id").cast("string"), F.lit(".mcap")).alias("path")
    number = F.array_position(F.array(*map(F.lit, TOPICS)), F.col("topic")).cast("int").alias("channel_id")
    none = lambda t: F.lit(None).cast(t)
    described = [none("string").alias("schema_name"), none("string").alias("schema_encoding"), F.lit("json").alias("message_encoding")]
    own = m.select(path, number, "topic", *described, F.col("seq").alias("offset"), F.col("seq").alias("sequence"), "log_time_ns", F.col("log_time_ns").alias("publish_time_ns"), F.col("data").cast("binary").alias("data"))
    channels = own.select("path", "channel_id", "topic").distinct().select("*", *described, F.create_map(F.lit("unit"), F.lit("k")).alias("channel_metadata"), none("binary").alias("schema_data"))
    told = F.create_map(F.lit("task"), F.when(F.col("episode_id") % 2 == 0, "even").otherwise("odd"), F.lit("operator"), F.col("episode_id").cast("string"))
    metadata = m.select("episode_id").distinct().select(path, F.lit(0).cast("bigint").alias("offset"), F.lit("episode/v1").alias("record"), told.alias("entries"))
    attachments = m.where("topic = 'signup'").groupBy("episode_id").agg(F.min("log_time_ns").alias("log_time_ns"), F.min("seq").alias("seq"))
    attachments = attachments.select(path, F.col("seq").alias("offset"), F.lit("first_signup").alias("name"), F.lit("text/plain").alias("media_type"), "log_time_ns", F.col("log_time_ns").alias("create_time_ns"), F.col("seq").cast("string").cast("binary").alias("data"))
    return {"messages": own, "channels": channels, "metadata": metadata, "attachments": attachments}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as runs of episodes: a customer is an episode, an order a run."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("episode_id"),
        F.col("o_orderkey").alias("run_fingerprint"),
        F.col("o_orderdate").alias("recorded_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("pipeline_version"),
        F.col("o_totalprice").alias("total"),
    )


def run_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as measurements of those runs: the line number is the key."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_fingerprint"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("key"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("value_double"),
    )


def event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as measurements: the key is the event type, each event is a run."""
    return messages(spark, sf_dir).select("episode_id", F.col("topic").alias("key"), F.col("log_time_ns").alias("recorded_at"), F.col("seq").alias("run_fingerprint"), F.col("value").alias("value_double"), F.lit(None).cast("boolean").alias("value_bool"))
