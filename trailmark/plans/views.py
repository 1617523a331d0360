"""Latest-run, latest-measurement and wide views, coverage and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.gates import RAN


def latest(rows: DataFrame, *keys: str | Column, then: tuple[str, ...] = ("run_fingerprint",)) -> DataFrame:
    """The row of each key that was recorded last; equal times go to the larger ``then``.

    A filter on ``row_number() = 1``, which Spark turns into a limit per key on both
    sides of the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"), *map(F.desc, then))
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def new_rows(rows: DataFrame, there: DataFrame, *keys: str) -> DataFrame:
    """What an append adds: rows whose key isn't there yet; a null in a key is a value like others."""
    have = there.select(*[F.col(k).alias(f"_there_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_there_{k}"))
    return rows.join(have, same, "left_anti")


def drift(rows: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("episode_id", "run_fingerprint"), time: str = "recorded_at") -> DataFrame:
    """Rows whose ``time`` isn't that of their committed run, with that as ``committed_at``."""
    committed = runs.select(*keys, F.col(time).alias("committed_at"))
    return rows.join(committed, list(keys)).where(~F.col(time).eqNullSafe(F.col("committed_at")))


def number(value_double: str = "value_double", value_bool: str = "value_bool") -> Column:
    """A measurement as a number: its double, else its boolean as 1 or 0."""
    return F.coalesce(F.col(value_double), F.col(value_bool).cast("double"))


def keys_of(measurements: DataFrame) -> list[str]:
    """Measurement keys in order; two that differ in case alone can't both be columns."""
    keys = [r[0] for r in measurements.select("key").distinct().orderBy("key").collect()]
    folded: dict[str, str] = {}
    for k in keys:
        if (other := folded.setdefault(k.lower(), k)) != k:
            raise ValueError(f"measurement keys {other!r} and {k!r} would be one column")
    return keys


def wide(episodes_latest: DataFrame, measurements_latest: DataFrame, keys: list[str]) -> DataFrame:
    """A row per latest episode with a column per key; episodes without measurements stay.

    ``measurements_latest`` has one row per episode and key, so any aggregate is its value.
    """
    taken = {c.lower() for c in episodes_latest.columns}
    if clash := [k for k in keys if k.lower() in taken]:
        raise ValueError(f"measurement keys are columns of the episodes already: {clash}")
    values = measurements_latest.select("episode_id", "key", number().alias("_value"))
    pivot = values.groupBy("episode_id").pivot("key", keys).agg(F.max("_value")) if keys else values.select("episode_id").distinct()
    return episodes_latest.join(pivot, "episode_id", "left")


def status(quarantined: str = "quarantined") -> Column:
    return F.when(F.col(quarantined), "quarantined").otherwise("ok")


def coverage(check_runs: DataFrame, episodes: DataFrame) -> DataFrame:
    """For each check the episodes on which it ran, of all episodes."""
    total = episodes.agg(F.countDistinct("episode_id").alias("total"))
    ran = check_runs.where(F.col("status").isin(*RAN)).groupBy("check_name").agg(F.countDistinct("episode_id").alias("ran"))
    names = check_runs.select("check_name").distinct()
    # One row of one number: its size is fixed.
    joined = names.join(ran, "check_name", "left").crossJoin(F.broadcast(total))
    return joined.select("check_name", F.coalesce("ran", F.lit(0)).alias("ran"), "total", F.when(F.col("total") > 0, F.coalesce("ran", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("fraction"))


def stale(episodes: DataFrame, versions: dict[str, str], *, source: Column | None = None) -> DataFrame:
    """Latest rows per source of which some version isn't the given one (null included)."""
    source = F.coalesce("source_uri", "episode_id") if source is None else source
    now = latest(episodes.withColumn("_source", source), "_source").drop("_source")
    differs = F.lit(False)
    for column, version in versions.items():
        differs = differs | ~F.col(column).eqNullSafe(F.lit(version))
    return now.where(differs).orderBy("episode_id")


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the number of their range of ``order``, nulls first, in ``_part``.

    The ranges' ends are found first, by a job of its own, and a row's range follows from them and
    its values alone. Where a frame that Spark deals by ranges is used twice with other columns, it
    is dealt twice, by two samples, and a row may be in different ranges. The ends decide how
    even the ranges are, never which row comes first.
    """
    dealt = rows.select(*order).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ends = dealt.groupBy(F.spark_partition_id().alias("_part")).agg(F.max(F.struct(*order)).alias("_end"))
    ends = ends.agg(F.array_sort(F.collect_list("_end")).alias("_ends"))
    found = ends.collect()
    # A binary search: the number of ends before the row.
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(found[0]["_ends"]).bit_length())))])
    before = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get("_ends", at + jump - 1) < F.struct(*order), at + jump).otherwise(at))
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame(found, ends.schema))).withColumn("_part", before).drop("_ends")


def cohort(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds z-score and percent rank of ``value`` in its cohort (``keys``).

    No cohort is one task's work: equal values are counted, the counts dealt to ranges of
    values, and a value's rank is the rows of smaller ranges and of smaller values in its own.
    Nulls come first, as in a window; the only row of a cohort has rank 0.
    """
    shape = values.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev"), F.count("*").alias("_all"))
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = _ranges(counts, *keys, value)
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # As many rows a cohort as there are ranges.
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    ranks = ranged.join(starts, [*keys, "_part"]).select(*keys, F.col(value).alias("_value"), (F.col("_before") + F.col("_in")).alias("_rank"))
    same = F.col(f"v.{value}").eqNullSafe(F.col("r._value"))
    for k in keys:
        same = same & (F.col(f"v.{k}") == F.col(f"r.{k}"))
    joined = values.join(shape, list(keys)).alias("v").join(ranks.alias("r"), same).select("v.*", "r._rank")
    rank = F.coalesce(F.try_divide(F.col("_rank").cast("double"), (F.col("_all") - 1).cast("double")), F.lit(0.0))
    return joined.withColumns({"z": F.try_divide(F.col(value) - F.col("_mean"), F.col("_dev")), "percent_rank": rank}).drop("_mean", "_dev", "_all", "_rank")


def duplicates(rows: DataFrame, digest: Column, item: str) -> DataFrame:
    """``(digest, n, first, items)`` of digests that more than one row has: how many, the least item, and all in order.

    Nulls count as rows and aren't listed. A digest's list is one value; ``duplicate_members`` has a row for each item.
    """
    named = rows.select(digest.alias("digest"), F.col(item).alias("item"))
    found = named.groupBy("digest").agg(F.count("*").alias("n"), F.min("item").alias("first"), F.array_sort(F.collect_list("item")).alias("items"))
    return found.where("n > 1")


def duplicate_members(rows: DataFrame, digest: Column, item: str) -> DataFrame:
    """``(digest, item)`` of those rows: a row each, as a digest may have any number."""
    named = rows.select(digest.alias("digest"), F.col(item).alias(item))
    return named.join(duplicates(rows, digest, item).select("digest"), "digest", "left_semi")


def shards(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """Contiguous shards of nearly equal size in the given order, without a global sort's
    single task: a range sort, rows numbered within partitions, and the partitions' sums.
    """
    parts = _ranges(rows, *order)
    w = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.withColumn("_at", F.row_number().over(w) - 1)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    placed = numbered.join(starts, "_part").withColumn("position", F.col("_start") + F.col("_at"))
    return placed.withColumn("shard", F.floor(F.col("position") * count / F.col("_total")).cast("int")).drop("_part", "_at", "_start", "_total")
