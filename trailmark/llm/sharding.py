"""Operator 11, sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within their source by a seeded hash and ranked; rank over the source's
size is a fraction in [0, 1), and all rows are sorted by it. A stretch of that order holds
each source in proportion to its size, so cutting the order into stretches of equal counts
gives shards that match the mixture to within a row or two per source.

No source, and no group of equal rows, is one task's work. Rows that the order can't tell
apart travel as one row with a count. Ranks come from buckets of about ``BUCKET`` rows (by
the hash within a source, by the fraction over all): a bucket is sorted on its own, and
running sums over the buckets' counts, again in two levels, say where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SHARDS = 24
SEED = 11
#: Rows of a bucket on average, and buckets of a block of running sums.
BUCKET = 512
BLOCK = 4_096
#: Copies of one row that one step makes.
COPIES = 4_096
#: Bits of the seeded hash.
BITS = 60


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and eight more; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _digits(column: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, n), 16, 10).cast("long")


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, bucket, before, total)`` from ``counts(*keys, bucket, n)``: rows of the key in smaller buckets, and in all.

    A window meets the buckets of one block or the blocks of one key, never all buckets.
    """
    blocked = counts.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    within = Window.partitionBy(*keys, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys) if keys else Window.partitionBy()
    sums = blocked.groupBy(*keys, "block").agg(F.sum("n").alias("sum"))
    sums = sums.withColumn("total", F.sum("sum").over(over)).withColumn("base", F.coalesce(F.sum("sum").over(over.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = blocked.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).alias("l")
    right = sums.alias("r")
    same = F.col("l.block") == F.col("r.block")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.bucket").alias("bucket"), (F.col("base") + F.col("inner")).alias("before"), F.col("total"))


def _placed(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows(*keys, bucket, n, ...)`` with ``first``, a row's place among its key's rows, and ``total``, their number.

    Buckets are in order; ``order`` is that of the rows of one.
    """
    starts = _starts(rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")), keys).alias("s")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("r")
    same = F.col("r.bucket") == F.col("s.bucket")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    own = [F.col(f"r.{c}").alias(c) for c in rows.columns]
    return ranked.join(starts, same).select(*own, (F.col("r.first") + F.col("s.before")).alias("first"), F.col("s.total").alias("total"))


def places(rows: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(id, source, size, crc, copy, place, shard, slot)`` of ``rows(id, source, size, crc)``, one for each row.

    Rows are told apart by these four columns alone: those that are equal are numbered
    by ``copy`` and stand next to each other in their source's order. Null sources are
    one source; null ids are ordered last. ``place`` is the row's place in the whole order,
    ``slot`` that in its shard. Shards' counts are at most one apart, so with fewer rows
    than shards some stay empty; an empty table gives an empty result.
    """
    key = ["id", "source", "size", "crc"]
    hash_ = _digits(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "crc"), BITS // 4)
    groups = written(rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("hash", hash_), "shard-rows")
    rows_there = groups.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-rows_there // BUCKET))
    bucket = F.expr(f"(hash >> {BITS - 32}) * {buckets}L >> 32")
    ranked = _placed(groups.withColumn("bucket", bucket), ["source"], [F.col("hash"), F.col("id").asc_nulls_last(), F.col("size"), F.col("crc")])

    chunks = ranked.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    each = chunks.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {COPIES}, least(n, (chunk + 1) * {COPIES}) - 1)")))
    # A source starts at a place of its own within the first step, or small sources would all meet in the middle.
    start = _digits(F.concat_ws(":", F.lit(seed), F.col("source")), 13) / F.lit(float(1 << 52))
    fraction = ((F.col("first") + F.col("copy")).cast("double") + start) / F.col("total").cast("double")
    each = each.select(*key, "copy", (F.col("first") + F.col("copy")).alias("rank"), fraction.alias("fraction"))
    each = written(each.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1).cast("long"))).withColumn("n", F.lit(1).cast("long")), "shard-fractions")
    placed = _placed(each, [], [F.col("fraction"), F.col("source").asc_nulls_last(), F.col("rank")])
    shard = F.expr(f"first * {shards} div total")
    slot = F.col("first") - F.expr(f"({shards - 1} + (first * {shards} div total) * total) div {shards}")
    return placed.select(*key, "copy", F.col("first").alias("place"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _told(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What rows are told apart by. A null text has the checksum of no bytes."""
    text = F.col(text_col)
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(text).alias("size"), F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("crc")]


def interleave(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with a struct ``placement(shard, slot, place)`` behind its columns.

    Null texts and sources, empty and long texts are placed like any others. Rows with equal
    id, source, size and checksum are numbered by input partition to be matched with their
    places, so a large group of them is split as well. An empty table gives an empty
    result. A column of ``docs`` by the name of ``placement`` is an error.
    """
    if "placement" in docs.columns:
        raise ValueError("the table has a column placement already")
    key = ["id", "source", "size", "crc"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = written(docs.select(*_told(id_col, text_col, source_col), F.spark_partition_id().cast("long").alias("bucket"), row), "shard-docs")
    held = held.withColumn("n", F.lit(1).cast("long"))
    # The same order in every run of a task, so that one run again takes no other row's place.
    numbered = _placed(held, key, [F.xxhash64(F.to_json("row"))]).withColumnRenamed("first", "copy").alias("d")
    where = places(held.select(*key), shards=shards, seed=seed).alias("p")
    same = F.col("d.copy") == F.col("p.copy")
    for k in key:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}"))
    return numbered.join(where, same).select("d.row.*", F.struct("p.shard", "p.slot", "p.place").alias("placement"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, **how) -> None:
    """Writes a folder of Parquet files per shard (``shard=K``), each file's rows in order of ``slot``.

    A shard's rows are dealt to tasks by ranges of places, so no task holds more than a share of one.
    """
    placed = interleave(docs, shards=shards, **how)
    placed = placed.select(*docs.columns, F.col("placement.slot").alias("slot"), F.col("placement.shard").alias("shard"))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in 24 shards, whose counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = places(docs.select(*_told("doc_id", "text", "source")))
    return got.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "place")


ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS crc
  FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), sized AS (
  SELECT doc_id, source, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size,
         CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                          lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS BIGINT) AS text_crc32
  FROM documents, crc_table
), hashed AS (
  SELECT *, CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), 1, 15) AS BIGINT) AS hash,
         CAST('0x' || substr(md5('11' || coalesce(':' || source, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS start
  FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id NULLS LAST, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (CAST(rank AS DOUBLE) + start) / CAST(n AS DOUBLE), encode(source) NULLS LAST, rank) - 1 AS place, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // total AS INTEGER) AS shard,
       CAST(place - (23 + (place * 24 // total) * total) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source, place
FROM placed
"""
