"""Operator 7, mixing sources to target weights, in DataFrame functions only.

Sources are sized by their words, given a share of the mix by weight with a limit of
two passes over each, and turned into repetition rates. Every document is then taken
floor(rate) times plus one Bernoulli draw for the fraction, seeded by a hash of its
id, so reruns agree and no document depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text where the id is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``sized(source, size)``.

    The targets have one level: each source gets weight x level words, or its limit
    of ``most`` x size if that is less. With the sources in order of limit / weight,
    those below the level come first, so the level follows from running sums. Only
    one row per source takes part in these windows. A source without words gets
    target and rate 0.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight"))
    fill = Window.orderBy(most * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        F.row_number().over(fill).alias("k"),
        ((F.lit(share) * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)).alias("level"),
    )
    open_ = F.when(most * F.col("source_size") > F.col("level") * F.col("weight"), F.struct("k", "level"))
    filled = levels.select("source", "source_size", "weight", F.min(open_).over(everything)["level"].alias("level"))
    limit = (most * F.col("source_size")).cast("double")
    target = F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(0.0)
    return filled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for each row of ``docs``.

    A null text has size 0; a null source is a source of its own, last in order.
    Rows that repeat an id share its draw. Texts of any length are counted whole; sources that
    tie at a level go by name. Only the three columns are read, so others may have any
    names; they are left out. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _draw(F.col(id_col), F.col(text_col), seed).alias("_draw"))
    sized = written(sized, "sizes")
    # A small file: Spark broadcasts it just if its size is below the session's threshold.
    table = written(rates(sized, **how), "rates").withColumnRenamed("source", "_source")
    joined = sized.join(table, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * _copies(F.col("rate"), F.col("_draw"))
    return joined.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns, whatever their names.

    Nulls, ties and repeated rows as in ``mix``: a row without words is taken like the others of
    its source. An empty table gives an empty result.
    """
    table = written(rates(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), **how), "rates")
    source, rate, copy = (unused(docs, c) for c in ("_mix_source", "_mix_rate", "_mix_copy"))
    table = table.select(F.col("source").alias(source), F.col("rate").alias(rate))
    joined = docs.join(table, F.col(source_col).eqNullSafe(F.col(source)))
    times = _copies(F.col(rate), _draw(F.col(id_col), F.col(text_col), seed))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix, with repeated documents as repeated rows; odd rows as in ``repeat``."""
    return repeat(docs)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), levels AS (
  SELECT *, row_number() OVER fill AS k,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(2 * coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
  WINDOW fill AS (ORDER BY 2 * source_size::DOUBLE / weight, encode(source) NULLS LAST)
), open AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE 2 * source_size > level * weight
), targets AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, coalesce(open.level * weight, 2.0::DOUBLE * source_size)) AS target
  FROM levels, open
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM targets
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(s.size * (floor(r.rate) + CASE WHEN s.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
