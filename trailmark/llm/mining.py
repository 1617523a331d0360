"""Operator 12, hard-negative mining: a full score sort per anchor.

Vectors become integers, so scores are exact and ties are ties. All scores of an anchor are
sorted by score and id; its positives are the first rows of its own label. For each positive
a binary search finds the first entry that doesn't exceed the positive's score, and from
there the first rows of other labels are read down to the lower limit.

An anchor's scores aren't gathered in one task: rows and anchors are dealt to blocks of
bounded size, a task sorts the scores of one block of anchors with one block of rows, and
only what can be among the first few travels to be merged. Every anchor meets every row,
as asked for, so the work is anchors times rows; a block's size bounds memory, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative has a score between these hundredths of the positive's.
LOWER, UPPER = 80, 100
#: Most bytes of a block of vectors, and the number of blocks that rows are dealt to if that makes them smaller.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 64
#: Scores held at once.
TILE = 1 << 20


def takes_part(vector: Column, label: Column) -> Column:
    """Neither a null label nor a null vector, nor one with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return label.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a column of vectors, in whole numbers held as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), dim) * scale)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, exactly, or an error if they don't fit."""
    most = int(abs(anchors).max(initial=0)) * int(abs(rows).max(initial=0)) * rows.shape[1]
    if most < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 1 << 63:
        return anchors.astype(np.int64) @ rows.T.astype(np.int64)
    raise ValueError("scores of these vectors exceed 64 bits")


class Sorted:
    """One anchor's scores in a block: all entries by falling score, then rising id."""

    def __init__(self, own: int, score: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.lexsort((ids, -score))
        order = order[ids[order] != own]
        self.ids, self.labels, self.score = ids[order], labels[order], score[order]

    def same(self, label: int, k: int) -> Iterator[tuple[int, int]]:
        """The first ``k`` of the label as (id, score)."""
        at = np.flatnonzero(self.labels == label)[:k]
        return zip(self.ids[at].tolist(), self.score[at].tolist())

    def other(self, label: int):
        """A function that gives the first ``k`` of other labels within a positive's limits."""
        ids, score = self.ids[self.labels != label], self.score[self.labels != label]
        falling = -score

        def within(positive: int, k: int, lower: int, upper: int) -> Iterator[tuple[int, int]]:
            # 100 * s <= upper * p is s <= floor(upper * p / 100), as s is whole.
            first = int(np.searchsorted(falling, -(upper * positive // 100), side="left"))
            for i, s in zip(ids[first : first + k].tolist(), score[first : first + k].tolist()):
                if lower * positive > 100 * s:
                    return
                yield i, s

        return within


def _cells(dim_col: str, left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, Sorted]]:
    """Each anchor of ``left`` with its sorted scores over the rows of ``right``."""
    if not len(left) or not len(right):
        return
    dim = left[dim_col][0].as_py()
    rows = integers(right["vector"].combine_chunks(), dim)
    ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
    anchors = integers(left["vector"].combine_chunks(), dim)
    told = left.drop_columns(["vector"]).to_pylist()
    step = max(1, TILE // len(ids))
    for at in range(0, len(anchors), step):
        found = scores(anchors[at : at + step], rows)
        for k, score in enumerate(found):
            anchor = told[at + k]
            yield anchor, Sorted(anchor["anchor_id"], score, ids, labels)


def _table(rows: list[tuple], ddl: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(ddl)], names=[n for n, _ in ddl])


LONG = pa.int64()


def _positives(k: int):
    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(a["anchor_id"], a["anchor_key"], i, s) for a, found in _cells("dim", left, right) for i, s in found.same(a["label"], k)]
        return _table(out, [(n, LONG) for n in ("anchor_id", "anchor_key", "positive_id", "positive_score")])

    return over


def _negatives(k: int, lower: int, upper: int):
    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a, found in _cells("dim", left, right):
            within = found.other(a["label"])
            for place, p in enumerate(a["positives"]):
                out += [(a["anchor_id"], a["anchor_key"], place, p["positive_id"], p["positive_score"], i, s) for i, s in within(p["positive_score"], k, lower, upper)]
        return _table(out, [(n, LONG) for n in ("anchor_id", "anchor_key", "place", "positive_id", "positive_score", "negative_id", "negative_score")])

    return over


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, block_rows: int | None = None
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on ``vectors``. Rows with a null id, label or vector, or a
    null or non-finite component take no part; equal rows are one. Rows that share an id but
    not label and vector are each there, but none is a candidate of an anchor of that id.
    Vectors of different lengths have no score; empty ones score 0 with each other. Ties go
    to the smaller id. An anchor without positives, or a positive without negatives within
    its limits, has no row; an empty table gives none. Columns beside the three named are
    left out. Scores beyond 64 bits are an error.
    """
    there = vectors.where(F.col(id_col).isNotNull() & takes_part(F.col(vector_col), F.col(label_col)))
    rows = there.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).distinct()
    rows = written(rows.withColumn("dim", F.size("vector")), "mining-rows")
    there = rows.agg(F.count("*"), F.max("dim"), F.count_if("is_anchor")).first()
    most = block_rows or max(1, min(BLOCK_BYTES // (8 * max(1, there[1] or 0)), -(-there[0] // LEAST_BLOCKS)))
    blocks, lots = max(1, -(-there[0] // most)), max(1, -(-there[2] // most))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["lot", "block", "dim"]
    candidates = rows.select("vec_id", "label", "vector", "dim", deal(blocks).alias("block"), each(lots).alias("lot"))
    asked = rows.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vector").alias("anchor_key"), "label", "vector", "dim", deal(lots).alias("lot"))

    def met(frame: DataFrame, over, ddl: str) -> DataFrame:
        spread = frame.withColumn("block", each(blocks))
        return spread.toDF(*spread.columns).groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(over, ddl)

    anchor = "anchor_id bigint, anchor_key bigint"
    positive = "positive_id bigint, positive_score bigint"
    first = met(asked, _positives(positives), f"{anchor}, {positive}")
    best = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    first = first.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    first = written(first, "positives")  # a lost executor doesn't cost the first pass again
    found = met(asked.join(first, ["anchor_id", "anchor_key"]), _negatives(negatives, lower, upper), f"{anchor}, place bigint, {positive}, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Of the query: anchors, and the rows whose label is moved on by one of ten first.
ANCHOR_EVERY = 100
MOVED_EVERY = 7
LABELS = 10


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % ANCHOR_EVERY == 0)


ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 100 = 0 AND a.vec_id != r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
