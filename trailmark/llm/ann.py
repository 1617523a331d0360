"""Operator 9, approximate nearest neighbours by inner product: an HNSW graph per shard.

Rows are dealt to shards of up to ``SHARD_ROWS`` by a hash of their id. Each shard's graph is
a table of nodes with flat neighbour arrays; equal vectors are one node with all their
ids. A task holds the graphs of up to ``PACK`` shards and is sent every query once, in a
stream behind its nodes; what its shards find is merged there, then over the tasks. So
every query meets every shard: with a share of the rows as queries, the work grows with
queries times shards, and the large shards keep that product small.

Largest inner product is made a matter of distance by one more component that brings
all vectors of a shard to the same length; scores are worked out again in double
precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hnsw
from .common import written

SHARD_ROWS = 65_536
#: Smaller tables are dealt to up to ``LEAST_SHARDS`` shards, none of less than ``FEW_ROWS`` on average.
FEW_ROWS = 4_096
LEAST_SHARDS = 4
#: Most graphs that a task holds at once.
PACK = 8
LINKS = 16
BUILD_WIDTH = 48
SEARCH_WIDTH = 200
K = 20
EVERY = 20
INDEX = "dim int, shard int, node int, ids array<bigint>, vector {}, near array<int>"


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _even(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in one more dimension, in the same order of inner products."""
    wide = vectors.astype(np.float64)
    wide /= np.sqrt((wide**2).sum(axis=1)).max()
    rest = np.sqrt(np.maximum(0, 1 - (wide**2).sum(axis=1, keepdims=True)))
    return np.concatenate([wide, rest], axis=1).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _kind(vectors: DataFrame, column: str) -> str:
    """The vectors' own precision: doubles stay doubles."""
    return "array<double>" if vectors.schema[column].dataType.simpleString() == "array<double>" else "array<float>"


def _built(links: int, width: int, kind: str):
    number = pa.float64() if kind == "array<double>" else pa.float32()

    def over(shard: pa.Table) -> pa.Table:
        dim = shard["dim"][0].as_py()
        vectors = _matrix(shard["vector"].combine_chunks(), dim)
        ids = shard["vec_id"].to_numpy()
        # A negative zero is a zero: equal vectors are one node.
        unique, inverse = np.unique(vectors + vectors.dtype.type(0), axis=0, return_inverse=True)
        shuffled = np.random.default_rng(len(unique)).permutation(len(unique))
        unique = unique[shuffled]
        node = np.argsort(shuffled)[inverse.reshape(-1)]
        order = np.lexsort((ids, node))
        ends = np.cumsum(np.bincount(node, minlength=len(unique)))
        layers = hnsw.build(_even(unique), links, width)
        near = [np.concatenate([x[k] for x in layers if k < len(x)]).astype(np.int32) for k in range(len(unique))]
        return pa.table(
            {
                "dim": pa.array(np.full(len(unique), dim, np.int32)),
                "shard": pa.array(np.full(len(unique), shard["shard"][0].as_py(), np.int32)),
                "node": pa.array(np.arange(len(unique), dtype=np.int32)),
                "ids": pa.array(np.split(ids[order], ends[:-1]), pa.list_(pa.int64())),
                "vector": pa.array(list(unique), pa.list_(number)),
                "near": pa.array(near, pa.list_(pa.int32())),
            }
        )

    return over


def index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = BUILD_WIDTH) -> tuple[DataFrame, int]:
    """The graphs of all usable rows, a node a row, and the number of shards.

    Every usable row with an id is in the index; vectors of different lengths have
    graphs of their own, as they have no inner product with each other. A shard is
    one task's work and bounded by ``shard_rows``. Rows that repeat an id or a vector are
    all there; an empty table gives an empty index. Other columns are left out.
    """
    kind = _kind(vectors, vector_col)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.size(vector_col).alias("dim"))
    number = rows.count()
    shards = max(1, -(-number // shard_rows), min(LEAST_SHARDS, -(-number // FEW_ROWS)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return written(rows.groupBy("dim", "shard").applyInArrow(_built(links, width, kind), INDEX.format(kind)), "graphs"), shards


class Shard:
    """A shard's graph, read back from its nodes."""

    def __init__(self, nodes: list[pa.Table], dim: int, links: int):
        table = pa.concat_tables(nodes).sort_by("node").combine_chunks()
        self.vectors = _matrix(table["vector"].combine_chunks(), dim)
        self.even = _even(self.vectors)
        ids = table["ids"].combine_chunks()
        self.ids, self.offsets = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        near = table["near"].combine_chunks()
        flat, size = near.flatten().to_numpy().astype(np.int64), near.value_lengths().to_numpy()
        start = np.append(0, np.cumsum(size))[:-1]
        self.layers = []
        for k in range(1 + (int(size[0]) - 2 * links) // links):
            first, most = (0, 2 * links) if k == 0 else ((k + 1) * links, links)
            inside = start[size >= first + most] + first
            self.layers.append(flat[inside[:, None] + np.arange(most)])

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, width: int) -> Iterator[list[tuple[float, int]]]:
        """For each query (with its own id) its ``k`` best as (-score, id), in order."""
        zero = np.zeros((len(queries), 1))
        queries = queries.astype(np.float64)
        scaled = np.concatenate([queries / np.sqrt((queries**2).sum(axis=1, keepdims=True)), zero], axis=1)
        places = hnsw.search(self.even, self.layers, scaled.astype(np.float32), width)
        score = np.zeros(places.shape)
        for d in range(queries.shape[1]):  # from the first component to the last, in double precision
            score += queries[:, d : d + 1] * self.vectors[np.maximum(places, 0), d].astype(np.float64)
        score[places < 0] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")
        for q in range(len(queries)):
            found: list[tuple[float, int]] = []
            for at in order[q]:
                p, s = places[q, at], score[q, at]
                if p < 0 or len(found) >= k and -s > found[k - 1][0]:
                    break
                # One more than k of a node's ids: one may be the query's own.
                same = self.ids[self.offsets[p] : min(self.offsets[p + 1], self.offsets[p] + k + 1)]
                found += [(-float(s), int(i)) for i in same if i != own[q]]
                found.sort()
            yield found[:k]


def _searched(links: int, k: int, width: int):
    kind = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answers(held: list[Shard], rows: pa.Table, dim: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), hnsw.BATCH):
            part = rows.slice(at, hnsw.BATCH)
            own, keys = part["query_id"].to_pylist(), part["query_key"].to_pylist()
            queries = _matrix(part["vector"].combine_chunks(), dim)
            found = zip(*(shard.nearest(queries, np.array(own), k, width) for shard in held))
            out = [(q, y, i, -s) for q, y, f in zip(own, keys, found) for s, i in sorted(x for one in f for x in one)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind.field(c).type) for c in range(4)], schema=kind)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, shards = None, {}, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[c].to_numpy() for c in ("dim", "kind", "shard")], axis=1)
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(axis=1))[0] + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, query, number = marks[a].tolist()
                if dim != held:
                    held, nodes, shards = dim, {}, []
                if not query:
                    nodes.setdefault(number, []).append(table.slice(a, b - a).select(["node", "ids", "vector", "near"]))
                    continue
                while nodes:
                    shards.append(Shard(nodes.pop(min(nodes)), dim, links))
                if shards:
                    yield from answers(shards, table.slice(a, b - a), dim)

    return over


def search(graphs: DataFrame, shards: int, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, links: int = LINKS, width: int = SEARCH_WIDTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found, its own id left out.

    Queries with unusable vectors or without an id have no result; repeated ones have
    one. Ties go to the smaller ``vec_id``; if there are fewer than ``k`` candidates,
    all that were found are there. An empty index or table of queries gives an empty
    result. Scores are of the original vectors, floats or doubles as the table has them.
    """
    tasks = max(min(shards, LEAST_SHARDS), -(-shards // PACK))
    kind = dict(graphs.dtypes)["vector"]
    asked = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    asked = asked.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast(kind).alias("vector"), F.size(vector_col).alias("dim")).distinct()
    asked = asked.select("dim", F.lit(-1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).alias("kind"), "query_id", F.xxhash64("vector").alias("query_key"), "vector")
    stream = graphs.withColumn("kind", F.lit(0)).withColumn("task", F.col("shard") % tasks).unionByName(asked, allowMissingColumns=True)
    stream = stream.select("task", "shard", "dim", "kind", "node", "ids", "vector", "near", "query_id", "query_key")
    dealt = stream.repartitionById(tasks, F.col("task")).sortWithinPartitions("dim", "kind", "shard")
    found = dealt.mapInArrow(_searched(links, k, width), "query_id bigint, query_key bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    graphs, shards = index(vectors)
    return search(graphs, shards, vectors.where(F.col("vec_id") % EVERY == 0))
