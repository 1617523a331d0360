"""Operator 13, embedding whitening by an exact scatter matrix in residues.

Entries become integers x. The scatter matrix of n*x - S (S: the sums of x) over the fit
list is a matrix of integers too large for doubles. Tasks work out its residues modulo
several primes, each by one matrix product of residues that stays below 2^53 and so is
exact in doubles; sums of residues are reduced in Spark, and Chinese remaindering gives the
exact matrix. What reaches the driver are sums per dimension and the scatter matrix, a
square of the dimension. Its eigenvectors come from one decomposition in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Rows of one product: with residues below 2^20 its sums stay below 2^53.
ROWS = 4_096
PRIME_BITS = 20
#: Entries up to 2^53 / SCALE are exact in doubles.
MOST = 1 << 53
#: Rows that one batch of results is made of.
OUT_ROWS = 1_024


def primes(bits: int) -> list[int]:
    """The largest primes below 2^20 whose product exceeds ``2 ** bits``."""
    out, product, at = [], 1, (1 << PRIME_BITS) - 1
    while product <= 1 << bits:
        if all(at % d for d in range(3, int(at**0.5) + 1, 2)):
            out.append(at)
            product *= at
        at -= 2
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least absolute value with these residues."""
    product = 1
    for p in moduli:
        product *= p
    x = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli)) % product
    return x - product if x > product // 2 else x


def _integers(id_col: str, vector_col: str, scale: int, shift: int, named: bool):
    """Vectors as rows of 64-bit integers, in bytes; null, empty and non-finite ones are left out."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(vector_col))
            sizes = vectors.value_lengths().fill_null(0).to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.append(0, np.cumsum(sizes))
            odd = np.append(0, np.cumsum(~np.isfinite(flat)))
            keep = np.flatnonzero((sizes > 0) & (odd[ends[1:]] == odd[ends[:-1]]))
            with np.errstate(invalid="ignore"):
                whole = np.floor(flat * scale)
            if (abs(whole[np.isfinite(whole)]) >= MOST - shift).any():
                raise ValueError("entries of these vectors exceed what is exact in double precision")
            whole = np.where(np.isfinite(whole), whole, 0).astype("<i8") + shift
            columns = [pa.array(sizes[keep], pa.int32()), pa.array([whole[ends[k] : ends[k + 1]].tobytes() for k in keep], pa.binary())]
            if named:
                columns.insert(0, batch.column(batch.schema.get_field_index(id_col)).take(pa.array(keep)))
            yield pa.RecordBatch.from_arrays(columns, names=[*([id_col] if named else []), "dim", "x"])

    return over


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """The integers of a column of bytes, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _whole(batch.column("x"), dim)
        for at in range(0, len(x), ROWS):
            yield x[at : at + ROWS]


def _sums(dim: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, [0] * dim, None, None
        for x in _blocks(batches, dim):
            n += len(x)
            # In two halves, as a block's sum of large integers might not fit.
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low)]
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total]), pa.array(least), pa.array(most)], names=["d", "n", "total", "least", "most"])

    return over


def _residues(dim: int, n: int, sums: list[int], moduli: list[int]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(moduli), dim, dim), np.int64)
        seen = False
        for x in _blocks(batches, dim):
            seen = True
            for k, p in enumerate(moduli):
                centred = ((n % p) * (x % p) - np.array([s % p for s in sums])) % p
                y = centred.astype(np.float64)
                held[k] = (held[k] + (y.T @ y).astype(np.int64)) % p
        if seen:
            i, j = np.triu_indices(dim)
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[k][i, j])], names=["k", "i", "j", "residue"])

    return over


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` finds for vectors of one length."""

    dim: int
    n: int
    sums: list[int]
    #: Largest absolute n*x - S there can be among rows of the fit list.
    reach: int
    values: np.ndarray
    #: A unit eigenvector per column.
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the exact integer n*x - S where that fits, else from Python's integers."""
        if self.fits(x):
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return np.array([[float(Fraction(self.n * v - s, self.n)) for v, s in zip(row, self.sums)] for row in x.tolist()]).reshape(x.shape)

    def fits(self, x: np.ndarray) -> bool:
        most = int(abs(x).max(initial=0))
        return self.n * most < 1 << 62 and max(map(abs, self.sums), default=0) < 1 << 62

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n*x - S)^2 for each row."""
        if self.fits(x):
            y = self.n * x - np.array(self.sums, np.int64)
            if self.dim * int(abs(y).max(initial=0)) ** 2 < 1 << 63:
                return (y * y).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def distinct(vectors: DataFrame, *, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(dim, x)``: each different vector of integers once, written to the shared folder."""
    x = vectors.select(vector_col).mapInArrow(_integers("", vector_col, scale, shift, False), "dim int, x binary")
    return written(x.distinct(), "whitening-fit")


def fit(once: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``distinct`` vectors of one length."""
    x = once.where(F.col("dim") == dim).select("x")
    parts = x.mapInArrow(_sums(dim), "d int, n bigint, total string, least bigint, most bigint")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    rows = sorted(parts.groupBy("d").agg(F.sum("n").alias("n"), total, F.min("least").alias("least"), F.max("most").alias("most")).collect())
    n, sums = rows[0]["n"], [int(r["total"]) for r in rows]
    reach = max(max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(rows, sums))
    moduli = primes((2 * n * reach * reach + 1).bit_length())
    found = x.mapInArrow(_residues(dim, n, sums, moduli), "k int, i int, j int, residue bigint")
    scatter = np.zeros((dim, dim))
    by: dict[tuple[int, int], list[int]] = {}
    for r in found.groupBy("i", "j", "k").agg(F.sum("residue").alias("residue")).collect():
        by.setdefault((r["i"], r["j"]), [0] * len(moduli))[r["k"]] = r["residue"]
    trace = 0
    for (i, j), residues in by.items():
        exact = remaindered(residues, moduli)
        scatter[i, j] = scatter[j, i] = float(Fraction(exact, n**3))
        trace += exact if i == j else 0
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(-values, kind="stable")[: min(components, dim)]
    order = order[values[order] > values.max(initial=0) * dim * np.finfo(float).eps]
    values, vectors = values[order], vectors[:, order]
    lead = np.take_along_axis(vectors, abs(vectors).argmax(axis=0)[None, :], axis=0)
    return Whitening(dim, n, sums, reach, values, vectors * np.sign(lead), float(Fraction(trace, n**3)))


def _products(model: Whitening):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(model.values)
        held = np.zeros((c, c))
        for x in _blocks(batches, model.dim):
            y = model.whitened(x)
            held += y.T @ y
        i, j = np.triu_indices(c)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[i, j])], names=["i", "j", "product"])

    return over


def identity_error(once: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity. Its mean is zero, as that of n*x - S is."""
    products = once.where(F.col("dim") == model.dim).select("x").mapInArrow(_products(model), "i int, j int, product double")
    rows = products.groupBy("i", "j").agg(F.sum("product").alias("product")).collect()
    return max((abs(r["product"] / model.n - (r["i"] == r["j"])) for r in rows), default=0.0)


def _results(id_col: str, model: Whitening, error: float, wide: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(model.values)
        explained = model.values / model.trace if c else model.values
        for batch in batches:
            for at in range(0, len(batch), OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                x = _whole(part.column("x"), model.dim)
                deviation = model.deviation(x)
                if not wide and max(deviation, default=0) >= 1 << 63:
                    raise ValueError("a deviation exceeds 64 bits: ask for wide=True")
                kind = pa.string() if wide else pa.int64()
                told = pa.array([str(v) for v in deviation] if wide else deviation, kind)
                each = pa.array(np.repeat(np.arange(len(x)), c))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(c * len(x), model.n, np.int64)),
                        told.take(each),
                        pa.array(model.whitened(x).reshape(-1)),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(c * len(x), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return over


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, wide: bool = False) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    Vectors that are null, empty or hold null or non-finite entries have no rows; a null id
    stays null, repeated rows have rows each but count once in the fit. Vectors of each
    length are whitened on their own. Components without variance are left out, so equal
    vectors alone have none; an empty table gives an empty result. Other columns are left
    out. Entries beyond 2^53 / ``scale`` are an error, and so is a deviation beyond 64 bits
    unless ``wide`` asks for a decimal.
    """
    kind = dict(vectors.dtypes)[id_col]
    ddl = f"`{id_col}` {kind}, component int, n bigint, deviation {'string' if wide else 'bigint'}, whitened double, explained double, identity_error double"
    once = distinct(vectors, vector_col=vector_col, scale=scale, shift=shift)
    rows = vectors.select(id_col, vector_col).mapInArrow(_integers(id_col, vector_col, scale, shift, True), f"`{id_col}` {kind}, dim int, x binary")
    out = None
    for (dim,) in sorted(once.groupBy("dim").count().select("dim").collect()):
        model = fit(once, dim, components)
        found = rows.where(F.col("dim") == dim).select(id_col, "x").mapInArrow(_results(id_col, model, identity_error(once, model), wide), ddl)
        out = found if out is None else out.unionByName(found)
    out = vectors.sparkSession.createDataFrame([], ddl) if out is None else out
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")) if wide else out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
