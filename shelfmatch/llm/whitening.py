"""Whitening of embeddings from a bit-sliced scatter matrix (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import saved, table

#: Entries of this size and more do not fit the exact sums; their rows are set aside as non-finite ones are.
LARGEST = float(1 << 32)
#: Rows whose bit planes are counted at once; columns of decimal digits that an exact deviation may have.
BLOCK, DIGITS = 8192, 38


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative whole numbers (rows by dimensions): words, and dimension and bit of each.

    A plane is one bit of one dimension over all rows, 64 rows a word, the last word filled with
    zeros. Each dimension has as many planes as its largest value needs.
    """
    sizes = [int(v).bit_length() for v in values.max(axis=0)]
    dims, bits = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]).astype(np.int64)
    planes = np.zeros((len(dims), -(-len(values) // 64) * 64), bool)
    planes[:, : len(values)] = (values.T[dims] >> bits[:, None]) & 1
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64), dims, bits


def cross_products(values: np.ndarray) -> np.ndarray:
    """Exact ``values.T @ values`` of non-negative whole numbers, upper half, by counting shared bits.

    Two planes with weights ``2 ** a`` and ``2 ** b`` add ``2 ** (a + b)`` for every row that has
    both bits, and those rows are the population count of their AND.
    """
    words, dims, bits = packed(values)
    top = 2 * int(bits.max(initial=0)) + len(values).bit_length() + len(bits).bit_length()
    kind = np.int64 if top < 62 else object
    out = np.zeros((values.shape[1],) * 2, kind)
    weights = np.array([1 << int(b) for b in bits], kind)
    for k in range(len(dims)):
        shared = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64).astype(kind) * weights[k:] * weights[k]
        shared[1:][dims[k + 1 :] == dims[k]] *= 2  # two bits of one dimension meet in either order
        first = np.flatnonzero(np.diff(dims[k:], prepend=-1))
        out[dims[k], dims[k:][first]] += np.add.reduceat(shared, first)
    return out


def scatter(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products (Python numbers) of signed whole numbers, added up block by block.

    A block is shifted to start at zero in each dimension, which keeps its planes few; the shift is
    put back by exact arithmetic.
    """
    width = values.shape[1]
    sums, products = np.zeros(width, object), np.zeros((width, width), object)
    for at in range(0, len(values), BLOCK):
        block = values[at : at + BLOCK]
        least = block.min(axis=0)
        moved = block - least
        part, back = moved.sum(axis=0).astype(object), least.astype(object)
        products += cross_products(moved).astype(object)
        products += np.outer(part, back) + np.outer(back, part) + len(block) * np.outer(back, back)
        sums += part + len(block) * back
    return len(values), sums, products


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, width)


def fit(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and products over all of ``vectors``; the driver reads one number per pair of dimensions.

    Every task adds up its rows and sends one number a pair; Spark adds those, as exact decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            more, s, p = scatter(matrix(batch, width))
            n, sums, products = n + more, sums + s, products + p
        if n:
            rows = [(-1, -1, n), *[(-1, i, x) for i, x in enumerate(sums)]]
            rows += [(i, j, products[i, j]) for i in range(width) for j in range(i, width)]
            i, j, x = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, x), pa.string())], names=["i", "j", "x"])

    parts = vectors.select("__v").mapInArrow(run, "i int, j int, x string")
    total = {(r.i, r.j): int(r.x) for r in parts.groupBy("i", "j").agg(F.sum(F.col("x").cast(f"decimal({DIGITS},0)")).alias("x")).collect()}
    products = [[total.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)]
    return total.get((-1, -1), 0), [total.get((-1, i), 0) for i in range(width)], products


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the trace of the covariance.

    ``n * products - sums * sums`` is the covariance times ``n * n`` in whole numbers; only then does
    it become a double, rounded once.
    """
    centred = np.array([[(n * p - a * b) / (n * n) for p, b in zip(row, sums)] for row, a in zip(products, sums)])
    values, vectors = np.linalg.eigh(centred)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    # Either sign is right; the largest entry is made positive, so that runs agree.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs, float(np.trace(centred))


def _valid(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False)) & (F.size(vector) > 0)


def whitened(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: int = 64
) -> DataFrame:
    """Project every vector on the leading components of all vectors, each scaled to unit variance.

    Entries become whole numbers ``floor(scale * c)``; the fit covers all rows left. Set aside are
    rows whose vector is null or empty, holds a null, a non-finite entry or one of 2 ** 32 and more,
    or has another length than most vectors (of lengths equally common, the longer). A component
    without variance (vectors all alike, or fewer than dimensions) has null in ``whitened``.

    Returns one row per row left, identifiers null or repeated as they are: ``id``, ``n`` (rows
    of the fit), ``deviation`` (decimal: exact sum over dimensions of ``(n * x - S) ** 2``, null where
    38 digits do not hold it), ``whitened`` (array by falling eigenvalue), ``explained`` (array of the
    shares of the trace, null where it is zero) and ``identity_error``, the largest entry of the
    covariance of the whitened values minus the identity. Other columns are not read.
    """
    vectors = df.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__c")).where(_valid(F.col("__c")))
    widths = vectors.groupBy(F.size("__c").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    found = widths.orderBy(F.desc("n"), F.desc("w")).first()
    width = found["w"] if found else 1
    whole = vectors.where(F.size("__c") == width).select("__id", F.transform("__c", lambda c: F.floor(c * scale)).alias("__v"))
    n, sums, products = fit(whole, width)
    values, axes, trace = components(max(n, 1), sums, products, min(most, width))
    varies = values > max(float(values[0]), 0.0) * width * 1e-15
    scaled = axes / np.sqrt(np.where(varies, values, 1.0))
    mean, rest = np.array([s // max(n, 1) for s in sums], np.int64), np.array([s % max(n, 1) for s in sums], object)
    near = rest.astype(float) / max(n, 1)

    def deviations(moved: np.ndarray) -> list[Decimal | None]:
        """Exact: with ``t = x - mean`` the sum is ``n * n * t.t - 2 * n * t.rest + rest.rest``."""
        own = rest.astype(np.int64) if n < 1 << 62 else rest
        most_here = int(np.abs(moved).max(initial=0)) + 1
        if width * most_here * max(most_here, n) < 1 << 62:
            squares, mixed = (moved * moved).sum(axis=1).tolist(), (moved @ own).tolist()
        else:
            big = moved.astype(object)
            squares, mixed = (big * big).sum(axis=1).tolist(), (big @ rest).tolist()
        fixed = int((rest * rest).sum())
        exact = [n * n * s - 2 * n * m + fixed for s, m in zip(squares, mixed)]
        return [Decimal(x) if x < 10**DIGITS else None for x in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = matrix(batch, width) - mean
            out = (moved - near) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            exact = pa.array(deviations(moved), pa.decimal128(DIGITS, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], names=["__id", "deviation", "__w"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(values)
        total, sums_here = np.zeros((wide, wide)), np.zeros(wide)
        for batch in batches:
            rows = matrix(batch, wide)
            total, sums_here = total + rows.T @ rows, sums_here + rows.sum(axis=0)
        cells = np.vstack([total, sums_here]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["i", "x"])

    schema = T.StructType([T.StructField("__id", df.schema[id_col].dataType), T.StructField("deviation", T.DecimalType(DIGITS, 0)),
                           T.StructField("__w", T.ArrayType(T.DoubleType()))])
    rows = saved(whole.mapInArrow(run, schema))
    cells = {r.i: r.x for r in rows.select("__w").mapInArrow(spread, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    wide = len(values)
    square = np.array([cells.get(i, 0.0) for i in range(wide * (wide + 1))]).reshape(wide + 1, wide) / max(n, 1)
    apart = np.abs(square[:wide] - np.outer(square[wide], square[wide]) - np.eye(wide))[np.ix_(varies, varies)]
    # A literal per component, not per row: numbers of the fit, bounded by ``most``.
    kept = F.array(*[F.lit(bool(v)) for v in varies])
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    return rows.select(
        F.col("__id").alias("id"), F.lit(n).cast("long").alias("n"), "deviation",
        F.transform("__w", lambda x, i: F.when(F.get(kept, i), x)).alias("whitened"), shares.alias("explained"),
        F.lit(float(apart.max(initial=0.0))).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component; ``deviation`` is null where a long does not hold it."""
    rows = whitened(table(spark, sf_dir, "embeddings"))
    return rows.select("*", F.posexplode("whitened").alias("__at", "__value")).select(
        F.col("id").alias("vec_id"), (F.col("__at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("__value").alias("whitened"), F.get("explained", F.col("__at")).alias("explained"), "identity_error",
    )
