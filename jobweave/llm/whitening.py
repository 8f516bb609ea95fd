"""Whitening of vectors with distributed block matrices.

Entries become whole numbers ``floor(1024 c) + 100000``. Their sums are exact, so the
centred rows ``(n x - S) / n`` are as good as a double can hold. The rows are numbered
without gaps and laid into a ``BlockMatrix``; its transpose times itself is the scatter,
whose inner dimension (the rows) is split over many tasks; the scatter, vectors' length
squared and no larger, is decomposed on the driver; and the centred matrix times the
whitening matrix, again as block matrices, projects every row.

The driver holds the sums, the scatter and the decomposition, which depend on the length
of the vectors only, and MLlib lists the places of the blocks there, one per ``ROWS`` rows.
Rows and results are tables of the shared folder.

Defined results: a row whose vector is null, empty, or holds a null or a non-finite entry
is dropped, and so is one of another length than most vectors (of equally frequent lengths
the largest stays). Entries beyond 2^52 / 1024 in size count as that size. Repeated rows and
null or repeated ids are rows of their own. Components come by falling eigenvalue, ties in
the order of the decomposition; of either sign, the one whose largest entry is positive is
taken. A component without variance (an eigenvalue of at most 10^-12 of the largest) has the
whitened value null and does not count in ``identity_error``, which is null if there is no
other one; ``explained`` is null if no component has variance. ``deviation`` is null where it
needs more than 64 bits. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.session import stage

#: Components that are returned.
COMPONENTS = 8
#: Rows and columns of a block.
ROWS, COLUMNS = 1024, 1024
#: Blocks of rows whose products one task adds up.
BLOCKS_A_TASK = 4
#: A smaller share of the largest eigenvalue counts as no variance.
SMALLEST = 1e-12
_LARGEST = float(1 << 52)


def whole_numbers(vector: Column) -> Column:
    """``floor(1024 c) + 100000`` of each entry; null for a vector without entries or with a null or non-finite one."""
    wide = lambda c: c.cast("double")
    value = lambda c: F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), wide(c) * 1024))) + 100000
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(wide(c)) | (F.abs(wide(c)) == float("inf")))
    return F.when(~bad & (F.size(vector) > 0), F.transform(vector, value))


def numbered_rows(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, x, at): usable rows of the commonest length, numbered from 0 without gaps."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), whole_numbers(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    commonest = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("x") == (commonest["size"] if commonest else 0))
    rows = stage(rows.withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "vectors")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    shifts = parts.select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shifts, "part").select("vec_id", "x", (F.col("id") + F.col("shift")).alias("at"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each entry, exact: upper and lower 32 bits are added apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = 0
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                n += len(x)
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            size = len(low)
            yield pa.RecordBatch.from_pydict({"at": np.arange(size), "n": np.full(size, n), "high": high, "low": low})

    sums = rows.select("x").mapInArrow(add, "at bigint, n bigint, high bigint, low bigint")
    total = sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
    return (total[0]["n"] if total else 0), [(r["high"] << 32) + r["low"] for r in total]


def centre(n: int, sums: list[int], x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """Rows of ``x - S / n`` and the sum of squares of ``n x - S`` of each row."""
    rough = n * x.astype(float) - np.array(sums, float)
    squares = (rough**2).sum(1)
    # whole numbers wrap at 64 bits, so what fits in the end is exact
    with np.errstate(over="ignore"):
        exact = x * np.int64(n) - np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)
        deviation = (exact * exact).sum(1).tolist()
    for k in np.flatnonzero(squares > float(1 << 62)):
        whole = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums))
        deviation[k] = whole if whole < 1 << 63 else None
    small = np.abs(rough) < float(1 << 62)
    return np.where(small, exact.astype(float), rough) / n, deviation


def centred_rows(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(vec_id, at, c, deviation) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, deviation = centre(n, sums, matrix_of(batch.column(1)))
                ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, pa.array(deviation, pa.int64())], names=["vec_id", "at", "c", "deviation"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x", "at").mapInArrow(run, f"vec_id {kind}, at bigint, c array<double>, deviation bigint")


def block_matrix(centred: DataFrame, n: int, size: int) -> BlockMatrix:
    rows = MLUtils.convertVectorColumnsFromML(centred.select("at", array_to_vector("c").alias("c")), "c")
    return IndexedRowMatrix(rows, n, size).toBlockMatrix(ROWS, COLUMNS)


def multiply(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """``a`` times ``b`` with the inner dimension cut into ``splits``, so that a small product of long matrices is many tasks."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def decompose(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors in columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def columns_of(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix in blocks that fit the columns of the rows' blocks."""
    parts = [((k // COLUMNS, 0), matrix[k : k + COLUMNS]) for k in range(0, len(matrix), COLUMNS)]
    blocks = spark.sparkContext.parallelize([(at, DenseMatrix(*m.shape, m.ravel(order="F"))) for at, m in parts], 1)
    return BlockMatrix(blocks, COLUMNS, matrix.shape[1], *matrix.shape)


def table_of(matrix: BlockMatrix) -> DataFrame:
    """(at, z) of every row of a block matrix, without a detour through Python objects."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("at"), vector_to_array("vector").alias("z"))


def identity_error(rows: DataFrame, used: list[int]) -> float | None:
    """Largest absolute entry of the covariance of ``z`` minus the identity, over these components."""
    pairs = [(i, j) for i in used for j in used if i <= j]
    if not pairs:
        return None
    z = lambda k: F.col("z")[k]
    found = rows.agg(*[F.covar_pop(z(i), z(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    spark = vectors.sparkSession
    rows = numbered_rows(vectors, id_column, vector)
    n, sums = exact_sums(rows)
    if not n:
        empty = "int component, long n, long deviation, double whitened, double explained, double identity_error".split(", ")
        nothing = [F.lit(None).cast(t).alias(c) for t, c in (e.split() for e in empty)]
        return vectors.limit(0).select(F.col(id_column), *nothing)
    centred = stage(centred_rows(rows, n, sums), "centred")
    matrix = block_matrix(centred, n, len(sums))
    splits = max(1, -(-n // (ROWS * BLOCKS_A_TASK)))
    covariance = multiply(matrix.transpose(), matrix, splits).toLocalMatrix().toArray() / n
    values, axes = decompose(covariance, components)
    trace = float(np.trace(covariance))
    some = values > SMALLEST * max(values[0], np.finfo(float).tiny)
    weights = axes * np.where(some, 1 / np.sqrt(np.where(some, values, 1)), 0)
    projected = stage(table_of(multiply(matrix, columns_of(spark, weights), 1)), "whitened")
    error = identity_error(projected, np.flatnonzero(some).tolist())
    shares = [float(v / trace) if trace > 0 else None for v in values]
    entries = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.col("z")[k] if some[k] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(shares[k]).cast("double").alias("explained"),
        )
        for k in range(len(values))
    ]
    return (
        centred.select("vec_id", "at", "deviation").join(projected, "at")
        .select("vec_id", "deviation", F.explode(F.array(*entries)).alias("e"))
        .select(
            F.col("vec_id").alias(id_column), "e.component", F.lit(n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
