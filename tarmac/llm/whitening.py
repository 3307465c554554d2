"""Whitening of embeddings with MLlib's BlockMatrix.

Every distinct vector is a row of a matrix that is cut into blocks of rows. The centred blocks, transposed and multiplied with
themselves, give the scatter; its eigenvectors are found on the driver (a matrix of dimensions by dimensions), and a second block
multiplication projects all rows on them.

``BlockMatrix.multiply`` deals a product by the grid of its blocks, so that a tall product with one block column would use only the square
root of the partitions. The scatter therefore splits the middle dimension, and the projection folds the tall matrix into a square grid of
the same blocks and multiplies it with a block diagonal of the whitening matrix, which sends every block to one place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarmac.llm.tables import column
from tarmac.operators.ids import dense_id
from tarmac.sources.scratch import scratch_path, stage

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
# Memory of a block; beyond MOST_BLOCKS blocks their rows grow instead, as MLlib plans a product with all block coordinates on the driver.
BLOCK_BYTES = 1 << 20
MOST_BLOCKS = 1 << 16
# Blocks of each side that one task of the scatter multiplies.
BLOCKS_A_TASK = 4
# Components whose share of the largest eigenvalue is no more than this are rounding noise of a constant direction.
NOISE = 1e-12
# Larger entries have no exact long.
LARGEST = float(1 << 62)

_PLAIN_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def _matrices(spark: SparkSession, path: str) -> DataFrame:
    """block, matrix: blocks that were written as plain structs, or by MLlib, read as MLlib matrices."""
    return spark.read.schema(StructType([StructField("block", LongType()), StructField("matrix", MatrixUDT())])).parquet(path)


def _block_matrix(blocks: DataFrame, rows: int, columns: int, height: int, width: int, fold: int = 1):
    """The JVM's BlockMatrix of blocks (block, matrix), ``fold`` of them side by side in a row of the grid."""
    at = F.struct(F.expr(f"block div {fold}").alias("_1"), F.expr(f"block % {fold}").alias("_2"))
    return callMLlibFunc("createBlockMatrix", blocks.select(at.alias("_1"), F.col("matrix").alias("_2")), height, width, rows, columns)


def _gram(blocks: DataFrame, count: int, height: int, width: int) -> np.ndarray:
    """Transpose times matrix of a tall matrix; the sum over its rows is split over tasks."""
    tall = _block_matrix(blocks, count * height, width, height, width)
    product = tall.transpose().multiply(tall, max(1, math.ceil(count / BLOCKS_A_TASK)))
    found = BlockMatrix(product, width, width).toLocalMatrix().toArray()
    return (found + found.T) / 2


def _write_blocks(fit: DataFrame, height: int, path: str) -> None:
    """Rows (index, row) as blocks of ``height`` rows, in row-major order, which MLlib calls transposed."""
    rows = F.sort_array(F.collect_list(F.struct("index", "row")))
    fit.groupBy(F.expr(f"index div {height}").alias("block")).agg(rows.alias("rows")).select("block", F.expr("""
        named_struct('type', 1Y, 'numRows', size(rows), 'numCols', size(rows[0].row), 'colPtrs', CAST(NULL AS array<int>),
                     'rowIndices', CAST(NULL AS array<int>), 'values', flatten(rows.row), 'isTransposed', true)""").alias("matrix")).write.parquet(path)


def _project(spark: SparkSession, blocks: DataFrame, count: int, height: int, whitening: np.ndarray, path: str) -> None:
    """Write block, matrix of the product of the tall matrix with ``whitening``."""
    dimensions, components = whitening.shape
    fold = math.ceil(math.sqrt(count))
    square = _block_matrix(blocks, math.ceil(count / fold) * height, fold * dimensions, height, dimensions, fold)
    piece = DenseMatrix(dimensions, components, whitening.ravel(order="F"))
    # The diagonal has the square root of the number of blocks, 256 at most.
    diagonal = spark.createDataFrame([(i * fold + i, piece) for i in range(fold)],
                                     StructType([StructField("block", LongType()), StructField("matrix", MatrixUDT())]))
    right = _block_matrix(diagonal, fold * dimensions, fold * components, dimensions, components, fold)
    product = callMLlibFunc("getMatrixBlocks", square.multiply(right, 1))
    product.select(F.expr(f"CAST(_1._1 AS bigint) * {fold} + _1._2").alias("block"), F.col("_2").alias("matrix")).write.parquet(path)


def _exact(kind: str, name: str) -> str:
    return f"CAST({name} AS {kind})"


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: one row for every kept row and component.

    An entry c counts as the long x = floor(scale * c) + offset. The covariance is over the distinct x vectors, n of them; components
    are its unit eigenvectors by falling eigenvalue, with the sign that makes the largest entry positive. ``deviation`` is the exact sum
    of (n * x - S) squared, a decimal where a long is too small. ``identity_error`` is measured on the projected distinct rows.

    Rows go whose vector is null or empty or holds a null or non-finite entry, or one whose x is no long, or whose length is not the most
    frequent one (of equally frequent ones the largest). Rows that repeat an id or a vector are all returned; a null id is an id.
    Constant directions have no whitened value: there are as many components as the covariance has rank, none for one
    distinct vector, and then no rows. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    id_type = df.schema[id_column].dataType.simpleString()
    empty = spark.createDataFrame([], f"{column(id_column)} {id_type}, component int, n bigint, deviation bigint, whitened double, "
                                      "explained double, identity_error double")
    vector = df.select(F.col(column(id_column)).alias("id"), F.col(column(vector_column)).cast("array<double>").alias("v"))
    usable = f"size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs({scale} * c) < {LARGEST!r})"
    whole = vector.select("id", F.expr(f"CASE WHEN v IS NOT NULL AND {usable} THEN transform(v, c -> CAST(floor({scale} * c) AS bigint) + {offset}) END").alias("x"))
    own = stage(whole.where("x IS NOT NULL").select("id", F.md5(F.array_join(F.col("x").cast("array<string>"), ",")).alias("key"), "x"), "whitening-rows")
    widths = own.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return empty
    width = widths[0].width
    own = own.where(F.size("x") == width)
    fit = dense_id(own.groupBy("key").agg(F.first("x").alias("x")), name="index").withColumn("index", F.col("index") - 1)
    sums = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")
    ).orderBy("at").collect()
    n, total = sums[0].n, [int(row.s) for row in sums]
    # The largest n * x and n * x - S decide, in exact arithmetic, whether longs hold them and the sum of squares.
    product = max(n * max(abs(row.low), abs(row.high)) for row in sums)
    distance = max(max(abs(n * row.low - s), abs(n * row.high - s)) for row, s in zip(sums, total))
    kind = "bigint" if product + distance < 1 << 62 else "decimal(38,0)"
    square = "bigint" if width * distance ** 2 < 1 << 62 else "decimal(38,0)"
    apart = f"{_exact(kind, str(n))} * x[i] - {_exact(kind, 's[i]')}" if kind == "bigint" else f"CAST({n} AS decimal(19,0)) * CAST(x[i] AS decimal(19,0)) - CAST(s[i] AS {kind})"
    deviation = (f"aggregate(sequence(0, {width - 1}), CAST(0 AS {square}), (a, i) -> CAST(a + {_square(square, apart)} AS {square}))"
                 if width * distance ** 2 < 10 ** 37 else "CAST(NULL AS decimal(38,0))")
    literal = "array(" + ",".join(f"CAST('{s}' AS {kind})" for s in total) + ")"
    # S is a column of one row of constants rather than text repeated in every expression.
    centred = fit.withColumn("s", F.expr(literal)).select(
        "index", F.expr(f"transform(sequence(0, {width - 1}), i -> CAST({apart} AS double) / {n}D)").alias("row"))

    height = max(1, block_bytes // (8 * width), math.ceil(n / MOST_BLOCKS))
    count = math.ceil(n / height)
    path, projected = scratch_path(spark, "whitening-blocks"), scratch_path(spark, "whitening-projected")
    _write_blocks(centred, height, path)
    blocks = _matrices(spark, path)
    covariance = _gram(blocks, count, height, width) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > NOISE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    kept = min(components, rank)
    if not kept:
        return empty
    vectors = vectors[:, :kept] * np.sign(vectors[np.abs(vectors[:, :kept]).argmax(axis=0), np.arange(kept)])
    explained = values[:kept] / np.trace(covariance)
    _project(spark, blocks, count, height, vectors / np.sqrt(values[:kept]), projected)
    error = float(np.abs(_gram(_matrices(spark, projected), count, height, kept) / n - np.eye(kept)).max())

    found = spark.read.schema(f"block bigint, matrix {_PLAIN_MATRIX}").parquet(projected).select(F.col("block"), F.expr("""
        inline(transform(sequence(0, matrix.numRows - 1), r -> named_struct('row', r, 'z', transform(sequence(0, matrix.numCols - 1), j ->
            IF(matrix.isTransposed, matrix.values[r * matrix.numCols + j], matrix.values[j * matrix.numRows + r])))))""")
    ).select((F.col("block") * height + F.col("row")).alias("_index"), "z")
    facts = stage(fit.withColumn("s", F.expr(literal)).select("index", "key", F.expr(deviation).alias("deviation")).join(
        found, F.col("index") == F.col("_index")).select(F.col("key").alias("_key"), "deviation", "z"), "whitening-facts")
    shares = F.array(*(F.lit(float(share)) for share in explained))
    return own.select("id", "key").join(facts, F.col("key") == F.col("_key")).select(
        F.col("id"), "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def _square(kind: str, apart: str) -> str:
    return f"({apart}) * ({apart})" if kind == "bigint" else f"CAST({apart} AS decimal(19,0)) * CAST({apart} AS decimal(19,0))"
