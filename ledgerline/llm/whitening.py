"""Operator 13: whitening of embeddings by PCA over Spark MLlib's BlockMatrix.

Every entry c becomes the whole number x = floor(scale * c) + offset. Column sums S are exact, and a
row is centred as (n * x - S) / n with the difference in whole numbers, so that nothing cancels in
doubles. The centred rows get gapless indices and are cut into a BlockMatrix (``ROWS`` x ``COLS``);
its transpose times itself is the scatter, whose eigenvectors numpy finds on the driver (a matrix of
the embedding's dimensions, whatever the number of rows); the BlockMatrix of the rows times that of
the scaled eigenvectors gives the whitened rows. A third product measures how far their covariance
is from the identity. Products that sum over all rows are split along them (``numMidDimSplits``),
so no task multiplies more than a share of the rows' blocks.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped. All
vectors of a table share one length; where lengths differ, those of the commonest (of several, the
longest) are the table and the others are dropped. Components without variance (an eigenvalue under
dimensions * 2^-52 of the largest) can't be whitened and are left out, so a single vector, or equal
ones only, give no rows. A null id stays null; repeated rows are rows of their own; ``deviation`` is
summed in 38 digits and fails, rather than wraps, if it is over 2^63 - 1; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
ROWS, COLS = 1024, 1024  # of a block
SPLIT_BLOCKS, MAX_SPLITS = 8, 2048  # a product over all rows is dealt to a task for so many row blocks, to so many tasks at most


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x array<long>, index from 0 without gaps): the vectors that take part."""
    v = F.col(vector_col)
    fit = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.coalesce(fit, F.lit(False)))
    sizes = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    rows = rows.where(F.size(v) == (sizes["d"] if sizes else 0)).select(F.col(id_col).alias("id"), x.alias("x"))
    # numbers of a written table: partition, then row; the partitions' counts make them gapless
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "whiten-x")
    part = F.shiftright("row", 33).alias("part")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    index = F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part", part).join(counts, "part").select("id", "x", index.alias("index"))


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """BlockMatrix of (index, v array<double>). IndexedRowMatrix makes one too, but moves every entry as an object of its own."""

    def cut(table: pa.Table) -> pa.Table:
        index = table.column("index").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(index), d)[np.argsort(index)]
        block = [index[0] // ROWS] * len(range(0, d, COLS))
        data = [flat[:, j:j + COLS].tobytes(order="F") for j in range(0, d, COLS)]
        return pa.table({"i": pa.array(block, pa.int64()), "j": pa.array(range(len(data)), pa.int64()),
                         "height": pa.array([len(index)] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    pieces = rows.select("index", "v").groupBy(F.expr(f"index div {ROWS}")).applyInArrow(cut, "i long, j long, height long, data binary")
    pieces = materialize(pieces, "whiten-blocks")
    as_block = pieces.rdd.map(lambda r: ((r["i"], r["j"]), DenseMatrix(r["height"], len(r["data"]) // 8 // r["height"],
                                                                      np.frombuffer(r["data"]))))
    return BlockMatrix(as_block, ROWS, COLS, n, d).persist(StorageLevel.MEMORY_AND_DISK)


def let_go(m: BlockMatrix) -> None:
    m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself, on the driver: columns x columns.

    The plain product would send all row blocks of a column to one task; MLlib splits the summed
    dimension if told how often, which its Python class does not pass on.
    """
    splits = min(MAX_SPLITS, -(-m.numRows() // (SPLIT_BLOCKS * ROWS)))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def rows_of(m: BlockMatrix, names: tuple[str, str]) -> DataFrame:
    """(index, array<double>) of a matrix of one column of blocks."""

    def rows(block) -> list:
        (i, _), piece = block
        return [(i * ROWS + k, row) for k, row in enumerate(piece.toArray().tolist())]

    return m.blocks.flatMap(rows).toDF(f"{names[0]} long, {names[1]} array<double>")


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x components matrix that whitens, share of variance explained by each), by falling eigenvalue."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    least = max(values[0], 0.0) * len(values) * 2.0 ** -52
    k = min(components, int((values > least).sum()))
    return vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """(id, n, deviation, whitened array<double>, explained array<double>, identity_error) for every vector that takes part."""
    spark = rows.sparkSession
    x = whole_vectors(rows, id_col, vector_col, scale, offset)
    id_type = dict(x.dtypes)["id"]
    sums = x.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    sums = sorted(tuple(r) for r in sums.collect())  # a row for each dimension
    nothing = spark.createDataFrame([], f"id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, "
                                        "identity_error double").withColumnRenamed("id", id_col)
    if not sums:
        return nothing
    d, n = len(sums), sums[0][2]
    away = F.zip_with("x", F.array(*[F.lit(s) for _, s, _ in sums]), lambda c, s: c * n - s)
    square = F.aggregate("away", F.lit(0).cast("decimal(38,0)"),
                         lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    centred = x.withColumn("away", away)
    centred = centred.select("index", "id", square.cast("long").alias("deviation"), F.transform("away", lambda c: c / n).alias("v"))
    centred = materialize(centred, "whiten-centred")
    blocks = block_matrix(centred, n, d)
    matrix, explained = whitening_matrix(scatter(blocks) / n, min(components, COLS))
    k = matrix.shape[1]
    if not k:
        return nothing
    pieces = [((i // COLS, 0), Matrices.dense(len(p), k, p.ravel(order="F").tolist())) for i in range(0, d, COLS) for p in [matrix[i:i + COLS]]]
    projected = blocks.multiply(BlockMatrix(spark.sparkContext.parallelize(pieces, len(pieces)), COLS, COLS, d, k))
    projected = projected.persist(StorageLevel.MEMORY_AND_DISK)
    found = materialize(rows_of(projected, ("index", "whitened")), "whiten-projected")
    # rows projected from centred ones are centred
    error = float(np.abs(scatter(projected) / n - np.eye(k)).max())
    let_go(blocks)
    let_go(projected)
    out = centred.select("index", "id", "deviation").join(found, "index")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(float(e)) for e in explained]).alias("explained"), F.lit(error).alias("identity_error"))
