"""Matrix algebra on coordinate tables (row, col, v): plans compose lazily and run as joins and grouped sums.

A Matrix is a DataFrame and a shape. Absent cells are zero; results keep only what their operands give. Row and column
numbers begin at 0. Joins are equi-joins on cell coordinates or on the inner index, left to Catalyst and adaptive
execution; hash-partitioned sums combine before the shuffle. Dense products and large
inverses go by blocks. No matrix leaves the executors.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions.scalar import ELEMENTWISE
from siteweave.operators import blocks

#: Largest order that inverse() takes in one task, which holds such a matrix twice.
MAX_INVERSE = 2048
#: Part of the cells from which a matrix is dense, and the number of cells from which that is asked.
DENSE = 0.1
LARGE = 1 << 14


class Matrix(NamedTuple):
    df: DataFrame
    nrow: int
    ncol: int

    # ---- unary ----
    def transpose(self) -> Matrix:
        return Matrix(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"), self.ncol, self.nrow)

    def scale(self, c: float) -> Matrix:
        return self._map(F.col("v") * F.lit(float(c)))

    def _map(self, v: Column) -> Matrix:
        return Matrix(self.df.select("row", "col", v.alias("v")), self.nrow, self.ncol)

    def apply(self, name: str) -> Matrix:
        """log, exp, sigmoid or inv of each cell of the dense matrix."""
        own = self if name in ("log", "inv") else self.dense()
        return own._map(ELEMENTWISE[name](F.col("v")))

    def apply_column(self, f) -> Matrix:
        return self.dense()._map(f(F.col("v")))

    def dense(self) -> Matrix:
        """With a row for every cell."""
        spark = self.df.sparkSession
        return Matrix(grid(spark, self.nrow, self.ncol).join(self.df, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v")), self.nrow, self.ncol)

    def resize(self, nrow: int, ncol: int) -> Matrix:
        """Cut or padded with zeros."""
        return Matrix(self.df.where((F.col("row") < nrow) & (F.col("col") < ncol)), nrow, ncol)

    def pad_pow2(self, rows: bool = True, cols: bool = True) -> Matrix:
        up = lambda n: 1 << max(0, n - 1).bit_length()
        return Matrix(self.df, up(self.nrow) if rows else self.nrow, up(self.ncol) if cols else self.ncol)

    def submatrix(self, row0: int, row1: int, col0: int, col1: int) -> Matrix:
        """Rows row0..row1 and columns col0..col1, both inclusive, renumbered."""
        own = self.df.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))
        return Matrix(own.select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "v"), row1 - row0 + 1, col1 - col0 + 1)

    def diagonal(self) -> Matrix:
        """The diagonal as a column."""
        return Matrix(self.df.where("row = col").select("row", F.lit(0).alias("col"), "v"), min(self.nrow, self.ncol), 1)

    def as_diagonal(self) -> Matrix:
        """A diagonal matrix of a vector."""
        self._vector()
        n = max(self.nrow, self.ncol)
        at = F.greatest("row", "col")
        return Matrix(self.df.select(at.alias("row"), at.alias("col"), "v"), n, n)

    def _vector(self) -> None:
        if 1 not in (self.nrow, self.ncol):
            raise ValueError(f"not a vector: {self.nrow} x {self.ncol}")

    def transpose_vector(self) -> Matrix:
        self._vector()
        return self.transpose()

    def expand_cols(self, n: int) -> DataFrame:
        """(k, row, col, v): for each column k, the matrix of n copies of it."""
        return self.df.select(F.col("col").alias("k"), "row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"), "v")

    def expand_rows(self, n: int) -> DataFrame:
        """(k, row, col, v): for each row k, the matrix of n copies of it."""
        return self.df.select(F.col("row").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("row"), "col", "v")

    # ---- binary ----
    def _same(self, other: Matrix) -> None:
        if (self.nrow, self.ncol) != (other.nrow, other.ncol):
            raise ValueError(f"shapes differ: {self.nrow} x {self.ncol} and {other.nrow} x {other.ncol}")

    def add(self, other: Matrix) -> Matrix:
        return add_all([self, other])

    def sub(self, other: Matrix) -> Matrix:
        return add_all([self, other.scale(-1)])

    def mul(self, other: Matrix) -> Matrix:
        """Cell by cell."""
        self._same(other)
        joined = self.df.alias("a").join(other.df.alias("b"), ["row", "col"])
        return Matrix(joined.select("row", "col", (F.col("a.v") * F.col("b.v")).alias("v")), self.nrow, self.ncol)

    def div(self, other: Matrix) -> Matrix:
        """Cell by cell; null where the divisor is zero."""
        self._same(other)
        joined = self.df.alias("a").join(other.df.alias("b"), ["row", "col"], "left")
        return Matrix(joined.select("row", "col", F.try_divide(F.col("a.v"), F.coalesce(F.col("b.v"), F.lit(0.0))).alias("v")), self.nrow, self.ncol)

    def matmul(self, other: Matrix, dense: bool | None = None) -> Matrix:
        """By blocks if both operands have DENSE of their cells, found by one count of both, else by a join of cells. dense: which, where the caller knows."""
        if self.ncol != other.nrow:
            raise ValueError(f"inner sizes differ: {self.ncol} and {other.nrow}")
        size = self.nrow * self.ncol, other.nrow * other.ncol
        if dense is None and min(*size, self.nrow * other.ncol) >= LARGE:
            n = dict(self.df.select(F.lit(0).alias("k")).unionAll(other.df.select(F.lit(1))).groupBy("k").count().collect())
            dense = all(n.get(k, 0) >= DENSE * size[k] for k in (0, 1))
        if dense:
            return self.matmul_blocked(other)
        a = self.df.select(F.col("row"), F.col("col").alias("k"), F.col("v").alias("x"))
        b = other.df.select(F.col("row").alias("k"), F.col("col"), F.col("v").alias("y"))
        return Matrix(a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v")), self.nrow, other.ncol)

    def matmul_blocked(self, other: Matrix, block: int = blocks.BLOCK) -> Matrix:
        """The product by dense blocks in numpy, added up as blocks: for dense operands, whose cells would each meet ncol others in a join."""
        if self.ncol != other.nrow:
            raise ValueError(f"inner sizes differ: {self.ncol} and {other.nrow}")
        own, its = blocks.blocked(self.df, self.nrow, self.ncol, block), blocks.blocked(other.df, other.nrow, other.ncol, block)
        return Matrix(blocks.cells(blocks.product(own, its), block), self.nrow, other.ncol)

    def row_dot(self, other: Matrix) -> Matrix:
        """Inner product of each two rows of the same number: a column."""
        both = self.mul(other).df
        return Matrix(both.groupBy("row").agg(F.sum("v").alias("v")).select("row", F.lit(0).alias("col"), "v"), self.nrow, 1)

    def scale_rows(self, d: Matrix) -> Matrix:
        """diag(d) times this; d is a vector or a square matrix whose diagonal counts. The diagonal matrix is never built."""
        at = _axis(d).select(F.col("k").alias("row"), "d")
        return Matrix(self.df.join(at, "row").select("row", "col", (F.col("d") * F.col("v")).alias("v")), self.nrow, self.ncol)

    def scale_cols(self, d: Matrix) -> Matrix:
        """This times diag(d)."""
        at = _axis(d).select(F.col("k").alias("col"), "d")
        return Matrix(self.df.join(at, "col").select("row", "col", (F.col("d") * F.col("v")).alias("v")), self.nrow, self.ncol)

    def inner(self, other: Matrix) -> DataFrame:
        """One row: the inner product of two vectors."""
        self._vector()
        other._vector()
        at = F.greatest("row", "col").alias("k")
        a, b = self.df.select(at, F.col("v").alias("x")), other.df.select(at, F.col("v").alias("y"))
        return a.join(b, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("v"))

    def inverse_blocked(self, block: int = blocks.BLOCK, definite: bool = False) -> Matrix:
        """The inverse of a square matrix of any order, by recursion over blocks.

        Halves are inverted without pivots between blocks, which is sound for positive definite matrices. Others are
        inverted as (A'A)^-1 A', whose first factor is one, and mended by a step of Newton's method, as A'A has the
        square of A's condition number. definite: the caller vouches for A.
        """
        n = self.nrow
        if n != self.ncol:
            raise ValueError(f"not square: {n} x {self.ncol}")
        last = (n - 1) // block
        own = blocks.kept(blocks.whole(blocks.blocked(self.df, n, n, block), n, block))
        if definite:
            x = blocks.inverse(own, 0, last)
        else:
            turned = blocks.transposed(own)
            x = blocks.kept(blocks.product(blocks.inverse(blocks.kept(blocks.product(turned, own)), 0, last), turned))
            off = blocks.kept(blocks.product(blocks.product(x, own), x))
            x = blocks.combined(blocks.scaled(x, 2.0).unionByName(blocks.scaled(off, -1.0)))  # x (2 - a x)
        return Matrix(blocks.cells(x, block), n, n)

    def inverse(self, pivot: bool = True) -> Matrix:
        """The inverse of a square matrix: up to order MAX_INVERSE in one task, beyond by blocks. pivot=False: a zero on the diagonal raises, as elimination without pivoting does."""
        if self.nrow != self.ncol:
            raise ValueError(f"not square: {self.nrow} x {self.ncol}")
        n = self.nrow
        if n > MAX_INVERSE:
            return self.inverse_blocked()

        def invert(pdf):
            import numpy as np
            import pandas as pd

            a = np.zeros((n, n))
            a[pdf["row"], pdf["col"]] = pdf["v"]
            x = eliminated(a, pivot)
            r, c = np.indices((n, n))
            return pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "v": x.ravel()})

        return Matrix(self.df.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(invert, "row int, col int, v double"), n, n)

    def shape(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(self.nrow, self.ncol)], "nrow int, ncol int")

    def rows(self) -> DataFrame:
        """(row, v array<double>) of the dense matrix."""
        return self.dense().df.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("v"))


def eliminated(a, pivot: bool = True):
    """Gauss-Jordan inverse of a numpy matrix."""
    import numpy as np

    n = len(a)
    w = np.hstack([np.asarray(a, float), np.eye(n)])
    for k in range(n):
        if pivot:
            top = k + int(np.abs(w[k:, k]).argmax())
            w[[k, top]] = w[[top, k]]
        if w[k, k] == 0:
            raise ZeroDivisionError(f"zero pivot in row {k}")
        w[k] /= w[k, k]
        rest = w[:, k].copy()
        rest[k] = 0
        w -= np.outer(rest, w[k])
    return w[:, n:]


def _axis(d: Matrix) -> DataFrame:
    """(k, d) of a vector, or of a matrix' diagonal."""
    if 1 in (d.nrow, d.ncol):
        return d.df.select(F.greatest("row", "col").alias("k"), F.col("v").alias("d"))
    return d.df.where("row = col").select(F.col("row").alias("k"), F.col("v").alias("d"))


def grid(spark: SparkSession, nrow: int, ncol: int) -> DataFrame:
    """All cells, numbered in one distributed range."""
    at = F.col("id")
    return spark.range(nrow * ncol).select(F.floor(at / max(1, ncol)).cast("int").alias("row"), (at % max(1, ncol)).cast("int").alias("col"))


def constant(spark: SparkSession, nrow: int, ncol: int, c: float) -> Matrix:
    return Matrix(grid(spark, nrow, ncol).withColumn("v", F.lit(float(c))), nrow, ncol)


def constant_diagonal(spark: SparkSession, nrow: int, ncol: int, c: float) -> Matrix:
    at = spark.range(min(nrow, ncol)).select(F.col("id").cast("int").alias("row"))
    return Matrix(at.select("row", F.col("row").alias("col"), F.lit(float(c)).alias("v")), nrow, ncol)


def random_uniform(spark: SparkSession, nrow: int, ncol: int, high: float = 5.0, seed: int = 1) -> Matrix:
    return Matrix(grid(spark, nrow, ncol).withColumn("v", F.rand(seed) * high), nrow, ncol)


def random_normal(spark: SparkSession, nrow: int, ncol: int, seed: int = 1) -> Matrix:
    return Matrix(grid(spark, nrow, ncol).withColumn("v", F.randn(seed)), nrow, ncol)


def random_normal_diagonal(spark: SparkSession, n: int, seed: int = 1) -> Matrix:
    return Matrix(constant_diagonal(spark, n, n, 1.0).df.withColumn("v", F.randn(seed)), n, n)


def draws(spark: SparkSession, kind: str = "Uniform", n: int = 10_000, seed: int = 1, bound: float | None = None) -> DataFrame:
    """n uniform or Gaussian numbers; bound: scale of the former, clip of the latter."""
    v = F.rand(seed) * (bound or 1.0) if kind == "Uniform" else F.randn(seed)
    if kind != "Uniform" and bound:
        v = F.greatest(F.least(v, F.lit(bound)), F.lit(-bound))
    return spark.range(n).select("id", v.alias("v"))


def add_all(parts: list[Matrix]) -> Matrix:
    """The sum of matrices of one shape: a union and one grouped sum."""
    for p in parts[1:]:
        parts[0]._same(p)
    rows = reduce(DataFrame.unionByName, [p.df.select("row", "col", "v") for p in parts])
    return Matrix(rows.groupBy("row", "col").agg(F.sum("v").alias("v")), parts[0].nrow, parts[0].ncol)


def pool_expansions(parts: list[DataFrame]) -> DataFrame:
    """Expansions (k, row, col, v) summed for each k."""
    return reduce(DataFrame.unionByName, parts).groupBy("k", "row", "col").agg(F.sum("v").alias("v"))


def multiply_expansions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over k of the products of a column expansion and a row expansion: the matrix product."""
    both = a.select("k", "row", "col", F.col("v").alias("x")).join(b.select("k", "row", "col", F.col("v").alias("y")), ["k", "row", "col"])
    return both.groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def from_rows(rows: DataFrame, row: str, values: str) -> DataFrame:
    """(row, array) -> cells."""
    return rows.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "v"))
