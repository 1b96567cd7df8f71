"""Encrypted operators as what they compute: values with a level, packed into slots, shared between sites.

This models the numbers and the constraints (slots, levels, shapes) of encrypted pipelines. It protects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.operators.matrix import Matrix, add_all, grid, multiply_expansions

#: Largest sum of modulus bits by degree at 128-bit security: fixed values.
MAX_BITS = {1024: 27, 2048: 54, 4096: 109, 8192: 218, 16384: 438, 32768: 881}


@dataclass(frozen=True)
class Params:
    degree: int = 16384
    mod_bits: tuple[int, ...] = field(default=(60, 40, 40, 40, 40, 40, 40, 60))
    scale_bits: int = 40
    noise_bits: int = 30

    @property
    def slots(self) -> int:
        return self.degree // 2

    @property
    def levels(self) -> int:
        return len(self.mod_bits) - 2

    def faults(self) -> list[str]:
        out = []
        if len(self.mod_bits) < 3:
            out.append("fewer than 3 moduli")
        if any(b != self.scale_bits for b in self.mod_bits[1:-1]):
            out.append("an inner modulus differs from the scale")
        if sum(self.mod_bits) >= MAX_BITS.get(self.degree, 0):
            out.append("too many bits for the degree")
        return out

    def valid(self) -> str:
        return "INVALID" if self.faults() else "VALID"

    @classmethod
    def read(cls, text: str) -> Params:
        """Four lines: degree, moduli, scale, noise."""
        rows = [x.split() for x in text.splitlines() if x.strip()]
        return cls(int(rows[0][0]), tuple(map(int, rows[1])), int(rows[2][0]), int(rows[3][0]))


@dataclass(frozen=True)
class Cipher:
    """A matrix, the level left, and its parameters."""

    m: Matrix
    params: Params = Params()
    level: int = -1

    def __post_init__(self) -> None:
        if self.params.faults():
            raise ValueError("; ".join(self.params.faults()))
        if self.level == -1:
            object.__setattr__(self, "level", self.params.levels)

    def _down(self, m: Matrix, by: int, other: Cipher | None = None) -> Cipher:
        level = min(self.level, other.level if other else self.level) - by
        if level < 0:
            raise ValueError("no levels left: refresh first")
        return Cipher(m, self.params, level)

    def add(self, other: Cipher) -> Cipher:
        return self._down(self.m.add(other.m), 0, other)

    def sub(self, other: Cipher) -> Cipher:
        return self._down(self.m.sub(other.m), 0, other)

    def mul(self, other: Cipher) -> Cipher:
        return self._down(self.m.mul(other.m), 1, other)

    def row_dot(self, other: Cipher) -> Cipher:
        n, rows = self.m.ncol, self.m.nrow
        if n & (n - 1) or n > self.params.slots or rows > self.params.slots:
            raise ValueError("columns must be a power of two, and columns and rows at most the slots")
        return self._down(self.m.row_dot(other.m), 2, other)

    def matmul(self, other_t: Cipher) -> Cipher:
        """This times the transpose of the other: inner products of rows."""
        return self._down(self.m.matmul(other_t.m.transpose()), 2, other_t)

    def expand_rows(self, n: int) -> DataFrame:
        c = self.m.ncol
        if c & (c - 1) or c > self.params.slots:
            raise ValueError("columns must be a power of two, at most the slots")
        return self.m.expand_rows(n)

    def transpose_vector(self) -> Cipher:
        return Cipher(self.m.transpose_vector(), self.params, self.level)

    def decrypt(self) -> Matrix:
        return self.m

    def refresh(self) -> Cipher:
        """Masked, decrypted, encrypted anew, unmasked: the same numbers at the full level."""
        mask = mask_of(self.m, 1.0, 1)
        masked = self.m.add(mask)
        return Cipher(masked.sub(mask), self.params)

    def vital_stats(self) -> DataFrame:
        """(ct, n_values, level, scale_bits, degree) of each ciphertext."""
        used = packed(self.m, self.params).select("ct", F.size("values").alias("n_values"))
        return used.select("ct", "n_values", F.lit(self.level).alias("level"), F.lit(self.params.scale_bits).alias("scale_bits"), F.lit(self.params.degree).alias("degree"))


def encrypted(m: Matrix, params: Params | None = None) -> Cipher:
    return Cipher(m, params or Params())


def add_list(parts: list[Cipher]) -> Cipher:
    return Cipher(add_all([p.m for p in parts]), parts[0].params, min(p.level for p in parts))


def by_expansions(a: DataFrame, b: DataFrame, nrow: int, ncol: int, params: Params, level: int) -> Cipher:
    if level < 1:
        raise ValueError("no levels left: refresh first")
    return Cipher(Matrix(multiply_expansions(a, b), nrow, ncol), params, level - 1)


def packed(m: Matrix, params: Params) -> DataFrame:
    """(ct, values): cells in row-major order, as many to a ciphertext as there are slots."""
    at = F.col("row").cast("long") * m.ncol + F.col("col")
    cells = m.dense().df.select(F.floor(at / params.slots).cast("int").alias("ct"), (at % params.slots).cast("int").alias("slot"), "v")
    return cells.groupBy("ct").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("values"))


def unpacked(p: DataFrame, nrow: int, ncol: int, params: Params) -> Matrix:
    own = p.select("ct", F.posexplode("values").alias("slot", "v")).withColumn("at", F.col("ct").cast("long") * params.slots + F.col("slot"))
    return Matrix(own.select(F.floor(F.col("at") / ncol).cast("int").alias("row"), (F.col("at") % ncol).cast("int").alias("col"), "v"), nrow, ncol)


def shares(m: Matrix, sites: int) -> DataFrame:
    """(site, row, col, share): of site i the part (i + 1) / (n (n + 1) / 2)."""
    weight = (F.col("site") + 1) / F.lit(sites * (sites + 1) / 2)
    return m.df.withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1)))).select("site", "row", "col", (F.col("v") * weight).alias("share"))


def random_shares(m: Matrix, sites: int, noise: float, seed: int = 1) -> DataFrame:
    """(site, row, col, share): all but site 0 hold noise, site 0 the rest; shares sum up to the value."""
    noises = F.array(*[F.lit(0.0), *[(F.rand(seed + s) - 0.5) * (2 * noise) for s in range(1, sites)]])
    own = m.df.withColumn("n", noises).withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1))))
    total = F.aggregate("n", F.lit(0.0), lambda s, v: s + v)
    return own.select("site", "row", "col", F.when(F.col("site") == 0, F.col("v") - total).otherwise(F.col("n")[F.col("site")]).alias("share"))


def pool_shares(parts: DataFrame, nrow: int, ncol: int, sites: int | None = None) -> Matrix:
    """Sum of shares. With `sites`, a cell that lacks a site's share raises."""
    out = parts.groupBy("row", "col").agg(F.sum("share").alias("v"), F.countDistinct("site").alias("n"))
    if sites is not None:
        out = out.withColumn("v", F.when(F.col("n") == sites, F.col("v")).otherwise(F.raise_error(F.lit("a site's share is missing")).cast("double")))
    return Matrix(out.select("row", "col", "v"), nrow, ncol)


def mask_of(m: Matrix, high: float, seed: int = 1) -> Matrix:
    """Uniform mask of the same shape; the hash of the cell, so that it can be made again."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "row", "col"), F.lit(1 << 30)) / F.lit(float(1 << 30))) * F.lit(float(high))
    return Matrix(grid(m.df.sparkSession, m.nrow, m.ncol).withColumn("v", u), m.nrow, m.ncol)


def collaborative_exp(m: Matrix, sites: int, seed: int = 1) -> Matrix:
    """exp under an additive mask of the sites: exp(A + sum n) times each exp(-n)."""
    masks = [mask_of(m, 1.0, seed + s) for s in range(sites)]
    out = add_all([m.dense(), *masks]).apply_column(F.exp)
    for n in masks:
        out = out.mul(n._map(F.exp(-F.col("v"))))
    return out


def collaborative_divide(coords: Matrix, weights: Matrix, seed: int = 1) -> Matrix:
    """Rows of coords over their weight (n x 1), which only shows masked."""
    mask = Matrix(mask_of(weights, 1.0, seed).df.withColumn("v", F.col("v") + 0.5), weights.nrow, 1)
    inverse = weights.mul(mask)._map(1 / F.col("v"))
    return coords.scale_rows(mask).scale_rows(inverse)


def collaborative_inverse(m: Matrix, seed: int = 1) -> Matrix:
    """A^-1 as N (A N)^-1 with a random N."""
    n = Matrix(grid(m.df.sparkSession, m.nrow, m.nrow).withColumn("v", F.pmod(F.xxhash64(F.lit(seed), "row", "col"), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5), m.nrow, m.nrow)
    return n.matmul(m.matmul(n).inverse())


def sealed(df: DataFrame, column: str, key: str) -> DataFrame:
    """AES-encrypted bytes of a column in place of it; key of 16, 24 or 32 characters."""
    return df.withColumn(column, F.aes_encrypt(F.col(column).cast("string").cast("binary"), F.lit(key.encode())))


def unsealed(df: DataFrame, column: str, key: str, kind: str = "double") -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key.encode())).cast("string").cast(kind))
