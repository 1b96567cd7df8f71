"""Dense matrices as tables of blocks (i, j, h, w, v, m): h x w cells as bytes, and which of them are there.

Blocks have BLOCK rows and columns but at the lower and right edge. m is null for a block with all its cells, else a
byte a cell; absent cells are zero. Products are joins on the inner block number, whose partial sums are added up in each
task, as long as they fit, and then by (i, j). The inverse splits a matrix in four, down to single blocks: no task ever
holds more than some blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
SCHEMA = "i int, j int, h int, w int, v binary, m binary"
NAMES = ["i", "j", "h", "w", "v", "m"]
#: Blocks of partial sums that a task holds.
HELD = 32


def _row(i: int, j: int, v: np.ndarray, m: np.ndarray | None) -> tuple:
    return int(i), int(j), *v.shape, v.tobytes(), None if m is None or m.all() else m.astype(np.uint8).tobytes()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({c: "int32" for c in NAMES[:4]})


def _read(h: int, w: int, v: bytes, m: bytes | None) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(v).reshape(h, w), None if m is None else np.frombuffer(m, np.uint8).reshape(h, w).astype(bool)


def blocked(df: DataFrame, nrow: int, ncol: int, block: int = BLOCK) -> DataFrame:
    """Blocks of cells (row, col, v): a group is the cells of one block."""

    def build(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(x) for x in key)
        shape = min(block, nrow - i * block), min(block, ncol - j * block)
        v, m = np.zeros(shape), np.zeros(shape, bool)
        at = cells["row"].to_numpy() - i * block, cells["col"].to_numpy() - j * block
        np.add.at(v, at, cells["v"].to_numpy(float))
        m[at] = True
        return _frame([_row(i, j, v, m)])

    at = lambda c: F.floor(F.col(c) / block).cast("int")
    return df.select("row", "col", "v").groupBy(at("row").alias("i"), at("col").alias("j")).applyInPandas(build, SCHEMA)


def cells(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, col, v) of the cells that are there."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f.itertuples(index=False):
                v, m = _read(b.h, b.w, b.v, b.m)
                r, c = np.nonzero(np.ones(v.shape, bool) if m is None else m)
                yield pd.DataFrame({"row": (b.i * block + r).astype("int32"), "col": (b.j * block + c).astype("int32"), "v": v[r, c]})

    return blocks.mapInPandas(read, "row int, col int, v double")


def _added(a: tuple, b: tuple) -> tuple:
    """Sum of (v, m) and (v, m)."""
    return a[0] + b[0], None if a[1] is None or b[1] is None else a[1] | b[1]


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of the product."""
    left = a.select("i", F.col("j").alias("k"), *[F.col(c).alias(f"a_{c}") for c in NAMES[2:]])
    right = b.select(F.col("i").alias("k"), "j", *[F.col(c).alias(f"b_{c}") for c in NAMES[2:]])

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for f in frames:
            for x in f.itertuples(index=False):
                (v, m), (u, n) = _read(x.a_h, x.a_w, x.a_v, x.a_m), _read(x.b_h, x.b_w, x.b_v, x.b_m)
                there = None
                if m is not None or n is not None:
                    ones = lambda y, z: np.ones(y.shape, np.float32) if z is None else z.astype(np.float32)
                    there = ones(v, m) @ ones(u, n) > 0
                new = (v @ u, there)
                held[x.i, x.j] = _added(held[x.i, x.j], new) if (x.i, x.j) in held else new
                if len(held) > HELD:
                    yield _frame([_row(*k, *y) for k, y in held.items()])
                    held = {}
        if held:
            yield _frame([_row(*k, *y) for k, y in held.items()])

    parts = left.join(right, "k").select("i", "j", *[f"{s}_{c}" for s in "ab" for c in NAMES[2:]]).mapInPandas(multiply, SCHEMA)
    return combined(parts)


def combined(parts: DataFrame) -> DataFrame:
    """Blocks added up by (i, j)."""

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in f.itertuples(index=False):
            own = _read(x.h, x.w, x.v, x.m)
            total = own if total is None else _added(total, own)
        return _frame([_row(*key, *total)])

    return parts.groupBy("i", "j").applyInPandas(add, SCHEMA)


def scaled(a: DataFrame, c: float) -> DataFrame:
    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["v"] = [(np.frombuffer(v) * c).tobytes() for v in f["v"]]
            yield f

    return a.mapInPandas(scale, SCHEMA)


def transposed(a: DataFrame) -> DataFrame:
    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x in f.itertuples(index=False):
                v, m = _read(x.h, x.w, x.v, x.m)
                rows.append(_row(x.j, x.i, np.ascontiguousarray(v.T), None if m is None else m.T.copy()))
            yield _frame(rows)

    return a.mapInPandas(turn, SCHEMA)


def _inverted_block(a: DataFrame) -> DataFrame:
    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x in f.itertuples(index=False):
                try:
                    v = np.linalg.inv(_read(x.h, x.w, x.v, x.m)[0])
                except np.linalg.LinAlgError:
                    raise ZeroDivisionError(f"singular: the leading blocks up to block {x.i}") from None
                rows.append(_row(x.i, x.j, v, None))
            yield _frame(rows)

    return a.mapInPandas(invert, SCHEMA)


def kept(df: DataFrame) -> DataFrame:
    """Blocks written to the shared folder and read back: no lineage, no second computation."""
    from siteweave.sources.exchange import scratch

    df.write.parquet(path := scratch(df.sparkSession, "blocks"))
    return df.sparkSession.read.schema(SCHEMA).parquet(path)


def whole(a: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """All blocks of a square matrix of order n, those without cells as zeros."""
    k = -(-n // block)
    side = lambda c: F.least(F.lit(block), n - F.col(c) * block).cast("int")
    every = a.sparkSession.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    zeros = F.unhex(F.repeat(F.lit("0000000000000000"), side("i") * side("j")))
    out = every.join(a.withColumnsRenamed({c: f"a_{c}" for c in NAMES[2:]}), ["i", "j"], "left")
    return out.select("i", "j", side("i").alias("h"), side("j").alias("w"), F.coalesce("a_v", zeros).alias("v"), F.lit(None).cast("binary").alias("m"))


def inverse(a: DataFrame, first: int, last: int) -> DataFrame:
    """Inverse of blocks first..last, by Schur's complement of the upper left half. All leading squares of blocks must be regular, as those of a positive definite matrix are. Each product is written to the shared folder."""
    if first == last:
        return kept(_inverted_block(a))
    mid = (first + last) // 2
    low, high = (lambda c: F.col(c) <= mid), (lambda c: F.col(c) > mid)
    a11, a12, a21, a22 = (a.where(r("i") & c("j")) for r in (low, high) for c in (low, high))
    x = inverse(a11, first, mid)
    x12, x21 = kept(product(x, a12)), kept(product(a21, x))
    schur = kept(combined(a22.unionByName(scaled(product(a21, x12), -1.0))))
    y = inverse(schur, mid + 1, last)
    b12 = kept(scaled(product(x12, y), -1.0))
    b21 = scaled(product(y, x21), -1.0)
    b11 = combined(x.unionByName(scaled(product(b12, x21), -1.0)))
    return kept(b11.unionByName(b12).unionByName(b21).unionByName(y))
