"""Orders cut into parts: what an ordered operator needs so that no group, chromosome or sample is one task.

Rows are dealt by group and part of an order. What the parts before (or after) a part bring along, as a running extremum,
a sum or a last value, comes from a small table of one row a part; moving windows get copies of the rows near a part's
borders (halos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task orders.
ROWS = 1 << 20
#: Parts of a group at most.
PARTS = 1024
#: Rows of one key in a row of listed(), at most.
LISTED = 1024
#: Of a list that apart() unrolls at a time.
UNROLLED = 256


def tiled(df: DataFrame, part: Column, keys: list[str]) -> DataFrame:
    """With `__tile`, dealt by it once: the aggregates of tiles and the windows over them read the same exchange."""
    return df.withColumn("__tile", part).repartition(*keys, "__tile")


def carried(own: DataFrame, keys: list[str], before: dict[str, tuple[Column, Column]], after: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """tiled() rows with columns of what the tiles before, and after, bring along: name -> (aggregate of a tile, aggregate of tiles' `__x`)."""
    w = Window.partitionBy(*keys).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("__tile")).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(name, *x, w) for name, x in before.items()] + [(name, *x, back) for name, x in (after or {}).items()]
    each = own.groupBy(*keys, "__tile").agg(*[of.alias(name) for name, of, _, _ in sums])
    each = each.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__tile").alias("__k_tile"), *[over(F.col(name)).over(at).alias(name) for name, _, over, at in sums])
    on = F.col("__tile").eqNullSafe(F.col("__k_tile"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return own.join(each, on).drop("__k_tile", *[f"__k_{k}" for k in keys])


def numbered(df: DataFrame, parts: Column, order: list[Column], name: str = "k", by: list[str] | None = None) -> DataFrame:
    """df with `name`, the place of each row from 1 in an order, within groups `by`.

    parts must not fall as the order goes up. A window runs over each part, and a part's first place is the number of
    rows of those before it: no group is one task.
    """
    by = by or []
    own = carried(tiled(df, parts, by), by, {"__before": (F.count(F.lit(1)), F.sum)})
    place = F.coalesce("__before", F.lit(0)) + F.row_number().over(Window.partitionBy(*by, "__tile").orderBy(*order))
    return own.withColumn(name, place).drop("__tile", "__before")


def parts_of(df: DataFrame, v: Column, parts: int = 64) -> tuple[DataFrame, Column]:
    """df with the quantiles of v, and the number of those below a row's v: parts of nearly equal size in its order. A single value, however frequent, lies in one part; nulls come first."""
    cuts = df.agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], 100 * parts).alias("__cuts"))
    own = df.crossJoin(F.broadcast(cuts))  # one row
    return own, F.coalesce(F.size(F.filter("__cuts", lambda c: c < v)), F.lit(-1))


def parts_by_group(df: DataFrame, by: list[str], v: Column, tie: str | None = None, rows: int = ROWS) -> tuple[DataFrame, Column, list[str]]:
    """df with quantiles of the number v in each group of more than `rows` rows; the part of a row in its group's order; the columns to drop.

    Parts hold some `rows` rows each. Where one value takes several quantiles, its rows are cut again at quantiles of
    `tie`, if that is a number. Nulls are in the first part. The size of the largest group reaches the driver; groups that
    are small all are one part each, without another pass.
    """
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= rows:
        return df, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), []
    n = min(PARTS, -(-most // rows))
    at = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    own = df.withColumn("__v", v.cast("double"))
    large = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", at, 100 * n).alias("__cuts")).where(f"__n > {rows}").drop("__n")

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return left.join(right, on, "left").drop(*[f"__k_{k}" for k in keys])

    out = joined(own, large, by)
    first = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.lit(0))
    second, more = F.lit(0), []
    if tie is not None and dict(df.dtypes)[tie].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        often = large.select(*by, F.explode("__cuts").alias("__v")).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__m")).where("__m > 1").drop("__m")
        ties = own.join(F.broadcast(often), [*by, "__v"], "left_semi")  # at most n / 2 values a large group
        ties = ties.groupBy(*by, "__v").agg(F.percentile_approx(F.col(tie).cast("double"), at, 100 * n).alias("__ties"))
        out, more = joined(out, ties, [*by, "__v"]), ["__ties"]
        second = F.coalesce(F.size(F.filter("__ties", lambda c: c < F.col(tie).cast("double"))), F.lit(0))
    return out, F.struct(first.alias("a"), second.alias("b")), ["__v", "__cuts", *more]


def with_halos(df: DataFrame, by: list[str], place: str, half: int, rows: int = ROWS) -> DataFrame:
    """Rows dealt by tiles of `rows` places, with copies of those up to `half` places beyond each border; `__own` tells a tile's rows from them."""
    k = F.col(place) - 1
    low, high = F.floor(F.greatest(k - half, F.lit(0)) / rows), F.floor((k + half) / rows)
    out = df.withColumn("__tile", F.explode(F.sequence(low, high)))
    return out.withColumn("__own", F.col("__tile") == F.floor(k / rows)).repartition(*by, "__tile")


def listed(df: DataFrame, keys: list[str], most: int = LISTED) -> DataFrame:
    """(*keys, items): the rows of one key in a row, items their other columns, in rows of at most `most` of them."""
    rest = [c for c in df.columns if c not in keys]
    item = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    at = Window.partitionBy(*keys).orderBy(*(rest or keys[-1:]))
    own = df.withColumn("__piece", F.floor((F.row_number().over(at) - 1) / most))
    return own.groupBy(*keys, "__piece").agg(F.collect_list(item).alias("items")).drop("__piece")


def apart(met: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """met with a row for each pair of items: the columns `a` and `b`, lists, are unrolled.

    An item of `a` stands in one run of rows, beside the same items of `b` in the same order as the one before it, so that
    files of pairs are runs and repeats to their encodings. Long lists of `b` are unrolled in pieces of a multiple of
    eight items, which repeat in bytes too when they are written in fewer bits, and a rest of up to seven.
    """
    for c in b:
        whole = F.size(c) - F.size(c) % 8
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)), F.lit(UNROLLED)), lambda k: F.slice(c, k + 1, F.least(whole - k, F.lit(UNROLLED))))
        pieces = F.filter(F.concat(pieces, F.array(F.slice(c, whole + 1, 8))), lambda x: F.size(x) > 0)
        met = met.withColumn(c, F.explode(F.when(F.size(c) < 128, F.array(c)).otherwise(pieces)))
    for c in (*a, *b):
        met = met.withColumn(c, F.explode(c))
    return met
