"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its `k` nearest of P reference points (pivots), in order. The index is a set of inverted
lists: each pivot has the vectors that count it among their k nearest. Vectors sharing at least `shared` pivots are
candidates; each candidate pair is then verified by its cosine in double precision.

Two vectors with `shared` common pivots have, in any fixed order of pivots, a common one among the first k - shared + 1
of each (prefix filter), so only those are posted; a pair that meets in several lists counts in the list of its least
common pivots only. With very many vectors the lists are keyed by r common pivots instead of one, so that they stay
short. A list of any length is dealt into blocks (pair_blocks), so no task holds an unbounded list, and within a task
counts and cosines are matrix products; pairs are never emitted: only sums per vector and connecting edges are. Lists
hold numbers of vectors; the vectors themselves move once, to the blocks that compare them.

Pivots are fitted on a bounded sample of 4 P vectors, P = PIVOTS (pivots_of). All vectors are indexed. The
index is approximate near the threshold; its recall against brute force is measured in the tests (over 0.99 there).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import Sets, components, dealt_pairs, materialize

PIVOTS = 1024
#: Cosine that any two pivots of the sample stay under.
APART = 0.7
BLOCK = 512
#: From so many vectors on, lists are keyed by two common pivots. No pair of `shared` common pivots is lost by that.
MANY = 1 << 20


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, zero or has null or non-finite components."""
    if vector is None or len(vector) == 0:
        return None
    try:
        x = np.asarray(vector, dtype=np.float64)
    except TypeError:
        return None
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:  # a NaN component makes the maximum NaN
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def pivots_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Reference points by dimension, PIVOTS of each whatever the table's size: of a sample (the vectors with the least hashes, four times as many at most) those that are not close to one chosen before, filled up with random directions.

    Apart, so that a group of near copies, however large, does not bring pivots of its own, whose order would differ from
    member to member.
    """
    p = PIVOTS
    out = {}
    for (dim,) in vectors.select("dim").distinct().collect():
        rows = vectors.where(F.col("dim") == dim).select("vec", "h1").orderBy("h1").limit(4 * p).collect()
        x = np.stack([unit(r["vec"]) for r in rows])
        chosen, free = [], np.ones(len(x), bool)
        for k in range(len(x)):
            if free[k] and len(chosen) < p:
                chosen.append(k)
                free &= x @ x[k] < APART
        more = np.random.default_rng(dim).standard_normal((p - len(chosen), dim))
        out[dim] = np.concatenate([x[chosen], more / np.sqrt((more * more).sum(axis=1, keepdims=True))])
    return out


def _describe(pivots, k: int, prefix: int, r: int):
    """vec_id, vec, mass -> (vec_id, mass, vec, near, keys): its nearest pivots, ascending, and the lists that it is in."""

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for dim, part in frame.groupby("dim"):
                ref = pivots.value[dim]
                near = min(k, len(ref))
                x = np.stack([unit(v) for v in part["vec"]])
                closeness = x @ ref.T
                # ordered by closeness, ties by number; the permutation's prefix, then ascending for set work
                top = np.argsort(-closeness, axis=1, kind="stable")[:, :near]
                top = np.sort(top, axis=1)
                for vec_id, mass, vec, own in zip(part["vec_id"], part["mass"], part["vec"], top.tolist(), strict=True):
                    keys = [f"{dim}:" + ",".join(map(str, key)) for key in combinations(own[: max(r, near - prefix + r)], min(r, near))]
                    out.append((vec_id, mass, vec, own, keys))
            yield pd.DataFrame(out, columns=["vec_id", "mass", "vec", "near", "keys"])

    return describe


def _verify(threshold: float, shared: int, r: int):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for task, items in zip(frame["task"], frame["items"], strict=True):
                key = np.array([int(x) for x in task["key"].split(":")[1].split(",")])
                low = [i["item"] for i in items if i["shard"] == task["lo"]]
                high = low if task["hi"] == task["lo"] else [i["item"] for i in items if i["shard"] == task["hi"]]
                if not low or not high:
                    continue
                sides = []
                for side in (low, high) if high is not low else (low,):
                    sides.append((np.array([i["vec_id"] for i in side]), np.array([i["mass"] for i in side]), np.stack([unit(i["vec"]) for i in side]), np.stack([np.asarray(i["near"]) for i in side])))
                a, b = sides[0], sides[-1]
                names, hot = np.unique(np.concatenate([s[3].ravel() for s in sides]), return_inverse=True)
                one = np.zeros((sum(len(s[0]) for s in sides), len(names)), np.float32)
                one[np.repeat(np.arange(len(one)), a[3].shape[1]), hot.ravel()] = 1
                left, right = one[: len(a[0])], one[-len(b[0]) :]
                enough = left @ right.T >= min(shared, a[3].shape[1])
                if high is low:
                    enough = np.triu(enough, 1)
                i, j = np.nonzero(enough)
                if not len(i):
                    continue
                # the pair belongs to the list of its r least common pivots: nothing shared lies below or between
                below = names < key[-1]
                if below.any():
                    own = len(key) - 1  # of the key itself, these lie below its last
                    mine = (left[:, below] @ right[:, below].T)[i, j] == own
                    i, j = i[mine], j[mine]
                linked = np.zeros(len(i), bool)
                for s in range(0, len(i), 65536):
                    t = slice(s, s + 65536)
                    linked[t] = np.einsum("nd,nd->n", a[2][i[t]], b[2][j[t]]) >= threshold
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                mass_a, mass_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
                np.add.at(mass_a, i, b[1][j])
                np.add.at(mass_b, j, a[1][i])
                sets = Sets()
                to: dict = {}
                if high is low:
                    mass_a, mass_b = mass_a + mass_b, None
                # one edge a vector at most: those that join two sets
                for x, y in zip(a[0][i].tolist(), b[0][j].tolist(), strict=True):
                    if sets.join(x, y):
                        to.setdefault(x, []).append(y)
                for ids, mass in ((a[0], mass_a), (b[0], mass_b)):
                    if mass is not None:
                        out += [(v, int(m), to.pop(v, [])) for v, m in zip(ids.tolist(), mass.tolist(), strict=True) if m or v in to]
            yield pd.DataFrame(out, columns=["vec_id", "links", "to"])

    return verify


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, k: int = 12, shared: int = 2) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of rows.

    Equal vectors are one point of the index with their number as mass, so copies are never paired. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null id, link with nothing (n_links 0, own
    component). Rows sharing an id share its component. Vectors of different lengths do not link. Other columns are
    not looked at. An empty table gives no rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("v")
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (size > 0) & ~F.exists(v, lambda x: F.abs(x.cast("double")) == float("inf"))
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    base = base.select("vec_id", "v", F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False)).alias("ok"))
    # 128 bits name a vector
    base = base.select("vec_id", "v", F.when(F.col("ok"), F.xxhash64(F.lit(1), v)).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(2), v)).alias("h2"))
    vectors = materialize(
        base.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mass"), F.first("v").alias("vec")).withColumn("dim", F.size("vec")),
        "vectors",
    )
    count = vectors.count()
    r = min(shared, 1 if count < MANY else 2)  # bears on the length of lists only: what is linked does not change with it
    pivots = spark.sparkContext.broadcast(pivots_of(vectors))
    kind = rows.schema[embedding].dataType.simpleString()
    described = vectors.select("vec_id", "mass", "vec", "dim").mapInPandas(_describe(pivots, k, shared, r), f"vec_id long, mass long, vec {kind}, near array<int>, keys array<string>")
    described = materialize(described, "described")
    posted = materialize(described.select(F.explode("keys").alias("key"), F.col("vec_id").alias("item")), "postings")
    blocks = dealt_pairs(posted, "key", "item", BLOCK).join(described.drop("keys").repartition(n), F.col("item") == F.col("vec_id"))
    blocks = blocks.groupBy("task").agg(F.collect_list(F.struct("shard", F.struct("vec_id", "mass", "vec", "near").alias("item"))).alias("items"))
    found = materialize(blocks.mapInPandas(_verify(threshold, shared, r), "vec_id long, links long, to array<long>"), "links")
    roots = components(found.select(F.col("vec_id").alias("a"), F.explode("to").alias("b")))
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    points = vectors.select("vec_id", "h1", "h2", "mass").join(sums, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    points = materialize(points.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mass") - 1).alias("links"), F.coalesce("root", "vec_id").alias("root")), "points")
    return (
        base.select("vec_id", "h1", "h2")
        .join(points, ["h1", "h2"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
