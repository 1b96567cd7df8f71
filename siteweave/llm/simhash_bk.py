"""SimHash near-dedup by BK-trees.

fingerprints() hashes word shingles; linked() finds all pairs of distinct fingerprints within a radius with BK-trees:
a node's children are keyed by their integer Hamming distance to it, and a search follows only the edges that can hold
something within the radius.

One tree over everything would have to be broadcast whole, and a search in it would visit most of it (distances of
unrelated 64-bit fingerprints lie close to 32). So the trees are sharded by agreement: with radius r the bits are cut
into r + s blocks, and two fingerprints within r agree on s of them at least. Each choice of s blocks and their value is
a key; a shard's tree holds the fingerprints of one key, shipped by a shuffle to the task that searches it. This is
exact. s grows with the number of distinct fingerprints, so that shards stay small; a key of very many is dealt into
several trees of bounded size, searched pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siteweave.llm._common import Sets, components, materialize, pair_blocks

BITS = 64
SEED = 42
SHARD = 512


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned SimHash of a text: A-Z lowered, words between ASCII white space, shingles of `words` (fewer: all of them), XXH64 with seed 42; a bit is 1 if it is in over half of the shingles. No words: 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(w), SEED)
    whole, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    ends = ends[words - 1 :]
    h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        part = h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> F.Column:
    """The signed-long column of fingerprints of docs[text]."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([x - (1 << 64) if (x := fingerprint(t, words)) >> 63 else x for t in texts], dtype="int64")

    return of(docs[text])


class BKTree:
    """Items are unsigned integers; children[d] holds what lies at Hamming distance d of the node."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def within(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (y ^ x).bit_count()
            if d <= radius:
                yield y
            lo, hi = d - radius, d + radius
            if len(children) > hi - lo:
                todo += [c for k in range(lo, hi + 1) if (c := children.get(k))]
            else:
                todo += [c for k, c in children.items() if lo <= k <= hi]


def _search(radius: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, signed = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
        for frame in frames:
            a, b = [], []
            for task, items in zip(frame["task"], frame["items"], strict=True):
                low = [i["item"] & mask for i in items if i["shard"] == task["lo"]]
                high = [i["item"] & mask for i in items if i["shard"] == task["hi"]] if task["hi"] != task["lo"] else None
                tree, sets = BKTree(), Sets()
                if high is None:
                    for x in low:
                        for y in tree.within(x, radius):
                            if sets.join(x, y):
                                a.append(signed(x))
                                b.append(signed(y))
                        tree.add(x)
                    continue
                for x in low:
                    tree.add(x)
                for x in high:
                    for y in tree.within(x, radius):
                        if sets.join(x, y):
                            a.append(signed(x))
                            b.append(signed(y))
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return search


def linked(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """Edges (a, b) between fingerprints of distinct (fp long): enough of them to connect all that links connect."""
    agree = next(s for s in range(1, 64) if s * BITS / (radius + s) >= min(48, max(12, math.log2(max(2, count)) - 6)))  # keys of 12 bits at least, some 64 fingerprints to a key
    cuts = [BITS * k // (radius + agree) for k in range(radius + agree + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [sum(masks[k] for k in chosen) for chosen in combinations(range(len(masks)), agree)]
    signed = [x - (1 << 64) if x >> 63 else x for x in keys]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed]))).select(
        F.struct(F.col("pos").alias("choice"), F.col("col").alias("value")).alias("key"), "fp"
    )
    return pair_blocks(keyed, "key", "fp", SHARD).mapInPandas(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row (doc_id, fingerprint, component_id, kept) per row of docs.

    fingerprint: 16 hex digits. component_id: the least id that links of at most `radius` bits reach. kept: the row has
    that id. Null texts count as empty; empty texts have fingerprint 0 and link like others. A null id stays null, is
    never a component's id and is never kept, unless its component has no other id: then component_id is null and
    kept true. Repeated rows and ids are all returned. Other columns of docs are not looked at.
    """
    fps = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text, words).alias("fp")), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(linked(distinct.select("fp"), radius, distinct.count()))
    named = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = materialize(named.join(ids.repartition(n), "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
