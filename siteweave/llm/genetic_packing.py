"""Best-fit packing by a grouping genetic algorithm (Falkenauer 1996).

pieces() tokenizes documents and cuts the long ones. pack() fills sequences: full pieces are sequences of their own; the
others are dealt by hash into instances of bounded size. Each instance is evolved on several islands at once (one task
row each): a population of packings, whose genes are whole bins. Crossover injects well-filled bins of one parent into
the other, takes out the bins that hold an item twice, and puts the displaced items back by best fit, longest first.
After each epoch islands pass their elite on to the next island of their instance. At the end of a round the
well-filled bins stand; what lies in the others is dealt anew and packed together in the next round, so that the loss
of the instances' last bins does not add up.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import materialize

ISLANDS = 3
INSTANCE = 1500
EPOCHS = 3
POPULATION = 5
CHILDREN = 12
ROUNDS = 3


class Ids:
    """Ids of byte-level BPE as little-endian 32-bit bytes: whole texts at once by the vocabulary's pattern and ranks. Texts that name a special token go through the tokenizers library."""

    def __init__(self, name: str) -> None:
        import base64
        import json

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = P.path(f"{name}.json")
        with open(self.path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.whole = None
        self.Tokenizer = Tokenizer

    def of(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            self.whole = self.whole or self.Tokenizer.from_file(self.path)
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


_ids: dict[str, Ids] = {}


def ids_of(name: str) -> Ids:
    """The encoder of a vocabulary, one for all tasks of a worker."""
    if name not in _ids:
        _ids.clear()
        _ids[name] = Ids(name)
    return _ids[name]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = "byte_bpe_50k", end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, rid) per piece: whole texts (null: empty), then id `end`; over `capacity` ids are cut, the first piece taking what is left over. rid numbers the rows."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rid"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rid = ids_of(tokenizer), TaskContext.get().partitionId() << 40
        last = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {x: [] for x in names}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = ids.of(t) + last
                n = len(b) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % capacity + 1 if k == 0 else capacity)
                    for x, value in zip(names, (d, k, at, to - at, zlib.crc32(b[4 * at : 4 * to]), rid), strict=True):
                        out[x].append(value)
                    at, k, rid = to, k + 1, rid + 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).alias("d"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rid long")


class Bins:
    """Bins of a packing by free space; the fullest that still takes an item is found by bits."""

    def __init__(self, lens: list[int], capacity: int, bins: list[list[int]] = ()) -> None:
        self.lens, self.capacity = lens, capacity
        self.bins = [list(b) for b in bins]
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        for k, b in enumerate(self.bins):
            self._put(k, capacity - sum(lens[x] for x in b))

    def _put(self, k: int, free: int) -> None:
        if free:
            self.at.setdefault(free, []).append(k)
            self.mask |= 1 << free

    def add(self, items: list[int]) -> None:
        """Best fit, longest first."""
        lens = self.lens
        for x in sorted(items, key=lens.__getitem__, reverse=True):
            n = lens[x]
            if fits := self.mask >> n:
                free = n + (fits & -fits).bit_length() - 1
                here = self.at[free]
                k = here.pop()
                if not here:
                    self.mask ^= 1 << free
                self.bins[k].append(x)
                self._put(k, free - n)
            else:
                self.bins.append([x])
                self._put(len(self.bins) - 1, self.capacity - n)


def fitness(bins: list[list[int]], lens: list[int], capacity: int) -> float:
    """Mean squared fill: fewer and fuller bins are better."""
    return sum((sum(lens[x] for x in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: list[list[int]], other: list[list[int]], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child of two packings: some of the other's well-filled bins whole, the bins of the one that share nothing with them, and the rest by best fit."""
    fill = sorted(range(len(other)), key=lambda k: -sum(lens[x] for x in other[k]))
    full = fill[: max(1, len(fill) // 2)]
    injected = [other[k] for k in rng.sample(full, max(1, len(full) // rng.randint(2, 6)))]
    inside = {x for b in injected for x in b}
    kept, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [x for x in b if x not in inside]
    return _refill(injected + kept, displaced, lens, capacity, rng)


def _refill(bins: list[list[int]], displaced: list[int], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Also opens the emptiest bins (mutation), then best fit."""
    order = sorted(range(len(bins)), key=lambda k: sum(lens[x] for x in bins[k]))
    opened = set(order[: rng.randint(1, max(1, len(bins) // 20))])
    displaced = displaced + [x for k in opened for x in bins[k]]
    packed = Bins(lens, capacity, [b for k, b in enumerate(bins) if k not in opened])
    packed.add(displaced)
    return packed.bins


def perfect(bins: list[list[int]], lens: list[int], capacity: int) -> bool:
    """All bins but one are full: no packing has fewer or fuller ones."""
    return sum(sum(lens[x] for x in b) < capacity for b in bins) <= 1


def evolve(lens: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), children: int = CHILDREN) -> list[list[int]]:
    """The best packing that one island finds from best fit decreasing, random starts and the elites given: fewest bins, then fitness."""
    rng = random.Random(seed)
    first = Bins(lens, capacity)
    first.add(list(range(len(lens))))
    rated = lambda b: (len(b), -fitness(b, lens, capacity), b)
    by = lambda x: x[:2]
    herd = [rated(b) for b in [*elites, first.bins]]
    if not any(perfect(b, lens, capacity) for _, _, b in herd):
        while len(herd) < POPULATION:
            order = sorted(range(len(lens)), key=lambda x: lens[x] * rng.uniform(0.7, 1.3), reverse=True)
            start = Bins(lens, capacity)
            for x in order:
                start.add([x])
            herd.append(rated(start.bins))
        herd = sorted(herd, key=by)[:POPULATION]
        for _ in range(children):
            one, other = rng.sample(herd, 2)
            child = rated(crossover(one[2], other[2], lens, capacity, rng))
            if all(by(child) != by(x) for x in herd):  # copies would take the herd over
                herd = sorted([*herd, child], key=by)[:POPULATION]
            if perfect(herd[0][2], lens, capacity):
                break
    return min(herd, key=by)[2]


def _island(capacity: int, seed: int):
    """Rows (instance, island, lens, elites) -> (instance, island, lens, best); a packing is the bin's number of each item."""

    def bins_of(numbers) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for x, k in enumerate(numbers):
            out.setdefault(int(k), []).append(x)
        return list(out.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for instance, island, lens, elites in zip(frame["instance"], frame["island"], frame["lens"], frame["elites"], strict=True):
                sizes = [int(x) for x in lens]
                best = evolve(sizes, capacity, seed + 7919 * instance + island, [bins_of(e) for e in elites])
                numbers = [0] * len(sizes)
                for k, b in enumerate(best):
                    for x in b:
                        numbers[x] = k
                out.append((instance, island, lens, numbers, len(best)))
            yield pd.DataFrame(out, columns=["instance", "island", "lens", "best", "bins"])

    return run


def _packed(items: DataFrame, capacity: int, seed: int, instances: int) -> DataFrame:
    """items (it struct with length, rid) -> (it, instance, bin, fill, at): one round of epochs on islands."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select(F.pmod(F.xxhash64(F.lit(seed), F.col("it.rid")), F.lit(instances)).alias("instance"), "it")
    held = materialize(dealt.groupBy("instance").agg(F.sort_array(F.collect_list("it")).alias("its")), "instances")
    lens = F.transform("its", lambda x: x["length"].cast("int")).alias("lens")
    state = held.select("instance", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), lens, F.expr("cast(array() as array<array<int>>)").alias("elites"))
    for epoch in range(EPOCHS):
        state = state.repartition(n, "instance", "island")
        state = materialize(state.mapInPandas(_island(capacity, seed + 104729 * epoch), "instance long, island int, lens array<int>, best array<int>, bins int"), "islands")
        if epoch + 1 < EPOCHS:  # each island keeps its elite and gets that of the island before it
            to = F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)
            state = (
                state.select("instance", F.explode(to).alias("island"), "lens", "best")
                .groupBy("instance", "island")
                .agg(F.first("lens").alias("lens"), F.collect_list("best").alias("elites"))
            )
    best = state.groupBy("instance").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))
    placed = held.join(best, "instance").select("instance", F.explode(F.arrays_zip("its", "best")).alias("x")).select("instance", F.col("x.its").alias("it"), F.col("x.best").alias("bin"))
    bins = placed.groupBy(F.struct("instance", "bin").alias("at")).agg(F.collect_list("it").alias("its"))
    start = F.aggregate(F.slice("its", 1, F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    fill = F.aggregate("its", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return bins.select("at", "its", fill.alias("fill")).select("at", "its", "fill", F.posexplode("its").alias("k", "it")).select("it", F.col("at.instance").alias("instance"), F.col("at.bin").alias("bin"), "fill", start.alias("offset"))


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces(): every piece lies in one sequence of at most `capacity` ids, gapless from 0."""
    cut = materialize(cut, "pieces")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = cut.where(F.col("length") == capacity).select(*cols, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # the struct begins with what orders an instance's items
    items = cut.where(F.col("length") < capacity).select(F.struct("rid", *cols).alias("it"))
    for step in range(ROUNDS):
        count = items.count()
        if not count:
            break
        instances = -(-count // INSTANCE)
        packed = _packed(items, capacity, step + 1, instances)
        last = step + 1 == ROUNDS or instances == 1
        packed = materialize(packed, "packed")
        stays = F.lit(True) if last else F.col("fill") >= int(0.995 * capacity)
        number = F.lit(step << 58).cast("long") + F.col("instance") * (1 << 20) + F.col("bin")
        out = out.unionAll(packed.where(stays).select(*[f"it.{c}" for c in cols], number.alias("sequence_id"), "offset"))
        if last:
            break
        items = packed.where(~stays).select("it")
    return out


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of docs.

    Null and empty texts are one piece that holds the end id. Null ids stay null; repeated rows and ids are packed each
    for itself. Other columns are not looked at. An empty table gives no rows.
    """
    return pack(pieces(docs, doc_id, text, capacity, tokenizer), capacity)
