"""Source divergence audit by sorted streams.

Each task counts the terms of blocks of its documents and sends a row (lang, term, source, block, documents, count) for
each run, so that a frequent term costs a row a block. These are dealt by (lang, term, source) and sorted by block; a
scan of the runs adds them up. A second exchange, by (lang, term) and sorted by source, gives the runs that hold a
term's document frequency; runs of rare terms go. A term's rows are its sources at most.

Pairs of sources are compared tile by tile: a tile is SIDE x SIDE sources of a language and a share of its terms. Its
rows come sorted by term; each run gives a row of shares for both sides, and what the tile adds to all its pairs is sent
on once. Sources without a term have a share that depends on their size only, so their rows are never made.

Counts, shares and sums are integers throughout; shares are divided as decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm._common import materialize

#: A term's bytes: letters a-z and all that is not ASCII. What is left becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
PRIOR = 5
RANKS = 50
COUNT = 40  # bits of a count in a block
HELD = 1_000_000  # runs that a task adds up before it sends them
SIDE = 256  # sources of a side of a tile
SHARE = 1 << 14  # rows of a tile at least, before its terms are dealt into shares


def terms(text: str) -> list[bytes]:
    """All terms of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


RUNS = "lang string, term string, source string, block long, docs long, n long"


def block_runs(docs: DataFrame) -> DataFrame:
    """RUNS of docs (lang, source, text), one for each block of documents; each group of a block has one with an empty term too, docs 0 and n 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's documents and count in one number
        size = block = 0

        def out() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(5)]
            for (lang, source), own in held.items():
                n = len(own) + 1
                packed = np.fromiter(own.values(), np.int64, n - 1)
                for c, v in zip(cols, ([lang] * n, [*own, b""], [source] * n, [*(packed >> COUNT).tolist(), 0], [*(packed & (1 << COUNT) - 1).tolist(), 0]), strict=True):
                    c.extend(v)
            a, t, s, d, n = cols
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(t, pa.binary()).cast(pa.string()), pa.array(s), pa.array([block] * len(a), pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["lang", "term", "source", "block", "docs", "n"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = held.setdefault((lang, source), {})
                before, seen = len(own), own.get
                for w, n in Counter(terms(text)).items():
                    own[w] = seen(w, 0) + n + (1 << COUNT)
                size += len(own) - before
                if size > HELD:
                    yield out()
                    held, size, block = {}, 0, block + 1
        if held:
            yield out()

    return docs.mapInArrow(count, RUNS)


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where runs of equal values in all of the columns begin, the first row's place included."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in names:
        col = batch.column(c)
        new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, cut between runs: no run of equal `names` lies in two of them."""
    rest: list[pa.RecordBatch] = []  # of one run
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _starts(batch, names)
        if rest and any(rest[-1].column(c)[-1] != batch.column(c)[0] for c in names):
            yield _joined(rest)
            rest = []
        if rest and len(at) > 1:
            yield _joined([*rest, batch.slice(0, at[1])])
            rest, batch, at = [], batch.slice(at[1]), at[1:] - at[1]
        if len(at) > 1:
            yield batch.slice(0, at[-1])
        rest.append(batch.slice(at[-1]))
    if rest:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of (lang, term, source): its documents and counts, in parts if a run is cut by a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _starts(batch, ["lang", "term", "source"])
        own = [batch.column(c).take(pa.array(at)) for c in ("lang", "term", "source")]
        docs, n = (np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("docs", "n"))
        if last is not None:
            if all(last[k] == own[k][0].as_py() for k in range(3)):
                docs[0] += last[3]
                n[0] += last[4]
            else:
                yield pa.RecordBatch.from_pydict({"lang": [last[0]], "term": [last[1]], "source": [last[2]], "docs": [last[3]], "n": [last[4]]})
        last = (*(c[-1].as_py() for c in own), int(docs[-1]), int(n[-1]))
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([*(c[:-1] for c in own), pa.array(docs[:-1]), pa.array(n[:-1])], names=["lang", "term", "source", "docs", "n"])
    if last is not None:
        yield pa.RecordBatch.from_pydict({"lang": [last[0]], "term": [last[1]], "source": [last[2]], "docs": [last[3]], "n": [last[4]]})


def frequent_runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, term, source, n, of_lang) of the terms in at least so many documents, and the groups, which have an empty term."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, ["lang", "term"]):
            at = _starts(batch, ["lang", "term"])
            docs, n = batch.column("docs").to_numpy(), batch.column("n").to_numpy()
            sizes = np.diff(np.append(at, batch.num_rows))
            kept = np.repeat(np.add.reduceat(docs, at) >= least, sizes) | pc.equal(batch.column("term"), "").to_numpy(zero_copy_only=False)
            of_lang = np.repeat(np.add.reduceat(n, at), sizes)
            rows = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("lang", "term", "source")), pa.array(n[kept]), pa.array(of_lang[kept])], names=["lang", "term", "source", "n", "of_lang"])

    return frequent


def _share(n: Column, total: Column, terms_of_lang: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR V)); of a language without terms 0."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = (whole(n) + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
    below = whole(total) + whole(terms_of_lang) * F.lit(PRIOR).cast("decimal(1,0)")
    return F.when(terms_of_lang > 0, F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1).otherwise(F.lit(0).cast("long"))


TILES = "lang string, i int, a long, j int, b long, f long"


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TILES of sorted rows (lang, i, j, share, term, side, source, p): what a tile's terms add to the distances of source a of side i and b of side j.

    Rows of the empty term come first and give each source's share of a term that it lacks. What a pair has of a term
    that both lack is not added, in no tile; so each term adds the difference to that.
    """
    key = None
    base: list[np.ndarray] = []
    names: list[np.ndarray] = []
    total = None
    group = ["lang", "i", "j", "share"]

    def close() -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(total)
        if len(a):
            lang, i, j, _ = key
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(np.full(len(a), i, np.int32)), pa.array(names[0][a]), pa.array(np.full(len(a), j, np.int32)), pa.array(names[-1][b]), pa.array(total[a, b])], names=["lang", "i", "a", "j", "b", "f"])

    for batch in whole_runs(batches, [*group, "term"]):
        at = np.append(_starts(batch, [*group, "term"]), batch.num_rows)
        heads = batch.take(pa.array(at[:-1]))
        keys = list(zip(*(heads.column(c).to_pylist() for c in group), strict=True))
        marks = pc.equal(heads.column("term"), "").to_pylist()
        side, source, p = (batch.column(c).to_numpy() for c in ("side", "source", "p"))
        for k, own in enumerate(keys):
            part = slice(at[k], at[k + 1])
            if marks[k]:
                if key is not None:
                    yield from close()
                key, sides = own, (0,) if own[1] == own[2] else (0, 1)
                names = [source[part][side[part] == s] for s in sides]
                base = [p[part][side[part] == s] for s in sides]
                order = [np.argsort(x) for x in names]
                names, base = [x[o] for x, o in zip(names, order, strict=True)], [x[o] for x, o in zip(base, order, strict=True)]
                zero = np.abs(base[0][:, None] - base[-1][None, :])
                total = np.zeros(zero.shape, np.int64)
                continue
            rows = [x.copy() for x in base]
            for s in range(len(rows)):
                mine = side[part] == s
                rows[s][np.searchsorted(names[s], source[part][mine])] = p[part][mine]
            total += np.abs(rows[0][:, None] - rows[-1][None, :]) - zero
    if key is not None:
        yield from close()


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = RANKS, side: int = SIDE, share: int = SHARE) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart, and what they say more often.

    Every row of docs is a document; null lang, source and text count as empty. Part `pair` has each other source of the
    language and the distance of its shares over all terms in `least` documents of the language; part `term` the terms
    that the source has more often than its language, to rank `ranks`. Ties go by item, in bytes. A source alone in its
    language has no pairs; an empty table gives an empty one. Other columns of docs are not looked at.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    def dealt(df: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
        """By key, each partition sorted by it: a hash goes first, as numbers are compared faster than words. It is not sent."""
        return df.repartition(n, *key).sortWithinPartitions(F.xxhash64(*key), *key, *rest)

    sums = dealt(block_runs(own), ["lang", "term", "source"], ["block"]).mapInArrow(summed_runs, "lang string, term string, source string, docs long, n long")
    by_term = dealt(sums, ["lang", "term"], ["source"])
    kept = materialize(by_term.mapInArrow(frequent_runs(least), "lang string, term string, source string, n long, of_lang long"), "terms")
    held = kept.where("term <> ''")

    langs = held.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term") != "", 1).otherwise(0)).alias("cells"))
    cells = totals.groupBy("lang").agg(F.sum("cells").alias("cells"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1  # a number a source: their pairs are the result
    groups = totals.drop("cells").join(langs, "lang", "left").join(cells, "lang").na.fill(0, ["v", "lang_total"]).withColumn("place", place)
    groups = materialize(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")

    facts = held.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("of_lang"), F.col("lang_total"), F.col("v"))
    facts = materialize(facts.select("lang", "source", "place", "cells", "term", p.alias("p"), q.alias("q")), "shares")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = facts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)

    # each source's rows go to the tiles of its block: as side 0 of those of blocks after it, as side 1 of those before
    blocks = F.ceil(F.count(F.lit(1)) / side).cast("int")
    rows_of_tile = F.first("cells") * F.least(F.lit(2), blocks) / blocks
    pairs_of_tile = F.pow(F.least(F.count(F.lit(1)), F.lit(side)), 2)
    sides = groups.groupBy("lang").agg(blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(rows_of_tile / F.greatest(F.lit(share), 2 * pairs_of_tile))).cast("int").alias("shares"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.floor(F.col("place") / side).cast("int")

    def tiled(rows: DataFrame, of_share: Column, p: Column) -> DataFrame:
        out = rows.join(sides, "lang").withColumn("share", of_share).withColumn("own", block).withColumn("other", numbers("blocks"))
        i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
        return out.select("lang", i, j, "share", "term", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), F.col("place").alias("source"), p.alias("p"))

    bases = tiled(groups.withColumn("term", F.lit("")), numbers("shares"), F.col("base"))
    rows = tiled(facts, F.pmod(F.xxhash64("term"), F.col("shares")).cast("int"), F.col("p"))
    tiles = bases.unionByName(rows).repartition(n, "lang", "i", "j", "share").sortWithinPartitions("lang", "i", "j", "share", "term")
    sums = _both_ways(tiles.mapInArrow(tile_sums, TILES)).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    a, b = (groups.select("lang", F.col("source").alias(f"s_{x}"), F.col("place").alias(x), F.col("base").alias(f"base_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    a = a.join(sides.select("lang", "blocks"), "lang").withColumn("block", numbers("blocks"))
    b = b.drop("v_b").withColumn("block", F.floor(F.col("b") / side).cast("int"))
    pairs = a.join(b, ["lang", "block"]).where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.col("v_a") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("f", F.lit(0))
    pairs = pairs.select("lang", F.col("s_a").alias("source"), F.lit("pair").alias("part"), F.col("s_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(first))
    return pairs.unionByName(over).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _both_ways(sums: DataFrame) -> DataFrame:
    """(lang, a, b, f) with each pair both ways; tiles of a block with itself have both already."""
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = F.when(F.col("i") == F.col("j"), F.slice(turned, 1, 1)).otherwise(turned)
    return sums.select("lang", "f", F.explode(ways).alias("way")).select("lang", "way.a", "way.b", "f")
