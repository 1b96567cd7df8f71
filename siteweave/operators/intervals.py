"""Interval operators on (chrom, start, end), inclusive at both ends.

Overlap joins are equi-joins on a hierarchy of bins, each level's four times as long as those of the one below. A region
lies at the level of its length, in the three bins at most where a shorter one that meets it may begin; the other side
asks each level from its own up for the one bin where it begins. So a pair meets once, at the level of the longer
region, and a region has at most a row a level that occurs and three, whatever the lengths. Runs, gaps and running
extrema are windows by chromosome and tile of TILE positions, with what the tiles before bring along from a small table
of one row a tile: no chromosome is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from siteweave.operators.tiles import LISTED, apart, carried, listed, parts_of, tiled

#: Bins of the lowest level have 2^LOWEST positions; those of the next 2^STEP times as many.
LOWEST = 7
STEP = 2
#: The level of the longest region there may be, when lengths are not known: 2^33 positions.
HIGHEST = 33
#: Positions of a tile.
TILE = 1 << 20
#: Of a tile where all regions of a tile are sorted.
FINE = 1 << 13
#: Distance for regions whose chromosome the other set lacks: a fixed value.
FAR = 10_000_000


def level_of(length: Column) -> Column:
    """The exponent of the bins of the least level that are not shorter than a region."""
    bits = F.length(F.bin(length - 1))
    return (LOWEST + STEP * F.ceil(F.greatest(bits - LOWEST, F.lit(0)) / STEP)).cast("int")


def levels_of(*sides: DataFrame) -> list[list[int]]:
    """The levels that occur on each side: at most some dozen numbers a side reach the driver, in one job."""
    length = F.col("end").cast("long") - F.col("start").cast("long") + 1
    each = [df.where("end >= start").select(F.lit(k).alias("k"), level_of(length).alias("e")) for k, df in enumerate(sides)]
    whole = each[0]
    for other in each[1:]:
        whole = whole.unionAll(other)
    found = [(r["k"], r["e"]) for r in whole.distinct().collect()]
    return [sorted(e for k, e in found if k == n) for n in range(len(sides))]


def _met(a: DataFrame, b: DataFrame, of_a: list[int], of_b: list[int], longest: int | None = None, tasks: int | None = None) -> DataFrame:
    """(a struct, b struct) of each overlapping pair, for sides whose levels are among those given. longest: all regions are dealt by one level of that length, and a longer one raises. tasks: those of the join, else Spark's choice."""
    at = lambda c: F.col(c).cast("long")
    length = at("end") - at("start") + 1
    one = None if longest is None else max(LOWEST, (longest - 1).bit_length())

    def rows(df: DataFrame, name: str, asks: int, of_others: list[int]) -> DataFrame:
        """asks: the meeting (0, 1) at which this side asks; at the other one it lies. In meeting 1 only longer regions are asked for."""
        if one is None:
            own = level_of(length)
        else:
            own = F.when(length <= longest, F.lit(one)).otherwise(F.raise_error(F.lit(f"a region is longer than {longest}")).cast("int"))
        names = [c for c in df.columns if c != "chrom"]
        held = [F.col(c).alias(f"__{name}_{c}") for c in names]
        df = df.where("end >= start").select(*held, F.col("chrom").alias("__c"), at("start").alias("__s"), at("end").alias("__t"), own.alias("__e"))
        asked = F.array(*[F.struct(F.lit(asks).alias("m"), F.lit(e).alias("e"), F.shiftright("__s", e).alias("bin")) for e in of_others])
        asked = F.filter(asked, lambda x: x["e"] > F.col("__e") if asks else x["e"] >= F.col("__e"))
        reach = F.lit(longest) if one is not None else F.expr(f"shiftleft(1L, __e{'' if asks else f' - {STEP}'})")
        first = F.call_function("shiftright", F.col("__s") - reach + 1, F.col("__e"))
        lies = F.transform(F.sequence(first, F.call_function("shiftright", "__t", "__e")), lambda x: F.struct(F.lit(1 - asks).alias("m"), F.col("__e").alias("e"), x.alias("bin")))
        lies = F.when(F.col("__e") > min(of_others) if not asks else F.col("__e") >= min(of_others), lies).otherwise(F.array().cast("array<struct<m:int,e:int,bin:bigint>>"))
        # bin, level and meeting are one number: rows that are dealt hold the chromosome once, and no structs
        key = F.transform(F.concat(asked, lies), lambda k: F.shiftleft(k["bin"], 7) + 2 * k["e"] + k["m"])
        return df.select(*[f"__{name}_{c}" for c in names], "__c", F.explode(key).alias("__k"))

    if one is not None:
        of_a, of_b = [one], [one]
    if not of_a or not of_b:  # an empty side
        none = lambda df, n: df.where("false").select(F.struct(*df.columns).alias(n))
        return none(a, "a").crossJoin(none(b, "b"))
    x, y = rows(a, "a", 0, of_b), rows(b, "b", 1, of_a)
    if tasks is not None:
        x, y = (df.repartition(tasks, "__c", "__k") for df in (x, y))
    whole = lambda df, n: F.struct(*[(F.col("__c") if c == "chrom" else F.col(f"__{n}_{c}")).alias(c) for c in df.columns]).alias(n)
    return x.join(y, ["__c", "__k"]).where("__a_start <= __b_end AND __b_start <= __a_end").select(whole(a, "a"), whole(b, "b"))


def overlaps(a: DataFrame, b: DataFrame, longest: int | None = None, strand: bool = False, tasks: int | None = None) -> DataFrame:
    """(a struct, b struct, ol_start, ol_end, l_overlap) for each overlapping pair; strand: on one strand only.

    longest: the length that no region exceeds, where the caller knows it: it spares the pass that finds the levels.
    tasks: those of the join. Where all pairs are written, a task of few regions writes them by short numbers.
    """
    for side in (a, b):
        if not {"chrom", "start", "end"} <= set(side.columns):
            raise ValueError("regions need chrom, start and end")
    out = _met(a, b, *([[], []] if longest else levels_of(a, b)), longest, tasks)
    if strand:
        out = out.where("a.strand = b.strand")
    return out.select("a", "b", F.greatest("a.start", "b.start").alias("ol_start"), F.least("a.end", "b.end").alias("ol_end")).withColumn("l_overlap", F.col("ol_end") - F.col("ol_start") + 1)


def placed(df: DataFrame, most: int = LISTED) -> DataFrame:
    """(chrom, start, end, items): the regions of one place in a row, items their other columns, in rows of at most `most` of them."""
    return listed(df.where("end >= start"), ["chrom", "start", "end"], most)


def overlaps_by_place(a: DataFrame, b: DataFrame, longest: int | None = None, tasks: int | None = None) -> DataFrame:
    """overlaps() of placed() sides, for results that hold all pairs: places are met, and `a.items` and `b.items` are the regions on them."""
    return overlaps(placed(a), placed(b), longest, tasks=tasks)


def overlaps_first(a: DataFrame, b: DataFrame, key: str, longest: int | None = None, tile: int = FINE) -> DataFrame:
    """Of each region of a (named by `key`) the overlap with the first region of b by start and end. No pair is made.

    A region of b is never first if one before it in this order ends as late. Of those left the ends rise with the starts,
    so the first to end where a region of a begins, or later, is its first overlap, if it begins early enough. Both are
    running extrema by tile, with a guest a tile for what other tiles bring along. longest: a longer region raises.
    """
    if longest is not None:
        length = F.col("end").cast("long") - F.col("start").cast("long") + 1
        a, b = (df.where("end >= start").where(F.when(length <= longest, F.lit(True)).otherwise(F.raise_error(F.lit(f"a region is longer than {longest}")).cast("boolean"))) for df in (a, b))
    region, kind = F.struct(*b.columns), b.select(F.struct(*b.columns).alias("x")).schema["x"].dataType
    none, part = F.lit(None).cast(kind), lambda c: F.floor(F.col(c) / tile)
    over = Window.partitionBy("chrom").orderBy("__tile")
    sound = b.where("chrom IS NOT NULL AND end >= start")

    # regions of b, after a guest of each tile: the latest end of the tiles before
    far = sound.groupBy("chrom", part("start").alias("__tile")).agg(F.max("end").alias("__far"))
    far = far.select("chrom", "__tile", F.max("__far").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__far")).where("__far IS NOT NULL")
    cells = sound.select("chrom", part("start").alias("__tile"), F.lit(1).alias("__own"), F.col("start").alias("__s"), F.col("end").alias("__far"), region.alias("b"))
    cells = cells.unionByName(far.select("chrom", "__tile", F.lit(0).alias("__own"), F.lit(None).cast(b.schema["start"].dataType).alias("__s"), "__far", none.alias("b")))
    w = Window.partitionBy("chrom", "__tile").orderBy("__own", "__s", "__far", "b").rowsBetween(Window.unboundedPreceding, -1)
    kept = cells.withColumn("__before", F.max("__far").over(w)).where("__own = 1 AND (__before IS NULL OR __far > __before)").select("chrom", F.col("__far").alias("__at"), "b")

    # by end, with the regions of a by start; a guest of each tile: the first of the tiles after
    kept = kept.withColumn("__tile", part("__at"))
    heads = kept.groupBy("chrom", "__tile").agg(F.min("__at").alias("__at"), F.min_by("b", "__at").alias("b"))
    asked = a.where("chrom IS NOT NULL AND end >= start")
    tiles = asked.select("chrom", part("start").alias("__tile")).distinct().withColumns({"__at": F.lit(None).cast("long"), "b": none})
    marks = tiles.unionByName(heads.withColumn("__at", F.col("__at").cast("long"))).groupBy("chrom", "__tile").agg(F.min("__at").alias("__at"), F.first("b", ignorenulls=True).alias("b"))
    after = Window.partitionBy("chrom").orderBy(F.desc("__tile")).rowsBetween(Window.unboundedPreceding, -1)
    guests = marks.withColumn("b", F.last("b", ignorenulls=True).over(after)).where("b IS NOT NULL").select("chrom", "__tile", F.lit(0).alias("__side"), F.lit(None).cast("long").alias("__at"), "b")
    rows = kept.select("chrom", "__tile", F.lit(1).alias("__side"), F.col("__at").cast("long").alias("__at"), "b").unionByName(guests)
    own = F.struct(*a.columns)
    rows = rows.withColumn("a", F.lit(None).cast(a.select(own.alias("x")).schema["x"].dataType))
    rows = rows.unionByName(asked.select("chrom", part("start").alias("__tile"), F.lit(2).alias("__side"), F.col("start").cast("long").alias("__at"), none.alias("b"), own.alias("a")))
    back = Window.partitionBy("chrom", "__tile").orderBy(F.desc_nulls_first("__at"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("b", F.last("b", ignorenulls=True).over(back)).where("__side = 2 AND b.start <= a.end")
    out = found.select("a", "b", F.greatest("a.start", "b.start").alias("ol_start"), F.least("a.end", "b.end").alias("ol_end")).withColumn("l_overlap", F.col("ol_end") - F.col("ol_start") + 1)
    # a row a key, as keys may name several regions
    order = F.struct(F.col("b.start"), F.col("b.end"), F.col("b"))
    return out.groupBy(F.col(f"a.{key}").alias(key)).agg(F.min_by(F.struct("a", "b", "ol_start", "ol_end", "l_overlap"), order).alias("r")).select("r.*")


def without_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of a that overlap none of b: those at a distance from the closest. No pair is made."""
    return _with_distance(a, b).where(F.coalesce(F.col("__distance"), F.lit(1)) > 0).drop("__distance")


def _tiled(a: DataFrame, tile: int, keys: list[str]) -> DataFrame:
    return tiled(a, F.floor(F.col("start") / tile), keys)


def merge(a: DataFrame, gap: int = 0, by: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(chrom, ..., start, end, n): regions no further apart than gap fused. by: further columns that separate, as strand."""
    keys = ["chrom", *by]
    # regions of one start are of one run: they are added up before they are dealt
    own = a.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("__n"))
    own = carried(_tiled(own, tile, keys), keys, {"__far": (F.max("end"), F.max)})
    w = Window.partitionBy(*keys, "__tile").orderBy("start", "end")
    far = F.greatest("__far", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("start") <= far + gap, F.lit(None)).otherwise(F.col("start"))
    own = own.withColumn("__opens", opens).drop("__far")
    own = carried(own, keys, {"__open": (F.max("__opens"), F.max)})
    # the run of a region begins at the last region up to it, or equal to it, that opened one
    run = F.coalesce(F.max("__opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "__open")
    return own.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("__n").alias("n")).drop("__run")


def union_merge(parts: list[DataFrame], gap: int = 0) -> DataFrame:
    from functools import reduce

    return merge(reduce(DataFrame.unionByName, [p.select("chrom", "start", "end") for p in parts]), gap)


def subtract(a: DataFrame, b: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """(key, chrom, start, end): what is left of each region of a outside b.

    These are its overlaps with the gaps between the runs of b, and what it has before the first and after the last run
    of its chromosome: a row a piece, however many cuts a region has. The gaps are written to the shared folder, as they
    are read for their levels and for the join. longest: of a's regions and of b's gaps.
    """
    from siteweave.sources.exchange import scratch

    between = gaps(merge(b)).where("gap > 1").select("chrom", (F.col("start") - F.col("gap") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    between.write.parquet(path := scratch(b.sparkSession, "gaps"))
    between = b.sparkSession.read.schema(between.schema).parquet(path)
    own = a.select(key, "chrom", "start", "end")
    inner = overlaps(own, between, longest).select(F.col(f"a.{key}").alias(key), F.col("a.chrom").alias("chrom"), F.col("ol_start").alias("start"), F.col("ol_end").alias("end"))
    reach = b.where("end >= start").groupBy("chrom").agg(F.min("start").alias("__first"), F.max("end").alias("__last"))
    piece = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    before = piece(F.col("start"), F.least(F.col("end"), F.col("__first") - 1))
    after = piece(F.greatest(F.col("start"), F.col("__last") + 1), F.col("end"))
    sides = F.when(F.col("__first").isNull(), F.array(piece(F.col("start"), F.col("end")))).otherwise(F.array(before, after))
    outer = own.join(reach, "chrom", "left").select(key, "chrom", F.explode(sides).alias("p")).where("p.s <= p.e")
    return inner.select(key, "chrom", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).unionAll(outer.select(key, "chrom", "p.s", "p.e"))


def pairwise_remainders(a: DataFrame, b: DataFrame, key: str, longest: int | None = None, tasks: int | None = None) -> DataFrame:
    """(key, chrom, start, end, b): for each overlapping pair what is left of the region of a outside that one region of b, up to two pieces."""
    met = overlaps_by_place(a.select(key, "chrom", "start", "end"), b, longest, tasks)
    sides = F.array(F.struct(F.col("a.start").alias("s"), (F.col("ol_start") - 1).alias("e")), F.struct((F.col("ol_end") + 1).alias("s"), F.col("a.end").alias("e")))
    own = met.select("a", "b", F.explode(sides).alias("p")).where("p.s <= p.e")
    own = apart(own.select("b", "p", F.col("a.chrom").alias("chrom"), F.col(f"a.items.{key}").alias("__a"), F.col("b.items").alias("__b")), ["__a"], ["__b"])
    region = F.struct(*[F.col(f"b.{c}" if c in ("chrom", "start", "end") else f"__b.{c}").alias(c) for c in b.columns])
    return own.select(F.col("__a").alias(key), "chrom", F.col("p.s").alias("start"), F.col("p.e").alias("end"), region.alias("b"))


def covered(a: DataFrame) -> DataFrame:
    """One row: number of positions that a covers."""
    return merge(a).agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("coverage"))


def overlap_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coverages of a, b and both (each merged), and their shares: of a, of both sets, and the harmonic mean of the shares of a and b."""
    x, y = merge(a), merge(b)
    both = overlaps(x, y).agg(F.coalesce(F.sum("l_overlap"), F.lit(0)).alias("ol"))
    ca, cb = covered(a).withColumnRenamed("coverage", "cov_a"), covered(b).withColumnRenamed("coverage", "cov_b")
    out = ca.crossJoin(cb).crossJoin(both)  # three single rows
    return out.select("cov_a", "cov_b", "ol", F.try_divide(F.col("ol").cast("double"), F.col("cov_a")).alias("of_a"), F.try_divide(F.col("ol").cast("double"), F.col("cov_a") + F.col("cov_b") - F.col("ol")).alias("of_both"), F.try_divide(2.0 * F.col("ol"), F.col("cov_a") + F.col("cov_b")).alias("f1"))


def best_overlap_histogram(a: DataFrame, b: DataFrame, key: str, step: float = 0.1) -> DataFrame:
    """(bin, n): regions of a by the share of their length that their best overlap covers; 0 without one."""
    best = overlaps(a, b).groupBy(F.col(f"a.{key}").alias(key)).agg(F.max("l_overlap").alias("best"))
    share = F.coalesce(F.col("best"), F.lit(0)) / (F.col("end") - F.col("start") + 1)
    return a.join(best, key, "left").groupBy(F.floor(share / step + 1e-9).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shuffled_overlap(a: DataFrame, b: DataFrame, span: int, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, coverage): positions of merged b that a covers when its regions are moved at random within 1..span of their chromosome.

    A place is drawn by a hash of region, replicate and seed, so that it is the same wherever it is made. Merged regions are
    written to the shared folder, as each is read several times.
    """
    from siteweave.sources.exchange import scratch

    def written(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(path := scratch(df.sparkSession, what))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    moved = written(merge(a, 1), "runs").select("chrom", F.col("start").alias("from"), (F.col("end") - F.col("start")).alias("l"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "r", "chrom", "from"), F.lit(1 << 31)) / (1 << 31)
    moved = moved.withColumn("start", (drawn * (span - F.col("l"))).cast("int") + 1).withColumn("end", F.col("start") + F.col("l"))
    tagged = moved.select(F.concat_ws("|", "r", "chrom").alias("chrom"), "start", "end")
    target = written(merge(b, 1), "target").select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"), "chrom", "start", "end").select(F.concat_ws("|", "r", "chrom").alias("chrom"), "start", "end")
    found = overlaps(written(merge(tagged, 1), "moved"), target).groupBy(F.split("a.chrom", r"\|")[0].cast("int").alias("replicate")).agg(F.sum("l_overlap").alias("coverage"))
    numbers = a.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    return numbers.join(found, "replicate", "left").select("replicate", F.coalesce("coverage", F.lit(0)).alias("coverage"))


def _with_distance(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """a with `__distance` to the closest region of b, 0 for overlaps, null without one on the chromosome. A union ordered by position and two running extrema: no range join."""
    cols = lambda df, side, own: df.select("chrom", "start", "end", F.lit(side).alias("__side"), own.alias("__own"))
    own = F.struct(*a.columns)
    kind = a.select(own.alias("x")).schema["x"].dataType
    both = cols(a, 1, own).unionByName(cols(b.where("end >= start"), 0, F.lit(None).cast(kind)))
    end, start = (F.when(F.col("__side") == 0, F.col(c)) for c in ("end", "start"))
    both = carried(_tiled(both, tile, ["chrom"]), ["chrom"], {"__left": (F.max(end), F.max)}, {"__right": (F.min(start), F.min)})
    before = Window.partitionBy("chrom", "__tile").orderBy("start", "__side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chrom", "__tile").orderBy(F.desc("start"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    # greatest() and least() skip nulls, as they should for what tiles bring along
    marked = both.withColumn("__l", F.greatest("__left", F.max(end).over(before))).withColumn("__r", F.least("__right", F.min(start).over(after)))
    # but a side without regions must stay null
    left = F.when(F.col("__l").isNotNull(), F.greatest(F.col("start") - F.col("__l"), F.lit(0)))
    right = F.when(F.col("__r").isNotNull(), F.greatest(F.col("__r") - F.col("end"), F.lit(0)))
    return marked.where("__side = 1").select("__own.*", F.least(left, right).alias("__distance"))


def nearest_distance(a: DataFrame, b: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """(key, distance): to the closest region of b, 0 for overlaps, FAR without one on the chromosome."""
    own = _with_distance(a.select("chrom", "start", "end", F.col(key).alias("__key")), b, tile)
    return own.select(F.col("__key").alias(key), F.coalesce("__distance", F.lit(FAR)).alias("distance"))


def gaps(a: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, start, gap): distance of each region from the one before it on its chromosome, by start."""
    last = F.max(F.struct("start", "end"))
    own = carried(_tiled(a, tile, ["chrom"]), ["chrom"], {"__last": (last, F.max)})
    w = Window.partitionBy("chrom", "__tile").orderBy("start", "end")
    return own.withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(w), F.col("__last.end"))).where("gap IS NOT NULL").select("chrom", "start", "gap")


def cumulative_ends(a: DataFrame, tile: int = TILE) -> DataFrame:
    """With the greatest end so far and the least start from here on, by position: the latter is the region's own."""
    own = carried(_tiled(a, tile, ["chrom"]), ["chrom"], {"__far": (F.max("end"), F.max)})
    w = Window.partitionBy("chrom", "__tile").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("cumul_end", F.greatest("__far", F.max("end").over(w))).withColumn("cumul_start", F.col("start")).drop("__far", "__tile")


def in_super_region(a: DataFrame, supers: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """(key, a, super): the region of `supers` that holds each of a. A region only partly inside one raises."""
    inside = F.col("a.start").between(F.col("b.start"), F.col("b.end")) & F.col("a.end").between(F.col("b.start"), F.col("b.end"))
    found = overlaps(a, supers, longest)
    checked = F.when(inside, F.col("b")).otherwise(F.raise_error(F.concat(F.lit("partly outside: "), F.col(f"a.{key}").cast("string"))))
    return found.select(F.col(f"a.{key}").alias(key), "a", checked.alias("super"))


def unique_by_position(a: DataFrame, keep_one: bool = True) -> DataFrame:
    """One region for each position (the least), or only those that no other shares."""
    rest = [c for c in a.columns if c not in ("chrom", "start", "end")]
    grouped = a.groupBy("chrom", "start", "end").agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("__r"), F.count(F.lit(1)).alias("__n"))
    grouped = grouped if keep_one else grouped.where("__n = 1")
    return grouped.select("chrom", "start", "end", *[F.col(f"__r.{c}").alias(c) for c in rest])


def top_until_coverage(a: DataFrame, first: Column, ties: list[str], most: int, parts: int = 256) -> DataFrame:
    """Regions in the order of the number `first`, then `ties`, until their summed length reaches `most`, the crossing one included.

    Quantiles of `first` cut the order into parts, whose sums are added up over one row a part; only the parts up to the
    one that crosses are sorted, each by itself.
    """
    length = F.col("end").cast("long") - F.col("start") + 1
    own, part = parts_of(a.withColumn("__first", first), F.col("__first"), parts)
    own = own.withColumn("__part", part).drop("__cuts")
    sums = own.groupBy(F.col("__part").alias("__p")).agg(F.sum(length).alias("__sum"))
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = sums.select("__p", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before")).where((F.col("__before") < most) | (F.col("__before") == 0))
    w = Window.partitionBy("__part").orderBy("__first", *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum(length).over(w), F.lit(0))
    out = own.join(F.broadcast(sums), F.col("__part") == F.col("__p")).withColumn("__b", before)
    return out.where((F.col("__b") < most) | (F.col("__b") == 0)).select(*a.columns)


def associations(a: DataFrame, group: str) -> DataFrame:
    """(x, y, n): how often regions of two groups overlap."""
    pairs = overlaps(a, a).where(F.col(f"a.{group}") < F.col(f"b.{group}"))
    return pairs.groupBy(F.col(f"a.{group}").alias("x"), F.col(f"b.{group}").alias("y")).agg(F.count(F.lit(1)).alias("n"))


# ---- region-wise ----


def extend(a: DataFrame, five: int, three: int) -> DataFrame:
    """Longer at the 5' and 3' ends by strand; starts stay at 1 or more."""
    plus = F.coalesce(F.col("strand") != "-", F.lit(True)) if "strand" in a.columns else F.lit(True)
    left, right = F.when(plus, five).otherwise(three), F.when(plus, three).otherwise(five)
    return a.withColumns({"start": F.greatest(F.lit(1), F.col("start") - left), "end": F.col("end") + right})


def flanks(a: DataFrame, length: int) -> DataFrame:
    """Two rows a region, side 5 and 3: what lies before and after it by strand."""
    plus = F.coalesce(F.col("strand") != "-", F.lit(True)) if "strand" in a.columns else F.lit(True)
    sides = F.array(
        F.struct(F.greatest(F.lit(1), F.col("start") - length).alias("s"), (F.col("start") - 1).alias("e"), F.when(plus, 5).otherwise(3).alias("side")),
        F.struct((F.col("end") + 1).alias("s"), (F.col("end") + length).alias("e"), F.when(plus, 3).otherwise(5).alias("side")),
    )
    out = a.withColumn("__f", F.explode(sides))
    return out.withColumns({"start": F.col("__f.s"), "end": F.col("__f.e"), "side": F.col("__f.side")}).drop("__f").where("end >= start")


def ends_of(a: DataFrame, which: int = 5) -> DataFrame:
    """The single position at the 5' or 3' end."""
    plus = F.coalesce(F.col("strand") != "-", F.lit(True)) if "strand" in a.columns else F.lit(True)
    at = F.when(plus == F.lit(which == 5), F.col("start")).otherwise(F.col("end"))
    return a.withColumn("__p", at).withColumns({"start": F.col("__p"), "end": F.col("__p")}).drop("__p")


def midpoints(a: DataFrame) -> DataFrame:
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    return a.withColumn("__m", mid).withColumns({"start": F.col("__m"), "end": F.col("__m")}).drop("__m")


def filtered(a: DataFrame, chroms: list[str] | None = None, strand: str | None = None, end_max: int | None = None, min_run: int | None = None, max_run: int | None = None) -> DataFrame:
    """Predicates on regions; runs are end - start, compared strictly."""
    run = F.col("end") - F.col("start")
    tests = [
        F.col("chrom").isin(chroms) if chroms is not None else None,
        F.col("strand") == strand if strand is not None else None,
        F.col("end") < end_max if end_max is not None else None,
        run > min_run if min_run is not None else None,
        run < max_run if max_run is not None else None,
    ]
    for t in tests:
        if t is not None:
            a = a.where(t)
    return a


def by_name(a: DataFrame, b: DataFrame, ignore_case: bool = False, tasks: int | None = None) -> DataFrame:
    """(a, b) of one name. Rows of a name meet as lists, and pairs are made last; tasks: those of the join, else Spark's choice."""
    k = F.lower("name") if ignore_case else F.col("name")

    def lists(df: DataFrame, side: str) -> DataFrame:
        own = df.select(k.alias("__k"), *[F.col(c).alias(f"__{c}") for c in df.columns]).where("__k IS NOT NULL")
        own = listed(own if tasks is None else own.repartition(tasks, "__k"), ["__k"])
        return own.select("__k", F.col("items").cast(ArrayType(df.schema)).alias(side))

    return apart(lists(a, "a").join(lists(b, "b"), "__k").drop("__k"), ["a"], ["b"])


def greedy_apart(a: DataFrame, n: int, distance: int, score: str = "score", by: str = "chrom") -> DataFrame:
    """The n best and n worst regions by score that keep a distance from those chosen before, each within its group `by`.

    Each choice depends on those before it, so a group is one task; groups run beside each other.
    """
    schema = a.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def choose(pdf):
        import pandas as pd

        out = []
        for best in (True, False):
            taken: list[tuple[int, int]] = []
            for r in pdf.sort_values([score, "start", "end"], ascending=[not best, True, True]).itertuples(index=False):
                if len(taken) == n:
                    break
                if all(r.start > e + distance or r.end < s - distance for s, e in taken):
                    taken.append((r.start, r.end))
                    out.append({**r._asdict(), "which": "top" if best else "bottom"})
        return pd.DataFrame(out, columns=[*pdf.columns, "which"])

    return a.groupBy(by).applyInPandas(choose, f"{schema}, which string")
