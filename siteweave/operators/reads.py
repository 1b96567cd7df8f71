"""Mapped reads: coverage, fragments and pileups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions.scalar import cigar_blocks, cigar_parts
from siteweave.operators.tiles import carried, tiled


def coverage(reads: DataFrame, by_strand: bool = False, extend_to: int = 0, tile: int = 1 << 20) -> DataFrame:
    """(chrom, strand, start, end, depth): runs of equal depth over the M blocks of reads (chrom, pos, strand, cigar).

    extend_to: each read instead as a tag of that length from its 5' end. Starts and ends become +1 and -1 events, summed
    by position and then along the chromosome, so that no position is expanded. Each tile of `tile` positions begins with
    the depth that those before it leave, and its last run ends before the next tile's first event.
    """
    keys = ["chrom", "strand"] if by_strand else ["chrom"]
    if extend_to:
        last = F.col("pos") + F.aggregate(cigar_parts(F.col("cigar")), F.lit(0), lambda s, p: s + F.when(p["op"].isin("D", "M", "N", "=", "X"), p["n"]).otherwise(0)) - 1
        start = F.when(F.col("strand") == "-", F.greatest(F.lit(1), last - extend_to + 1)).otherwise(F.col("pos"))
        end = F.when(F.col("strand") == "-", last).otherwise(F.col("pos") + extend_to - 1)
        blocks = F.array(F.struct(start.alias("start"), end.alias("end")))
    else:
        blocks = cigar_blocks(F.col("pos"), F.col("cigar"))
    spans = reads.select(*keys, F.explode(blocks).alias("b")).select(*keys, F.explode(F.array(F.struct(F.col("b.start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b.end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = spans.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    own = carried(tiled(events, F.floor(F.col("at") / tile), keys), keys, {"__depth": (F.sum("d"), F.sum)}, {"__next": (F.min("at"), F.min)})
    w = Window.partitionBy(*keys, "__tile").orderBy("at")
    runs = own.withColumn("depth", F.coalesce("__depth", F.lit(0)) + F.sum("d").over(w)).withColumn("end", F.coalesce(F.lead("at").over(w), "__next") - 1)
    return runs.where("depth > 0").select(*keys, F.col("at").alias("start"), "end", "depth")


def pileup(reads: DataFrame) -> DataFrame:
    """(chrom, pos, a, c, g, t, n, total): bases of reads (chrom, pos, cigar, seq) at each position."""
    empty = F.expr("cast(array() as array<struct<pos:int,base:string>>)")

    def step(acc, p):
        on_ref, on_read = p["op"].isin("D", "M", "N", "=", "X"), p["op"].isin("M", "I", "S", "=", "X")
        n = p["n"]
        bases = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((acc["at"] + k).alias("pos"), F.upper(F.substring(F.col("seq"), acc["r"] + k + 1, F.lit(1))).alias("base")))
        out = F.when(p["op"].isin("M", "=", "X"), F.concat(acc["out"], bases)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.when(on_ref, n).otherwise(0)).alias("at"), (acc["r"] + F.when(on_read, n).otherwise(0)).alias("r"), out.alias("out"))

    cells = F.aggregate(cigar_parts(F.col("cigar")), F.struct(F.col("pos").cast("int").alias("at"), F.lit(0).alias("r"), empty.alias("out")), step)["out"]
    own = reads.select("chrom", F.explode(cells).alias("x")).select("chrom", "x.pos", "x.base")
    count = lambda b: F.sum((F.col("base") == b).cast("long")).alias(b.lower())
    return own.groupBy("chrom", "pos").agg(*[count(b) for b in "ACGTN"], F.count(F.lit(1)).alias("total"))


def fragments(reads: DataFrame) -> DataFrame:
    """(read_id, chrom, strand, start, end): the blocks of each read."""
    return reads.select("read_id", "chrom", "strand", F.explode(cigar_blocks(F.col("pos"), F.col("cigar"), ("M", "=", "X"))).alias("b")).select("read_id", "chrom", "strand", "b.start", "b.end")


def flagged(sam: DataFrame) -> DataFrame:
    """Mapped rows of parsed SAM lines, with their strand from the flag."""
    f = F.col("flag")
    return sam.where(f.bitwiseAND(F.lit(4)) == 0).withColumn("strand", F.when(f.bitwiseAND(F.lit(16)) != 0, "-").otherwise("+"))
