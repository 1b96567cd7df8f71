"""Genome sequences in chunks (chrom, start, seq), start counted from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions.scalar import reverse_complement
from siteweave.operators.intervals import overlaps


def extracted(chunks: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, seq): bases of each region (chrom, start, end, strand), joined over chunks; complemented backwards on the minus strand."""
    own = chunks.withColumn("end", F.col("start") + F.length("seq") - 1)
    parts = overlaps(regions, own).select(
        F.col(f"a.{key}").alias(key), F.col("a.strand").alias("strand"), F.struct(F.col("ol_start").alias("at"), F.substring(F.col("b.seq"), F.col("ol_start") - F.col("b.start") + 1, F.col("l_overlap")).alias("s")).alias("p")
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "")
    out = parts.groupBy(key, "strand").agg(whole.alias("s"))
    return out.select(key, F.when(F.col("strand") == "-", reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"))


def composition(chunks: DataFrame) -> DataFrame:
    """(chrom, base, n)"""
    base = lambda b: F.struct(F.lit(b).alias("base"), (F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit("")))).alias("n"))
    return chunks.select("chrom", F.explode(F.array(*[base(b) for b in "ACGTN"])).alias("x")).groupBy("chrom", F.col("x.base").alias("base")).agg(F.sum("x.n").alias("n"))
