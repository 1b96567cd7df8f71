"""Annotation features (GFF): filters, parents and extents. Rows as sources.gff() reads them, with a map `attributes`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_source(gff: DataFrame, source: str) -> DataFrame:
    return gff.where(F.col("source") == source)


def by_type(gff: DataFrame, *types: str) -> DataFrame:
    return gff.where(F.col("feature").isin(*types))


def by_property(gff: DataFrame, name: str, value: str | None = None) -> DataFrame:
    v = F.try_element_at("attributes", F.lit(name))
    return gff.where(v.isNotNull() if value is None else v == value)


def with_parents(gff: DataFrame, parent: str = "Parent", own: str = "ID") -> DataFrame:
    """(child, parent) for each parent that a feature names."""
    names = gff.columns
    # flat below the join: columns that nobody asks for are not dealt
    child = gff.select(*[F.col(c).alias(f"__c_{c}") for c in names], F.explode(F.split(F.try_element_at("attributes", F.lit(parent)), ",")).alias("__k"))
    up = gff.select(*[F.col(c).alias(f"__p_{c}") for c in names], F.try_element_at("attributes", F.lit(own)).alias("__k"))
    whole = lambda side: F.struct(*[F.col(f"__{side}_{c}").alias(c) for c in names])
    return child.join(up, "__k").select(whole("c").alias("child"), whole("p").alias("parent"))


def extent(gff: DataFrame, name: str) -> DataFrame:
    """(chrom, strand, value, start, end, n): the largest region of each value of a property."""
    v = F.try_element_at("attributes", F.lit(name))
    return gff.withColumn("value", v).where("value IS NOT NULL").groupBy("chrom", "strand", "value").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
