"""A store of regions clustered by position: what lies in a region is read from its row groups only.

Rows are dealt by ranges of (chrom, start), sorted, and written as Parquet in a folder for each chromosome, whose name
begins with a letter so that numbers stay names. Row groups are small and carry the least and greatest start and end, so
a scan with a condition on both skips the others; Spark plans no file of another chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators.intervals import merge, overlaps

#: Bytes of a row group, and rows of a file at most.
GROUP = 1 << 20
ROWS = 1 << 22
#: Regions that one scan asks for as a condition; more are joined.
ASKED = 200


def _place(chrom: Column) -> Column:
    return F.concat(F.lit("c"), F.coalesce(chrom, F.lit("")))


def write(regions: DataFrame, path: str, files: int | None = None, group: int = GROUP) -> None:
    """Regions (chrom, start, end, ...) as a store. files: ranges that the rows are dealt to, by default as many as the session has shuffle partitions; a chromosome spans several of them, a range may hold several."""
    n = files or int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = regions.withColumn("place", _place(F.col("chrom"))).repartitionByRange(n, "chrom", "start").sortWithinPartitions("place", "start", "end")
    out = own.write.mode("overwrite").partitionBy("place").option("parquet.block.size", group).option("parquet.page.size", group // 8).option("maxRecordsPerFile", ROWS)
    out.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _asked(chrom: str, start: int, end: int) -> Column:
    return (F.col("place") == f"c{chrom}") & (F.col("start") <= end) & (F.col("end") >= start)


def scan(spark: SparkSession, path: str, regions: list[tuple[str, int, int]]) -> DataFrame:
    """Rows that overlap one of the regions (chrom, start, end), each once; the regions become conditions of the scan."""
    test = F.lit(False)
    for r in regions:
        test = test | _asked(*r)
    return read(spark, path).where(test).drop("place")


def within(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Rows that overlap one of the regions, a table (chrom, start, end) of any size, each once.

    Up to ASKED runs of the regions are conditions of the scan. More are joined, and the scan asks for the chromosomes and
    the span that they cover.
    """
    runs = merge(regions.select("chrom", "start", "end")).select("chrom", "start", "end")
    few = runs.limit(ASKED + 1).collect()
    if len(few) <= ASKED:
        return scan(spark, path, [tuple(r) for r in few])
    spans = regions.groupBy("chrom").agg(F.min("start").alias("s"), F.max("end").alias("e")).limit(ASKED + 1).collect()
    own = scan(spark, path, [tuple(r) for r in spans]) if len(spans) <= ASKED else read(spark, path).drop("place")
    return overlaps(own.withColumn("__row", F.monotonically_increasing_id()), runs).select("a.*").dropDuplicates(["__row"]).drop("__row")
