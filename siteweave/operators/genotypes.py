"""Genotype tables in long form: (var_idx, subject_idx, g), g 0, 1, 2 or -1 where missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.scalar import haplo_to_geno, mean_centre
from siteweave.operators.intervals import overlaps_first


def long_form(wide: DataFrame, keys: list[str], g: str = "g") -> DataFrame:
    """(keys, subject_idx, g) of arrays by position."""
    return wide.select(*keys, F.posexplode(g).alias("subject_idx", "g"))


def wide_form(long: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays by subject_idx: for the text formats, whose rows hold all subjects."""
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("subject_idx", "g"))), lambda x: x["g"]).alias("g"))


def missingness(geno: DataFrame, var: str = "var_idx") -> DataFrame:
    """(var, n_missing, n): genotypes outside 0, 1, 2 per variant."""
    bad = ~F.coalesce(F.col("g").isin(0, 1, 2), F.lit(False))
    return geno.groupBy(var).agg(F.sum(bad.cast("long")).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def impute(geno: DataFrame, var: str = "var_idx") -> DataFrame:
    """Missing genotypes replaced by the floor of the variant's mean; 0 where none is known."""
    ok = F.coalesce(F.col("g").isin(0, 1, 2), F.lit(False))
    fill = geno.groupBy(var).agg(F.coalesce(F.floor(F.avg(F.when(ok, F.col("g")))), F.lit(0)).cast("int").alias("__fill"))
    return geno.join(fill, var).withColumn("g", F.when(ok, F.col("g")).otherwise(F.col("__fill")).cast("int")).drop("__fill")


def impute_wide(wide: DataFrame, g: str = "g") -> DataFrame:
    """impute() of a variant's array in place: no shuffle. The mean is a variable of its own: in the function of the cells it would be made for each of them."""
    ok = F.filter(g, lambda x: x.isin(0, 1, 2))
    mean = F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(ok), F.lit(1))
    filled = F.transform(F.array(F.floor(mean).cast("int")), lambda m: F.transform(g, lambda x: F.when(x.isin(0, 1, 2), x).otherwise(m).cast("int")))
    return wide.withColumn("n_missing", F.size(g) - F.size(ok)).withColumn(g, filled[0])


def subset_outer(geno: DataFrame, variants: DataFrame, samples: DataFrame, var: str = "var_idx") -> DataFrame:
    """(var, sample_pos, sample_id, g) for the listed samples in their order; -1 where a sample has no genotypes.

    variants (var) x samples (sample_pos, sample_id) is the result's own size.
    """
    wanted = variants.select(var).crossJoin(samples.select("sample_pos", "sample_id"))
    return wanted.join(geno.select(var, "sample_id", "g"), [var, "sample_id"], "left").select(var, "sample_pos", "sample_id", F.coalesce("g", F.lit(-1)).cast("int").alias("g"))


def subset_inner(geno: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes of the listed samples that have any; the rest is skipped."""
    return geno.join(samples.select("sample_pos", "sample_id"), "sample_id")


def variants_in_regions(variants: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Each variant that lies in a region, with the first one by position."""
    return overlaps_first(variants, regions, key)


def at_targets(variants: DataFrame, targets: DataFrame, match_names: bool = False) -> DataFrame:
    """Targets (chrom, start = position, name) with the variant at that exact position, or null.

    match_names: one name must contain the other, `.` matches any; ref_match is by the caller's condition.
    """
    x, y = targets.alias("t"), variants.alias("v")
    on = (F.col("t.chrom") == F.col("v.chrom")) & (F.col("t.start") == F.col("v.pos"))
    if match_names:
        a, b = F.col("t.name"), F.col("v.id")
        on = on & ((a == ".") | (b == ".") | F.contains(a, b) | F.contains(b, a))
    return x.join(y, on, "left")


def centred(geno: DataFrame, freqs: DataFrame, scale: float = 1.0, var: str = "var_idx") -> DataFrame:
    """g - 2 AF, scaled; freqs (var, af)."""
    return geno.join(freqs, var).withColumn("gc", mean_centre(F.col("g"), F.col("af"), scale))


def allele_frequencies(geno: DataFrame, var: str = "var_idx") -> DataFrame:
    """(var, af, n) over known genotypes."""
    ok = F.col("g").isin(0, 1, 2)
    return geno.where(ok).groupBy(var).agg((F.sum("g") / (2.0 * F.count(F.lit(1)))).alias("af"), F.count(F.lit(1)).alias("n"))


def merge_cohorts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of two cohorts joined at equal variants. Codings must agree: the cohorts' greatest codes are compared, one row each."""
    top = lambda df: df.agg(F.max(F.array_max("g")).alias("m"))
    same = top(a).select(F.col("m").alias("__x")).crossJoin(top(b).select(F.col("m").alias("__y")))
    out = a.select(*keys, F.col("g").alias("g1")).join(b.select(*keys, F.col("g").alias("g2")), keys).crossJoin(same)
    coding = F.when((F.col("__x") > 2) == (F.col("__y") > 2), F.concat("g1", "g2")).otherwise(F.raise_error(F.lit("cohorts are coded differently")))
    return out.select(*keys, coding.alias("g"))


def merge_cohort_list(parts: list[DataFrame], sizes: list[int], keys: list[str]) -> DataFrame:
    """Arrays of several cohorts side by side for every variant that any has; a cohort without it gives zeros. Of a variant that a cohort holds twice the first array by order counts."""
    each = [p.groupBy(*keys).agg(F.min("g").alias("g")).withColumn("k", F.lit(k)) for k, p in enumerate(parts)]
    held = reduce(DataFrame.unionByName, each).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "g"))).alias("m"))
    filled = [F.coalesce(F.try_element_at("m", F.lit(k)), F.array_repeat(F.lit(0), n)) for k, n in enumerate(sizes)]
    return held.select(*keys, F.concat(*filled).alias("g"))


def concat_variants(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def haplotypes_to_dosage(geno: DataFrame) -> DataFrame:
    return geno.withColumn("g", haplo_to_geno(F.col("g")))


def parsed_name(name: Column) -> Column:
    """id_REF_ALT -> struct(id, ref, alt); the id may hold underscores."""
    parts = F.split(name, "_")
    n = F.size(parts)
    pick = lambda back: F.when(n >= 3, F.try_element_at(parts, F.lit(-back))).otherwise(F.lit("."))
    return F.struct(F.when(n >= 3, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), "_")).otherwise(name).alias("id"), pick(2).alias("ref"), pick(1).alias("alt"))


def mutation_matrix(variants: DataFrame, bands: list[float]) -> DataFrame:
    """(band, ref, alt, n): substitutions by band of derived allele frequency daf."""
    band = reduce(lambda acc, b: acc + (F.col("daf") >= b).cast("int"), bands, F.lit(0))
    return variants.groupBy(band.alias("band"), "ref", "alt").agg(F.count(F.lit(1)).alias("n"))


def block_of(var_idx: Column, size: int) -> Column:
    return F.floor(var_idx / size).cast("int")


def last_block_start(n: int, size: int) -> int:
    """First variant of the last whole block."""
    return n - n % size - size
