"""Statistics, histograms, information measures and ordered (window) operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.operators.tiles import carried, numbered, parts_by_group, parts_of, tiled, with_halos

def moments(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Mean, sample variance and deviation; null variance for one value."""
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation, 0 where a variance is 0."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    flat = (F.coalesce(F.var_pop(a), F.lit(0.0)) == 0) | (F.coalesce(F.var_pop(b), F.lit(0.0)) == 0)
    return df.groupBy(*by).agg(F.when(flat, F.lit(0.0)).otherwise(F.corr(a, b)).alias("r"))


def dealt(rep: Column, tie: Column) -> Column:
    """A number from 0 to 2^32 - 1 by the MD5 digest of "rep:tie": an order at random that can be made again."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rep.cast("string"), tie.cast("string"))), 1, 8), 16, 10).cast("long")


def pearson_permutation_z(df: DataFrame, x: str, y: str, replicates: int, tie: str = "id") -> DataFrame:
    """One row: r, and its z-score among correlations with y dealt anew.

    Replicate n pairs the row at a place by the digests of "0:tie" with the row at the same place by those of "n:tie".
    Digests are spread evenly, so their leading bits cut each replicate into parts.
    """
    base = df.select(F.col(tie).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    place = lambda d: numbered(d, F.floor(F.col("d") / (1 << 22)), [F.col("d"), F.col("t")], "k", ["rep"])
    a = place(base.select(reps.alias("rep"), "t", "x", dealt(F.lit(0), F.col("t")).alias("d"))).select("rep", "k", "x")
    b = place(base.select(reps.alias("rep"), "t", "y").withColumn("d", dealt(F.col("rep"), F.col("t")))).select("rep", "k", "y")
    null = pearson(a.join(b, ["rep", "k"]), ["rep"], "x", "y").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return pearson(base, [], "x", "y").crossJoin(null).select("r", F.try_divide(F.col("r") - F.col("m"), F.col("s")).alias("z"))  # two single rows


def zscore(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(v - mean) / sd by group; null where sd is 0 or unknown. A grouped join, so a large group needs no single task."""
    m = moments(df, by, v).select(*by, "mean", "sd") if by else df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    out = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # one row
    return out.withColumn("z", F.try_divide(F.col(v) - F.col("mean"), F.col("sd"))).drop("mean", "sd")


def rank_normalised(df: DataFrame, by: list[str], v: str = "v", tie: str = "id", rows: int | None = None) -> DataFrame:
    """Ordinal rank from 0 in each group; ties by id. Large groups are ordered part by part."""
    own, part, more = parts_by_group(df, by, F.col(v), tie, *([rows] if rows else []))
    return numbered(own, part, [F.col(v), F.col(tie)], "rank", by).withColumn("rank", F.col("rank") - 1).drop(*more)


def rank_descending(df: DataFrame, by: list[str], v: str = "v", tie: str = "id", rows: int | None = None) -> DataFrame:
    """rank_normalised() from the greatest value down; nulls last."""
    own, part, more = parts_by_group(df, by, F.coalesce(-F.col(v), F.lit(float("inf"))), tie, *([rows] if rows else []))
    return numbered(own, part, [F.desc(v), F.col(tie)], "rank", by).withColumn("rank", F.col("rank") - 1).drop(*more)


def quantile_normalised(df: DataFrame, sample: str, v: str = "v", tie: str = "id", rows: int | None = None) -> DataFrame:
    """Each value replaced by the mean over samples at its rank."""
    ranked = rank_normalised(df, [sample], v, tie, rows)
    means = ranked.groupBy("rank").agg(F.avg(v).alias("qn"))
    return ranked.join(means, "rank")


def bh(df: DataFrame, p: str = "p", tie: str = "id", monotone: bool = False) -> DataFrame:
    """q = p n / rank. monotone: the running minimum from the largest p down, capped at 1. Ranks are made part by part (numbered)."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    own, part = parts_of(df, F.col(p))
    out = numbered(own, part, [F.col(p), F.col(tie)], "__r").drop("__cuts").crossJoin(F.broadcast(n))  # one row
    out = out.withColumn("q", F.col(p) * F.col("__n") / F.col("__r"))
    if monotone:
        own, part = parts_of(out, F.col(p))
        own = own.withColumn("__part", part).drop("__cuts")
        up = Window.orderBy(F.desc("__q")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        least = own.groupBy(F.col("__part").alias("__q")).agg(F.min("q").alias("__m")).select("__q", F.min("__m").over(up).alias("__m"))
        w = Window.partitionBy("__part").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
        own = own.join(least, F.col("__part") == F.col("__q"))
        out = own.withColumn("q", F.least(F.lit(1.0), F.col("__m"), F.min("q").over(w))).drop("__part", "__q", "__m")
    return out.drop("__n", "__r")


# ---- histograms ----


def histogram(df: DataFrame, dims: list[Column], names: list[str]) -> DataFrame:
    """(names, n): counts over any number of dimensions."""
    return df.groupBy(*[d.alias(n) for d, n in zip(dims, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"))


def floor_bin(v: Column, size: float = 1.0) -> Column:
    return F.floor(v / size).cast("int")


def marginals(h: DataFrame, names: list[str]) -> DataFrame:
    """All marginals at once: (names, level, n), level being the grouping set's number."""
    return h.cube(*names).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))


def merged_histograms(parts: list[DataFrame], names: list[str]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.sum("n").alias("n"))


def normalised(h: DataFrame) -> DataFrame:
    """With p = n / total."""
    total = h.agg(F.sum("n").alias("__t"))
    return h.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("__t")).drop("__t")  # one row


def entropy(h: DataFrame) -> DataFrame:
    """One row: joint entropy in nats."""
    return normalised(h).where("p > 0").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))


def conditional_entropy(h: DataFrame, of: list[str], given: list[str]) -> DataFrame:
    """One row: H(of, given) - H(given)."""
    joint = entropy(h.groupBy(*of, *given).agg(F.sum("n").alias("n"))).withColumnRenamed("h", "a")
    base = entropy(h.groupBy(*given).agg(F.sum("n").alias("n"))).withColumnRenamed("h", "b")
    return joint.crossJoin(base).select((F.col("a") - F.col("b")).alias("h"))  # two single rows


def _two(p: DataFrame, q: DataFrame, names: list[str]) -> DataFrame:
    a = normalised(p).select(*names, F.col("p").alias("p"))
    b = normalised(q).select(*names, F.col("p").alias("q"))
    return a.join(b, names, "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def kl(p: DataFrame, q: DataFrame, names: list[str]) -> DataFrame:
    """One row: sum of p ln(p / q) over bins that both have."""
    return _two(p, q, names).where("p > 0 AND q > 0").agg(F.coalesce(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def jensen_shannon(p: DataFrame, q: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean divergence from the middle of two histograms of equal mass."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.ln(F.when(x > 0, x).otherwise(1.0) / m)).otherwise(0.0)
    return _two(p, q, names).agg((F.sum(part(F.col("p"))) / 2 + F.sum(part(F.col("q"))) / 2).alias("js"))


def transitions(df: DataFrame, by: list[str], order: list[str], state: str, rows: int | None = None) -> DataFrame:
    """(source, target, n, p): state changes in order within groups. A large group is cut by its first order column, a number or a time; each part begins with the last state of those before it."""
    own, part, more = parts_by_group(df, by, F.col(order[0]), order[1] if len(order) > 1 else None, *([rows] if rows else []))
    last = F.max(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(order)], F.col(state).alias("state")))
    own = carried(tiled(own, part, by), by, {"__last": (last, F.max)}) if more else own.withColumn("__tile", F.lit(0)).withColumn("__last", F.lit(None).cast(df.select(F.struct(F.col(state).alias("state")).alias("x")).schema["x"].dataType))
    w = Window.partitionBy(*by, "__tile").orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.col("__last.state")).otherwise(F.lag(state).over(w))
    pairs = own.withColumn("source", before).where("source IS NOT NULL").groupBy("source", F.col(state).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("source").agg(F.sum("n").alias("__t"))
    return pairs.join(totals, "source").withColumn("p", F.col("n") / F.col("__t")).drop("__t")


def mode(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(by, mode): the most frequent value, the least of several."""
    counts = df.groupBy(*by, v).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(v, F.struct(-F.col("__n"), F.col(v))).alias("mode"))


def log_sum_exp(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """ln of the sum of e^v, about the group's maximum."""
    top = df.groupBy(*by).agg(F.max(v).alias("__m"))
    out = df.join(top, by) if by else df.crossJoin(F.broadcast(top))  # one row
    return out.groupBy(*by, "__m").agg((F.first("__m") + F.ln(F.sum(F.exp(F.col(v) - F.col("__m"))))).alias("lse")).drop("__m")


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


# ---- tracks ----


def bin_totals(track: DataFrame, size: int, borders: DataFrame | None = None) -> DataFrame:
    """(chrom, bin, total, n) of a track (chrom, pos, v) in bins of a length.

    borders (chrom, start, end, region): bins begin anew in each region and none spans a border; (region, bin, total, n).
    """
    if borders is not None:
        from siteweave.operators.intervals import overlaps

        points = track.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "v")
        inside = overlaps(borders, points).select(F.col("a.region").alias("region"), F.floor((F.col("b.start") - F.col("a.start")) / size).cast("int").alias("bin"), F.col("b.v").alias("v"))
        return inside.groupBy("region", "bin").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    return track.groupBy("chrom", F.floor((F.col("pos") - 1) / size).cast("int").alias("bin")).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def region_totals(track: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, total, mean, var, n) over the positions within each region."""
    from siteweave.operators.intervals import overlaps

    points = track.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "v")
    return overlaps(regions, points).groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum("b.v").alias("total"), F.avg("b.v").alias("mean"), F.var_samp("b.v").alias("var"), F.count(F.lit(1)).alias("n"))


def masked(track: DataFrame, regions: DataFrame) -> DataFrame:
    """The track outside the regions."""
    from siteweave.operators.intervals import without_overlap

    points = track.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    return without_overlap(points, regions).drop("start", "end")


def prune_below(wide: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows of which any column reaches its threshold."""
    from siteweave.functions.scalar import any_of

    return wide.where(any_of([F.col(c) >= t for c, t in thresholds.items()]))


#: Positions of a part of a chromosome.
SPAN = 1 << 20


def peaks(track: DataFrame, by: list[str], pos: str, v: str, thresholds: list[int], emit_open: bool = True, span: int = SPAN) -> DataFrame:
    """(by, threshold, start, end): runs of neighbouring positions at or above each threshold. emit_open=False drops a run that the track ends in.

    Positions are numbered part by part; those of a run are as far from their numbers, in whichever parts they lie.
    """
    on = track.select(*by, pos, v, F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")).where(F.col(v) >= F.col("threshold"))
    on = numbered(on, F.floor(F.col(pos) / span), [F.col(pos)], "__k", [*by, "threshold"])
    out = on.groupBy(*by, "threshold", (F.col(pos) - F.col("__k")).alias("__run")).agg(F.min(pos).alias("start"), F.max(pos).alias("end"))
    if not emit_open:
        last = track.groupBy(*by).agg(F.max(pos).alias("__last"))
        out = out.join(last, by).where("end < __last").drop("__last")
    return out.drop("__run")


def smoothed(df: DataFrame, by: list[str], pos: str, v: str, half: int, self_weight: float, iterations: int = 1, span: int = SPAN, rows: int = 1 << 16) -> DataFrame:
    """Moving window of 2 half + 1 places: self_weight for the place itself, the rest shared by the others; cut, not rescaled, at the edges.

    Rows are numbered part by part of `span` positions, and dealt by tiles of `rows` places with as many beyond their
    borders as all iterations reach. What a halo lacks of its own neighbours does not get as far as the tile's own rows.
    """
    placed = numbered(df, F.floor(F.col(pos) / span), [F.col(pos)], "__k", by)
    own = with_halos(placed, by, "__k", half * iterations, rows)
    w = Window.partitionBy(*by, "__tile").orderBy("__k").rowsBetween(-half, half)
    other = (1 - self_weight) / (2 * half)
    for _ in range(iterations):
        own = own.withColumn(v, F.lit(float(self_weight)) * F.col(v) + F.lit(other) * (F.sum(v).over(w) - F.col(v)))
    return own.where("__own").select(*df.columns)


def smoothed_logs(df: DataFrame, by: list[str], pos: str, v: str, half: int, self_weight: float, iterations: int = 1) -> DataFrame:
    """smoothed() of values kept as logarithms: into the linear domain, and back."""
    from siteweave.functions.scalar import xexp, xlog

    own = smoothed(df.withColumn(v, xexp(F.col(v))), by, pos, v, half, self_weight, iterations)
    return own.withColumn(v, xlog(F.col(v)))


def spread_over_powers(df: DataFrame, by: list[str], pos: str, v: str, base: float) -> DataFrame:
    """(by, bin, v): values at positions from 0 summed into bins of growing length, bin = floor(log_base(1 + pos)): the logarithmic index."""
    k = F.floor(F.log1p(F.col(pos).cast("double")) / F.ln(F.lit(float(base))) + 1e-9).cast("int")
    return df.groupBy(*by, k.alias("bin")).agg(F.sum(v).alias(v))


def smoothed_by_powers(df: DataFrame, by: list[str], pos: str, v: str, base: float, half: int, self_weight: float, iterations: int = 1, logs: bool = False) -> DataFrame:
    """(by, bin, v): smoothed() over the logarithmic index; logs: values come and go as logarithms."""
    from siteweave.functions.scalar import xexp, xlog

    own = df.withColumn(v, xexp(F.col(v))) if logs else df
    own = smoothed(spread_over_powers(own, by, pos, v, base), by, "bin", v, half, self_weight, iterations)
    return own.withColumn(v, xlog(F.col(v))) if logs else own


def without_duplicate_samples(signal: DataFrame, sample: str = "sample", keep: str = "copy") -> DataFrame:
    """Of each sample the first copy."""
    first = signal.groupBy(sample).agg(F.min(keep).alias(keep))
    return signal.join(first, [sample, keep], "left_semi")


def signals_side_by_side(signal: DataFrame, samples: list[str]) -> DataFrame:
    """Long signal (chrom, start, end, name, sample, v) -> one column for each sample."""
    return signal.groupBy("chrom", "start", "end", "name").pivot("sample", samples).agg(F.first("v"))
