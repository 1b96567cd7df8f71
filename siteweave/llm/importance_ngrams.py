"""Target-distribution importance resampling over a position table of words.

The words of a text are exploded with their positions; lead() over the positions of a row gives the words that follow,
one window for all orders. Each run of words is hashed to a bucket; buckets are counted in both tables, and joined to
their gains they give a document's weight. Drawing without replacement by weight adds noise of Gumbel's distribution,
made from a digest of the id, and takes the highest.

Texts are dealt by a number of their own before they are exploded, so that the window needs no other exchange and a hot
id, source or text none of its own. The position table is written once, its words as codes of their buckets, and read for
the counts and for the weights. Only the gains, a number a bucket, are sent to all tasks. Scores are whole numbers of a
narrow range: places are counted score by score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm._common import materialize
from siteweave.operators.stats import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is neither a digit, a small letter nor beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS = 2
BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20


def words_of(text: Column) -> Column:
    """Words of a text, in its order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def positions(rows: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, id, pos, g1, g2, ...) for rows (row long, id, text): a row a word, g<k> the k words from there, null where fewer follow. A text without words has one row of nulls."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "row").sortWithinPartitions("row")  # words come out in the window's order, so that its sort finds one run
    table = dealt.select("row", "id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "g1"))
    w = Window.partitionBy("row").orderBy("pos")
    follow = table.select("*", *[F.lead("g1", k).over(w).alias(f"w{k + 1}") for k in range(1, orders)])
    runs = {"g1": F.col("g1")}
    for k in range(2, orders + 1):
        runs[f"g{k}"] = F.concat(runs[f"g{k - 1}"], F.lit(" "), F.col(f"w{k}"))  # null if a word is
    return follow.select("row", "id", "pos", *[c.alias(name) for name, c in runs.items()])


def bucketed(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, b1, b2, ...): positions() with the bucket of each run of words."""
    bucket = lambda c: F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(buckets)).cast("int")
    return positions(rows, orders).select("row", "id", *[bucket(f"g{k}").alias(f"b{k}") for k in range(1, orders + 1)])


def counted(table: DataFrame) -> DataFrame:
    """(bucket, n) of the columns b1, b2, ..."""
    each = F.explode(F.array(*[c for c in table.columns if c.startswith("b")])).alias("bucket")
    return table.select(each).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long) for all buckets, of the counts (bucket, n) in both tables: 1000 times the logarithm of the ratio of their smoothed frequencies, floored."""
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(docs.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.col("all_s") + buckets) / (d(F.col("s") + 1) * d(F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # sums: one row


def weighted(table: DataFrame, gain: DataFrame) -> DataFrame:
    """(row, id, n_words, n_features, weight) of bucketed() rows: the floored mean of their gains (bucket, gain)."""
    names = [c for c in table.columns if c.startswith("b")]
    out = table
    for c in names:  # `buckets` rows
        out = out.join(F.broadcast(gain.select(F.col("bucket").alias(c), F.col("gain").alias(f"gain_{c}"))), c, "left")
    total, size = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in names:
        total, size = total + F.coalesce(F.sum(f"gain_{c}"), F.lit(0)), size + F.count(c)
    sums = out.groupBy("row").agg(F.first("id").alias("id"), F.count(names[0]).alias("n_words"), size.alias("n_features"), total.alias("total"))
    n = F.greatest("n_features", F.lit(1))
    return sums.select("row", "id", "n_words", "n_features", F.call_function("div", F.col("total") - F.pmod("total", n), n).alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank per row of docs, rank null for those that are not drawn.

    Null texts have no words; they and empty ones have weight 0. Rows of equal ids draw the same noise; of equal scores
    the smaller id comes first, null ids last, and then rows in their order. Of the rows with `least_words` words or more,
    `percent` in a hundred are drawn. Without target texts all counts t are 0. Empty docs give no rows. Other columns of
    either table are not looked at.
    """
    rows = lambda df, c, i: df.select(F.monotonically_increasing_id().alias("row"), i.cast("long").alias("id"), F.col(c).alias("text"))
    own = materialize(bucketed(rows(docs, text, F.col(doc_id)), orders, buckets), "positions")
    asked = bucketed(rows(target, target_text, F.lit(0)), orders, buckets)
    gain = materialize(gains(counted(own), counted(asked), buckets).repartition(1), "gains")  # `buckets` rows in one file
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighted(own, gain).withColumn("score", F.col("weight") + noise), "scores")
    drawn = scored.where(F.col("n_words") >= least_words).withColumn("low", -F.col("score"))
    n = drawn.agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("n"))
    placed = numbered(drawn, F.col("low"), [F.col("id").asc_nulls_last(), F.col("row")], "place").crossJoin(F.broadcast(n))  # n: one row
    out = lambda df, rank: df.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    return out(placed, F.when(F.col("place") <= F.col("n"), F.col("place"))).unionAll(out(scored.where(F.col("n_words") < least_words), F.lit(None)))
