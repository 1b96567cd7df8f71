"""What the operators of this subpackage share: tables cut from their lineage, blocks of hot keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python: 10,000 (Spark's default) of very long texts would not fit a worker.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = "500"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches for this session, unless it has set their size itself."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in a local session, as in tests, a folder of this machine is chosen and set; on any other
    master ValueError is raised, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")

        root = tempfile.mkdtemp(prefix="siteweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


#: Makes Spark remove the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, what: str = "table", tasks: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: no lineage, no second computation.

    What is written is all that is read again, so the shuffle files of the write go with it. tasks: so many tasks and
    files at most, for tables that are known to be small. codec: of the files, where it is not the session's.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    bounded_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := fresh_path(spark, what), compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def tasks_for(rows: int, each: int) -> int:
    """Tasks of `each` rows."""
    return max(1, -(-rows // each))


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(df._written_at)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dealt_pairs(df: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """Rows (task, shard, item): together the tasks bring every two items of a key together, none having over ~2*size.

    A key with more than `size` items is dealt by hash into shards; a task is a pair of shards (lo <= hi), so a hot
    key becomes many bounded tasks. task: struct(key, lo, hi). Keys of one item go.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # dealt anew, so that both sides of the join have exchanges of their own and a hot key can be split
    dealt = df.join(counts.repartition(n), key).withColumn("__s", F.ceil(F.col("__n") / size).cast("int"))
    dealt = dealt.withColumn("__i", F.pmod(F.xxhash64(F.lit(7), F.col(item)), F.col("__s")).cast("int"))
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    task = F.struct(F.col(key).alias("key"), F.least("__i", "__j").alias("lo"), F.greatest("__i", "__j").alias("hi"))
    return dealt.select(task.alias("task"), F.col("__i").alias("shard"), F.col(item).alias("item"))


def pair_blocks(df: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """Rows (task, items) of dealt_pairs(), a row a task; items: array of struct(shard, item)."""
    return dealt_pairs(df, key, item, size).groupBy("task").agg(F.collect_list(F.struct("shard", "item")).alias("items"))


#: Edges of a task of components().
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long): root is the least node that it can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars around the roots. Each
    round is written to the shared folder; minima combine before the shuffle, and joins on hubs can be split.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = tasks_for(edges.count(), EDGES)
    e = materialize(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).where("a < b").distinct(), "edges", few)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v")).unionAll(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(n)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        large, old = materialize(large, "edges", few), e
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.repartition(n), "b").select(F.col("a").alias("b"), F.col("m").alias("a")).where("a < b")
        e = materialize(small.unionAll(low.select("b", F.col("m").alias("a"))).distinct(), "edges", few)
        discard(large, old)
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(e.select(F.col("a"), F.col("a")).distinct())


class Sets:
    """Union-find over hashable items of one task."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
