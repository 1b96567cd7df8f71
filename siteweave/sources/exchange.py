"""Data exchange between sites: tables in a shared folder, each with a manifest written last.

The manifest (name, size) is the commit mark: data without one is not there yet. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), removed when the application ends. Only a local session without one gets a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="siteweave-")
        spark.sparkContext.setCheckpointDir(root)
    fs, place = _fs(spark, path := f"{root.rstrip('/')}/{what}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    fs.deleteOnExit(place)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, place = _fs(spark, path)
    fs.create(place, True).close()


def require(spark: SparkSession, paths: list[str], directory: bool | None = None) -> None:
    """Raise unless all paths are there, and are folders (or files) if asked."""
    for p in paths:
        fs, place = _fs(spark, p)
        if not fs.exists(place) or directory is not None and fs.getFileStatus(place).isDirectory() != directory:
            raise FileNotFoundError(p)


def size(spark: SparkSession, path: str) -> int:
    fs, place = _fs(spark, path)
    return int(fs.getContentSummary(place).getLength())


def clean(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    if fs.exists(place):
        fs.delete(place, True)


def upload(df: DataFrame, folder: str, name: str) -> None:
    """Write once: data, then its manifest. An existing manifest raises."""
    spark = df.sparkSession
    if exists(spark, f"{folder}/{name}.upload_manifest"):
        raise FileExistsError(f"{name} was uploaded before")
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    row = spark.createDataFrame([(name, size(spark, f"{folder}/{name}"))], "name string, size long")
    row.coalesce(1).write.parquet(f"{folder}/{name}.upload_manifest")


def uploaded(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of what has a manifest."""
    fs, place = _fs(spark, folder)
    names = [str(s.getPath()) for s in (fs.listStatus(place) if fs.exists(place) else []) if s.getPath().getName().endswith(".upload_manifest")]
    done = [n for n in names if exists(spark, f"{n}/_SUCCESS")]
    return spark.read.schema("name string, size long").parquet(*done) if done else spark.createDataFrame([], "name string, size long")


def missing(spark: SparkSession, folder: str, wanted: list[str]) -> list[str]:
    have = {r["name"] for r in uploaded(spark, folder).collect()}
    return [n for n in wanted if n not in have]


def missing_of(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """Wanted names without a manifest, for lists of any length."""
    return wanted.join(manifests, "name", "left_anti")


def wait(spark: SparkSession, folder: str, wanted: list[str], seconds: float = 3600, pause: float = 2) -> None:
    """Return once all wanted names have manifests; TimeoutError after `seconds`."""
    end = time.monotonic() + seconds
    while left := missing(spark, folder, wanted):
        if time.monotonic() > end:
            raise TimeoutError(f"not uploaded: {', '.join(left)}")
        time.sleep(pause)


def download(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A committed table; one without manifest raises."""
    if missing(spark, folder, [name]):
        raise FileNotFoundError(f"{name} has no manifest")
    return spark.read.parquet(f"{folder}/{name}")


def probe(spark: SparkSession, folder: str) -> bool:
    """Write, read and delete a row."""
    name = f"probe-{time.time_ns()}"
    upload(spark.range(1), folder, name)
    ok = download(spark, folder, name).count() == 1
    clean(spark, f"{folder}/{name}")
    clean(spark, f"{folder}/{name}.upload_manifest")
    return ok


def timestamp_text(pattern: str = "yyyy-MM-dd_HH-mm-ss"):
    return F.date_format(F.current_timestamp(), pattern)


def check_rows(df: DataFrame, least: int, what: str) -> None:
    """Raise unless there are `least` rows."""
    n = df.count()
    if n < least:
        raise ValueError(f"{what}: {n} rows, {least} needed")
