"""Structured Streaming over an exchange folder: barriers on manifests, and joins of streamed regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteweave.operators.intervals import HIGHEST, LOWEST, STEP, _met, levels_of
from siteweave.sources.exchange import exists, touch

MANIFEST = "name string, size long"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of manifests as they are committed."""
    return spark.readStream.schema(MANIFEST).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*.upload_manifest")


class Barrier(StatefulProcessor):
    """Names seen of a group, kept exactly. A row when the last of `sites` comes, once; with patience, in milliseconds, one with ready false for a group that is not complete so long after its first name."""

    def __init__(self, sites: int, patience: int | None = None) -> None:
        self.sites, self.patience = sites, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "size long")
        self.count = handle.getValueState("count", "n long, fired boolean")

    def _row(self, key, n: int, ready: bool):
        import pandas as pd

        return pd.DataFrame({"group": [key[0]], "n": [n], "ready": [ready]})

    def handleInputRows(self, key, rows, timerValues):
        n, fired = self.count.get() if self.count.exists() else (0, False)
        if n == 0 and self.patience is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        for pdf in rows:
            for name, size in zip(pdf["name"], pdf["size"], strict=True):
                if fired or self.names.containsKey((name,)):
                    continue
                self.names.updateValue((name,), (int(size),))
                n += 1
        done = n >= self.sites and not fired
        self.count.update((n, fired or done))
        if done:
            self.names.clear()  # the count says enough from now on
            for at in list(self.handle.listTimers()) if self.patience is not None else ():
                self.handle.deleteTimer(at)
            yield self._row(key, n, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, fired = self.count.get()
        if not fired:
            yield self._row(key, n, False)

    def close(self) -> None:
        pass


#: Keeps state in column families, which transformWithState needs.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ready_groups(stream: DataFrame, group: Column, sites: int, patience: int | None = None) -> DataFrame:
    """(group, n, ready): a row for each group of which `sites` different names have come, once over all restarts from a checkpoint.

    `group` is a column made from the manifest's name; null names and groups are left out. patience: milliseconds after
    which a group that is still not complete is reported with ready false. Sets the session's state store to RocksDB.
    """
    stream.sparkSession.conf.set(*STATE)
    own = stream.select(group.alias("group"), "name", "size").where("name is not null and group is not null").na.fill(0, ["size"])
    own = own.withColumn("group", F.col("group").cast("string")).groupBy("group")
    return own.transformWithStateInPandas(Barrier(sites, patience), "group string, n long, ready boolean", "Append", "None" if patience is None else "ProcessingTime")


def run_when_ready(stream: DataFrame, group: Column, sites: int, act: Callable[[str], None], checkpoint: str):
    """Start a query that calls act(group) when a group becomes complete (availableNow). After a restart from the checkpoint groups that were acted on are not again; a batch that failed midway is repeated, but for the groups whose mark it left."""
    spark = stream.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        for r in df.where("ready").toLocalIterator():  # the groups that became complete in this batch
            mark = f"{checkpoint.rstrip('/')}-acted/{r['group'].encode().hex()}"
            if not exists(spark, mark):
                act(r["group"])
                touch(spark, mark)

    return ready_groups(stream, group, sites).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def overlaps_streamed(stream: DataFrame, regions: DataFrame, longest: int | None = None) -> DataFrame:
    """Overlap join of a stream of regions with a static table: by the hierarchy of bins, stateless.

    Lengths in the stream are not known beforehand, so the table asks all levels; longest: the length that no region of
    either side exceeds, if it is known.
    """
    every = list(range(LOWEST, HIGHEST + 1, STEP))
    out = _met(stream, regions, every, [] if longest else levels_of(regions)[0], longest)
    return out.select("a", "b", (F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1).alias("l_overlap"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts in event-time windows with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
