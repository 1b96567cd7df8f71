"""Exact dedup by an extendible-hash index on shared files.

Keys are 64-bit hashes of whole texts. A bucket holds the keys that begin with the same bits; grow() starts a directory
with buckets of equal depth and doubles it for as long as some bucket is overfull: such a bucket is split by one more
bit, the others stay. Only keys that occur more than once ask for their texts. Tasks combine equal texts before they
send them to the bucket's owner, which reads its key range in order: what shares a key is a chain, compared byte by
byte. The links of all chains are the index, a Parquet table.

Neither texts nor keys reach the driver. The directory does, with at most MOST buckets: the size of a bucket follows the
size of the data beyond that. Owners hold one chain at a time, so that a large bucket is a longer task, not a larger one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import materialize

#: Bytes of the texts and keys of a bucket, as far as MOST buckets allow it.
BUCKET = 64 << 20
MOST = 1 << 17
KEY = 48  # bytes that a key counts for
#: Bits of the filter of repeated keys: 8 MB, sent to all tasks. A text that it lets through by mistake is a chain of one.
BITS = 1 << 26
FLUSH = 32 << 20  # bytes of distinct texts that a task combines


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth)


def grow(keys: DataFrame, tasks: int, bucket: int = BUCKET, most: int = MOST) -> np.ndarray:
    """The directory of keys (h long, size long): least keys of all buckets, as unsigned numbers in order.

    It has four buckets a task at least and `most` at most. A single key is never split.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    room = max(bucket, -(-4 * total // most))
    depth = max(1, min(int(most).bit_length() - 2, max(4 * tasks - 1, total // room).bit_length()))
    starts = [np.arange(1 << depth, dtype=np.uint64) << np.uint64(64 - depth)]
    open_keys = keys
    while depth < 64:
        sizes = open_keys.groupBy(_prefix(F.col("h"), depth).alias("__p")).agg(F.sum("size").alias("__size"), F.min("h").alias("__a"), F.max("h").alias("__b"))
        full = [r[0] for r in sizes.where(f"__size > {room} and __a < __b").select("__p").collect()]  # most / 4 buckets at most
        if not full:
            break
        depth += 1
        starts.append((np.array(full, np.uint64) * np.uint64(2) + np.uint64(1)) << np.uint64(64 - depth))
        open_keys = keys.where(_prefix(F.col("h"), depth - 1).isin(full)) if len(full) < 100 else keys.join(keys.sparkSession.createDataFrame([(p,) for p in full], "__p long"), _prefix(F.col("h"), depth - 1) == F.col("__p"), "left_semi")
    return np.unique(np.concatenate(starts))


def _repeated_only(rows: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """The rows whose h is one of `repeated`, and few others, by a bitmap of their low bits."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    held = repeated.groupBy(F.bitmap_bucket_number(low).alias("__k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("__bits"))
    at = F.bitmap_bit_position(low)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(held), F.bitmap_bucket_number(low) == F.col("__k")).where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("__k", "__bits")


def chains(rows: DataFrame, directory: np.ndarray, tasks: int) -> DataFrame:
    """(bucket, h, link, sha, n) for rows (h long, t string): one for each text, link its place in the chain of its key, n its copies."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            h = np.array([x[0] for x in held.values()], np.int64)
            bucket = np.searchsorted(directory, h.view(np.uint64), side="right") - 1
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(h), pa.array(list(held), pa.string()), pa.array([x[1] for x in held.values()], pa.int64())], names=["bucket", "h", "t", "n"])

        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (own := held.get(t)) is not None:
                    own[1] += 1
                else:
                    held[t] = [h, 1]
                    size += len(t) + KEY
            if size > FLUSH:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[list] = []
        key = None
        cols: list[list] = [[] for _ in range(5)]

        def close() -> None:
            for link, (text, n) in enumerate(chain):
                sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                for c, v in zip(cols, (key[0], key[1], link, sha, n), strict=True):
                    c.append(v)

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "h", "link", "sha", "n"])

        for batch in batches:
            for bucket, h, t, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != (bucket, h):
                    close()
                    key, chain = (bucket, h), []
                for own in chain:
                    if own[0] == t:
                        own[1] += n
                        break
                else:
                    chain.append([t, n])
            if cols[0]:
                yield out()
                for c in cols:
                    c.clear()
        close()
        if cols[0]:
            yield out()

    sent = rows.select("h", "t").mapInArrow(combined, "bucket int, h long, t string, n long")
    dealt = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket", "h")
    return dealt.mapInArrow(owned, "bucket int, h long, link int, sha binary, n long")


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, bits: int = BITS, key: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of docs.

    Texts are equal if their bytes are; null texts count as empty ones. Of equal texts the row with the largest doc_id
    stays, null ids being the least; of rows that share that id too, exactly one. A group of null ids only has a null
    keep_id. An empty table gives an empty one. Other columns of docs are not looked at. key: the 64-bit key of column t,
    by default its xxHash64.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    h = (F.xxhash64("t") if key is None else key).alias("h")
    keys = materialize(rows.select("doc_id", h, F.octet_length("t").cast("long").alias("size"), F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "keys")
    repeated = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.max("size") + KEY).alias("size"))
    repeated = materialize(repeated.where("n > 1").select("h", "size"), "repeated")
    directory = grow(repeated, tasks, bucket)
    index = materialize(chains(_repeated_only(rows.select(h, "t"), repeated, bits), directory, tasks), "index")
    # the row that stays, of rows with the same key and digest; they meet the chain's link, whose texts are equal
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("row")).alias("row"))).alias("best")
    stays = keys.groupBy("h", "sha").agg(best, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = stays.join(index.where("n > 1"), ["h", "sha"]).select("h", "sha", F.col("best.id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"), F.col("n").alias("group_size"))
    groups = materialize(groups, "groups")  # so that both sides of the join are exchanges that Spark can split where a group is hot
    out = keys.join(groups, ["h", "sha"], "left")
    alone = F.col("keep_row").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
