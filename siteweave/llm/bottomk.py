"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least distinct 64-bit hashes of a text's shingles. Sketches of parts merge into that of the whole;
two of them estimate resemblance and containment, one the number of distinct shingles. Up to k shingles all is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

K = 256
WORDS = 5
LEAST = -(1 << 63)


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k least distinct hashes, ascending: A-Z lowered, words between ASCII white space, shingles of `words` (fewer: all of them), XXH64. No words: empty."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    if n == 1:
        return np.array([xxh64_intdigest(b" ".join(w))], np.uint64)
    whole, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    h = np.fromiter((xxh64_intdigest(whole[a:b]) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    return np.unique(h)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    both = merged(a, b, k)
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has; all of none."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    union = distinct(merged(a, b, k), k)
    return min(1.0, j * union / distinct(a, k))


def written(a: np.ndarray) -> str:
    """A sketch as text: base64 of its little-endian hashes."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def sketches(docs: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> F.Column:
    """The column array<long> of sketches of docs[text], as signed numbers; null texts count as empty."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, k, words).view(np.int64).tolist() for t in texts])

    return of(docs[text])


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """docs (id, text) dealt by ranges, ids descending, texts of an id ascending: (part, trail, id, text). Each part ends with the row that follows its last one, marked trail; after the last row comes the first.

    Ranges end at quantiles of the ids. An id that several quantiles fall on is cut further, at quantiles of its texts'
    first seven bytes as a number.
    """
    first_bytes = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = docs.select("id", "text", F.coalesce("id", F.lit(LEAST)).alias("key"), first_bytes.alias("at"))
    got = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] if parts > 1 else []
    cuts, times = np.unique(np.asarray(got or [], np.int64), return_counts=True)
    hot = {int(c): int(m) for c, m in zip(cuts, times, strict=True) if m > 1}
    inner: dict[int, np.ndarray] = {}
    if hot:
        each = rows.where(F.col("key").isin(list(hot))).groupBy("key").agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 100 * parts).alias("q"))
        for r in each.collect():  # at most half as many ids as parts
            q = np.asarray(r["q"], np.int64)
            inner[r["key"]] = np.unique(q[np.linspace(0, len(q) - 1, hot[r["key"]] + 1).astype(int)[1:-1]])
    # ranges by upper end, the greatest first; a hot id's rows lie in the first parts of its range, what is below it in the last
    sizes = np.array([1, *[1 + len(inner.get(int(c), ())) for c in cuts[::-1]]], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))

    def number(key: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = len(cuts) - np.searchsorted(cuts, key, side="left")
        out = begin[k] + sizes[k] - 1
        for c, q in inner.items():
            own = key == c
            out[own] = begin[k[own]] + np.searchsorted(q, at[own], side="left")
        return out.astype(np.int32)

    @F.pandas_udf(IntegerType())
    def part(key: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(number(key.to_numpy(np.int64), at.to_numpy(np.int64)), dtype="int32")

    # a part's head: of its greatest id the least text's bytes; rows that share both are told apart by their order only
    heads = rows.groupBy(part("key", "at").alias("part")).agg(F.max(F.struct("key", (-F.col("at")).alias("at"))).alias("head")).collect()
    order = sorted(r["part"] for r in heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}
    to = {(r["head"]["key"], -r["head"]["at"]): before[r["part"]] for r in heads}

    @F.pandas_udf(ArrayType(IntegerType()))
    def parts_of(key: pd.Series, at: pd.Series) -> pd.Series:
        own = number(key.to_numpy(np.int64), at.to_numpy(np.int64)).tolist()
        return pd.Series([[p, t] if (t := to.get(x)) is not None else [p] for p, x in zip(own, zip(key.tolist(), at.tolist(), strict=True), strict=True)])

    dealt = rows.select("id", "text", "key", F.posexplode(parts_of("key", "at")).alias("trail", "part"))
    return dealt.repartitionById(max(1, int(begin[-1])), F.col("part")).sortWithinPartitions("part", "trail", F.desc("key"), F.asc("text"))


def edited(text: str, other: str) -> str:
    """The last third of a text's code points replaced by the first as many of another's."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, contained_edited, contained_next per row.

    n_distinct estimates the number of distinct shingles, contained_* the part of the text's shingles that the edited
    text, the next document, has.

    The next document is that of the next lower id, after the least one that of the greatest; equal ids follow each other
    by their texts, null ids come last. A single document is its own next. Null texts are empty. Each task gets a
    range of rows, sorted, and the row after its last; an id of very many rows is several ranges. Nothing else is moved.
    Other columns are not looked at.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _neighbours(docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")), parts)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "contained_edited", "contained_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            ids, texts, trails, at = (batch.column(k) for k in range(4))
            for n in range(batch.num_rows):
                part = at[n].as_py()
                if before is None or before[3] != part:
                    if trails[n].as_py():
                        continue  # of several equal heads the first is enough
                    own = texts[n].as_py()
                    before = (ids[n].as_py(), own, sketch(own, k, words), part)
                    continue
                own = texts[n].as_py()
                now = (ids[n].as_py(), own, sketch(own, k, words), part)
                new = edited(before[1], own)
                other = sketch(new, k, words)
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                row = (before[0], len(before[1]), digest, written(before[2]), written(other), resemblance(before[2], other, k), resemblance(before[2], now[2], k), distinct(before[2], k), containment(before[2], other, k), containment(before[2], now[2], k))
                for c, value in zip(cols, row, strict=True):
                    c.append(value)
                before = None if trails[n].as_py() else now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained_edited double, contained_next double"
    return rows.select("id", "text", "trail", "part").mapInArrow(compare, schema)
