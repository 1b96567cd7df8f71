"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne 2007).

Training counts words and word pairs of all training texts. Counts are quantised on a log scale; a filter holds, for an
n-gram of level q, the q members (n-gram, 1) .. (n-gram, q), and reading probes level after level until one misses. A
word has level 1 + floor(2 log2 c) and a pair 1 + floor(log2 c), so all that was seen is in; only if scored() is told to
leave out pairs seen once (once=False) a pair has floor(log2 c). The filter is cut into slices by hash: a slice is
counted and filled in one task from what all parts of the corpus send it, so no task and not the driver sees all
n-grams. A slice has MEMBER_BITS bits for each member put into it, however many there are, so that the part of bits set
(some 22 %) and of false hits (some 0.24 % a probe) is the same at all sizes.

The filter is never in one place: texts are taken in chunks of some ASK tokens; a chunk sends each slice the distinct
pairs and words that it asks for, the slice answers with the levels that its filter gives (and the exact counts of the
words, for the base score), and the answers meet the chunk's tokens. Only the counts of at most HOT words are
broadcast; these words need not be asked for.

Scores: base uses the exact counts, P1(w) = (c + 0.1) / (N + 0.1 (V + 1)). The model interpolates:
P(w | h) = L(h) q(h w) / q(h) + (1 - L(h)) P1'(w), where q is the least count of a level (of a hot word its count), P1'
is P1 with the word's q and L(h) is MIX if the word before was seen in training (without pairs seen once: at least
twice), else 0 (and at the beginning). As q(h w) is cut to q(h), P(w | h) is at most one.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import materialize

MEMBER_BITS = 16
HOT = 150_000
#: Bytes of a hot word at most.
SHORT = 256
HASHES = 4
MIX = 0.3
FLUSH = 1_500_000
ASK = 750_000
#: Bytes of a key within its slice, whose number is the key's top bits. A slice has some million n-grams at all sizes of the corpus, so two of them share a key in some 0.03 % of cases.
KEY = 4
LOW = np.uint64((1 << 8 * KEY) - 1)
END = b"\n"  # no word holds white space


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)


class Filter:
    """One slice: a Bloom filter of the n-grams whose keys' top bits name it."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, len(bits) * 8

    @staticmethod
    def places(key: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        """Bit numbers within a slice of `size` bits."""
        with np.errstate(over="ignore"):
            x = mixed((key & LOW) + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
            step = (x >> np.uint64(32)) | np.uint64(1)
            for k in range(HASHES):
                yield ((x + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)

    def levels(self, keys: np.ndarray, most: int = 63) -> np.ndarray:
        """The level of each key: probes until a miss."""
        out = np.zeros(len(keys), np.uint8)
        todo = np.arange(len(keys))
        for level in range(1, most + 1):
            hit = np.ones(len(todo), bool)
            for place in self.places(keys[todo], level, self.size):
                hit &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            todo = todo[hit]
            if not len(todo):
                break
            out[todo] = level
        return out


def word_level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(c)).astype(np.int64)


def pair_level(c: np.ndarray, once: bool) -> np.ndarray:
    return once + np.floor(np.log2(c)).astype(np.int64)


def filled(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bits of a slice that holds keys up to their levels."""
    flags = np.zeros(max(1 << 13, -(-MEMBER_BITS * int(levels.sum()) // 8) * 8), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for at in Filter.places(keys, level, len(flags)):
            flags[at] = True
    return np.packbits(flags, bitorder="little")


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (keys >> np.uint64(65 - slices.bit_length())).astype(np.int64) if slices > 1 else np.zeros(len(keys), np.int64)


def cut(present: np.ndarray, of_keys: np.ndarray) -> list[slice]:
    """Where the keys of each slice in `present` lie, of keys in the order of their slices `of_keys`. Slices without keys are not looked at, however many there are."""
    return [slice(x, y) for x, y in zip(np.searchsorted(of_keys, present).tolist(), np.searchsorted(of_keys, present, side="right").tolist(), strict=True)]


def within(keys: np.ndarray, slices: int) -> np.ndarray:
    """The KEY bytes of keys that follow their slice's number: in the order of the keys of a slice."""
    return (keys << np.uint64(slices.bit_length() - 1)) >> np.uint64(64 - 8 * KEY)


def sent_keys(keys: np.ndarray) -> bytes:
    """Sorted keys within a slice: their differences, byte by byte, packed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
    return zlib.compress(np.ascontiguousarray(gaps.T).tobytes(), 1)


def read_keys(data: bytes) -> np.ndarray:
    low = np.frombuffer(zlib.decompress(data), np.uint8).reshape(KEY, -1)
    gaps = np.zeros((low.shape[1], 8), np.uint8)
    gaps[:, :KEY] = low.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def word_key(h: np.ndarray) -> np.ndarray:
    """The filter's key of a word of hash h: apart from all pairs' keys."""
    return h ^ np.uint64(0x5851F42D4C957F2D & ((1 << 40) - 1))


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Of the histogram of counts: eighths of their logarithm."""
    return np.floor(8 * np.log2(counts)).astype(np.int32)


def unpacked(words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a slice and their counts."""
    names = zlib.decompress(words)
    return names.split(b" ") if names else [], np.frombuffer(zlib.decompress(counts), "<u8").astype(np.int64)


def _over(bound: int):
    """Slices -> (word, c) of their short words whose count lies in the bin `bound` or above."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column(0), batch.column(1), strict=True):
                names, counts = unpacked(w.as_py(), n.as_py())
                kept = [(names[k], int(counts[k])) for k in np.flatnonzero(bin_of(counts) >= bound).tolist() if len(names[k]) <= SHORT]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.binary()), pa.array([x[1] for x in kept], pa.int64())], names=["word", "c"])

    return over


class _Numbers(dict):
    """word -> number, given in order of appearance."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def _count(slices: int):
    """Texts -> (slice, words, word_counts, pairs, pair_counts, docs): what a part of the corpus holds for each slice."""
    from xxhash import xxh64_intdigest

    def sent(numbers: _Numbers, parts: list[np.ndarray], docs: int) -> pa.RecordBatch:
        names = list(numbers)
        h = np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))
        seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        counts = np.bincount(seq, minlength=len(names))
        # a pair ends at each word but the first of a text; texts end with END, number 0
        after = np.flatnonzero(seq[:-1] != 0) + 1 if len(seq) else np.zeros(0, np.int64)
        pairs, times = np.unique(pair_hash(h[seq[after - 1]], h[seq[after]]), return_counts=True)
        top, pair_top = slice_of(h, slices), slice_of(pairs, slices)
        order = np.argsort(top[1:], kind="stable") + 1
        present = np.unique(np.concatenate(([0], top[1:], pair_top)))
        low = within(pairs, slices)
        cols: list[list] = [[] for _ in range(6)]
        for s, words_at, p in zip(present.tolist(), cut(present, top[order]), cut(present, pair_top), strict=True):
            own = order[words_at]
            cols[0].append(s)
            cols[1].append(b" ".join([names[k] for k in own.tolist()]))
            cols[2].append(counts[own].astype("<u4").tobytes())
            cols[3].append(sent_keys(low[p]))
            cols[4].append(times[p].astype("<u4").tobytes())
            cols[5].append(docs if s == 0 else 0)
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slice", "words", "word_counts", "pairs", "pair_counts", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, held, docs = _Numbers({END: 0}), [], 0, 0
        for batch in batches:
            for t in batch.column(0):
                w = words(t.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, [*w, END]), np.int32, len(w) + 1))
                held, docs = held + len(w) + 1, docs + 1
                if held >= FLUSH:
                    yield sent(numbers, parts, docs)
                    numbers, parts, held, docs = _Numbers({END: 0}), [], 0, 0
        if docs:
            yield sent(numbers, parts, docs)

    return count


def _reduce(slices: int, once: bool):
    """All rows of a slice -> its words and their counts, packed, a histogram of the counts, and its filter."""
    from collections import Counter

    from xxhash import xxh64_intdigest

    def reduce(key, table):
        c: Counter = Counter()
        for w, n in zip(table["words"], table["word_counts"], strict=True):
            if w := w.as_py():
                c.update(dict(zip(w.split(b" "), np.frombuffer(n.as_py(), "<u4").tolist(), strict=True)))
        names, counts = list(c), np.fromiter(c.values(), np.int64, len(c))
        keys = np.concatenate([np.zeros(0, np.uint64), *[read_keys(x.as_py()) for x in table["pairs"]]])
        times = np.frombuffer(b"".join(x.as_py() for x in table["pair_counts"]), "<u4").astype(np.int64)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        level = pair_level(np.add.reduceat(times, first), once) if len(first) else np.zeros(0, np.int64)
        own = within(word_key(np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))), slices)
        bits = filled(np.concatenate([own, keys[first]]), np.concatenate([word_level(counts), level]))
        docs = sum(x.as_py() for x in table["docs"])
        short = counts[np.fromiter((len(w) <= SHORT for w in names), bool, len(names))]
        bins, sizes = np.unique(bin_of(short), return_counts=True)
        return pa.table(
            {
                "slice": pa.array([key[0].as_py()], pa.int32()),
                "words": pa.array([zlib.compress(b" ".join(names), 1)], pa.binary()),
                "counts": pa.array([zlib.compress(counts.astype("<u8").tobytes(), 1)], pa.binary()),
                "bins": pa.array([bins.tolist()], pa.list_(pa.int32())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                "distinct": pa.array([len(names)], pa.int64()),
                "total": pa.array([int(counts.sum())], pa.int64()),
                "docs": pa.array([docs], pa.int64()),
                "bits": pa.array([bits.tobytes()], pa.binary()),
            }
        )

    return reduce


ASKED = "chunk long, slice int, data binary, names binary, rid long, doc_id {}, held_out boolean"


def _after(seq: np.ndarray) -> np.ndarray:
    """Where a pair ends: at each word but the first of a text."""
    return np.flatnonzero(seq[:-1] != 0) + 1


def _wanted(seq: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, rare): the keys of a chunk's pairs in order, and its words that are not hot in the order of their slices."""
    after = _after(seq)
    rare = np.flatnonzero(hot < 0)
    return pair_hash(h[seq[after - 1]], h[seq[after]]), rare[np.argsort(h[rare] >> np.uint64(40), kind="stable")]


def _hot(names: list[bytes], model: dict) -> np.ndarray:
    """The count of each word if it is hot, else -1; the end comes first."""
    out = np.fromiter((model["hot"].get(w, -1) for w in names), np.int64, len(names))
    out[0] = model["ends"]
    return out


def _ask(model, kind: pa.DataType):
    """Texts -> a row for each, and for each chunk of them its tokens (slice -1) and what it asks of each slice."""
    from xxhash import xxh64_intdigest

    names = ["chunk", "slice", "data", "names", "rid", "doc_id", "held_out"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), kind, pa.bool_()]

    def rows_of(cols: dict) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        slices = m["slices"]
        rid = TaskContext.get().partitionId() << 40

        def done() -> Iterator[pa.RecordBatch]:
            listed = list(numbers)
            seq, lengths = np.concatenate(seqs), np.fromiter(map(len, seqs), np.int64, len(seqs))
            # numbered anew, the end first and then by frequency: tokens pack better
            times = np.bincount(seq, minlength=len(listed))
            times[0] = len(seq) + 1
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            seq, listed = rank[seq], [listed[k] for k in order.tolist()]
            h = np.fromiter(map(xxh64_intdigest, listed), np.uint64, len(listed))
            pairs, rare = _wanted(seq, h, _hot(listed, m))
            pairs = np.unique(pairs)
            low, pair_top, word_top = within(pairs, slices), slice_of(pairs, slices), slice_of(h[rare], slices)
            present = np.unique(np.concatenate((pair_top, word_top)))
            planes = np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            cols: dict[str, list] = {"slice": [-1], "data": [pickle.dumps((lengths.astype("<u4"), zlib.compress(planes.tobytes(), 1)), 5)], "names": [zlib.compress(b" ".join(listed[1:]), 1)]}
            for s, p, words_at in zip(present.tolist(), cut(present, pair_top), cut(present, word_top), strict=True):
                own = rare[words_at]
                cols["slice"].append(s)
                cols["data"].append(sent_keys(low[p]))
                cols["names"].append(zlib.compress(b" ".join([listed[k] for k in own.tolist()]), 1) if len(own) else None)
            yield rows_of(cols | {"chunk": [rid] * len(cols["slice"])})
            yield rows_of({"rid": list(range(rid, rid + len(seqs))), "doc_id": ids, "held_out": outs})

        numbers, seqs, ids, outs, held = _Numbers({END: 0}), [], [], [], 0
        for batch in batches:
            for d, out, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = words(t.as_py())
                seqs.append(np.fromiter(map(numbers.__getitem__, [*w, END]), np.int32, len(w) + 1))
                ids.append(d)
                outs.append(out)
                held += len(w) + 1
                if held >= ASK:
                    yield from done()
                    rid += len(seqs)
                    numbers, seqs, ids, outs, held = _Numbers({END: 0}), [], [], [], 0
        if seqs:
            yield from done()

    return ask


def _answer(slices: int):
    """A slice and what all chunks ask of it -> (chunk, slice, data, names): the levels of the pairs, a byte each; the levels of the words and then their counts."""
    from xxhash import xxh64_intdigest

    def answer(key, own, asked):
        held, counts = None, {}
        if own.num_rows:
            held = Filter(np.frombuffer(own["bits"][0].as_py(), np.uint8))
            w, n = unpacked(own["words"][0].as_py(), own["counts"][0].as_py())
            counts = dict(zip(w, n.tolist(), strict=True))
        levels = lambda keys: held.levels(keys) if held else np.zeros(len(keys), np.uint8)
        data, names = [], []
        for pairs, listed in zip(asked["data"], asked["names"], strict=True):
            data.append(zlib.compress(levels(read_keys(pairs.as_py())).tobytes(), 1))
            w = zlib.decompress(listed.as_py()).split(b" ") if listed.is_valid else []
            keys = within(word_key(np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))), slices)
            names.append(zlib.compress(levels(keys).tobytes() + np.array([counts.get(x, 0) for x in w], "<u8").tobytes(), 1))
        return pa.table({"chunk": asked["chunk"].cast(pa.int64()), "slice": asked["slice"].cast(pa.int32()), "data": pa.array(data, pa.binary()), "names": pa.array(names, pa.binary())})

    return answer


def _score(model, below: float, once: bool):
    """A chunk's tokens and the answers of all slices -> (rid, n_tokens, n_known, base_score, score)."""
    from xxhash import xxh64_intdigest

    def score(key, table):
        parts = dict(zip(table["slice"].to_pylist(), zip(table["data"].to_pylist(), table["names"].to_pylist(), strict=True), strict=True))
        blob, listed = parts.pop(-1)
        lengths, planes = pickle.loads(blob)
        planes = np.frombuffer(zlib.decompress(planes), np.uint8).reshape(4, -1)
        seq = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        listed = zlib.decompress(listed)
        listed = [END, *(listed.split(b" ") if listed else [])]
        h = np.fromiter(map(xxh64_intdigest, listed), np.uint64, len(listed))
        count = _hot(listed, model.value)
        pairs, rare = _wanted(seq, h, count)
        keys, at = np.unique(pairs, return_inverse=True)
        got = [tuple(map(zlib.decompress, parts[s])) for s in sorted(parts)]
        sizes = [len(x) // 9 for _, x in got]
        level = np.frombuffer(b"".join(x[:n] for (_, x), n in zip(got, sizes, strict=True)), np.uint8).astype(float)
        guess = count.astype(float)
        guess[rare] = np.where(level > 0, np.ceil(2.0 ** ((level - 1) / 2)), 0)
        count[rare] = np.frombuffer(b"".join(x[n:] for (_, x), n in zip(got, sizes, strict=True)), "<u8").astype(np.int64)
        of_pairs = np.frombuffer(b"".join(x for x, _ in got), np.uint8).astype(float)[at] if len(keys) else np.zeros(0)
        q = guess[seq]
        p = (q + 0.1) / below
        after = _after(seq)
        before = q[after - 1]
        seen = before >= (1 if once else 2)
        after, before, of_pairs = after[seen], before[seen], of_pairs[seen]
        p[after] = MIX * np.minimum(np.where(of_pairs > 0, 2.0 ** (of_pairs - once), 0) / before, 1) + (1 - MIX) * p[after]
        starts = np.cumsum(np.r_[0, lengths[:-1]]).astype(np.int64)
        c = count[seq]
        return pa.table(
            {
                "rid": pa.array(range(key[0].as_py(), key[0].as_py() + len(lengths)), pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(np.log10((c + 0.1) / below), starts)),
                "score": pa.array(np.add.reduceat(np.log10(p), starts)),
            }
        )

    return score


def train(texts: DataFrame, once: bool = False) -> tuple[DataFrame, dict]:
    """texts (text) -> (slice, words, counts, bits): the counts of all words and the filter; and to be broadcast: hot words and totals."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = min(1 << 24, 1 << max(0, (chars >> 23)).bit_length())
    sent = texts.mapInArrow(_count(slices), "slice int, words binary, word_counts binary, pairs binary, pair_counts binary, docs long")
    kinds = "slice int, words binary, counts binary, bins array<int>, sizes array<long>, distinct long, total long, docs long, bits binary"
    done = materialize(sent.groupBy("slice").applyInArrow(_reduce(slices, once), kinds), "slices")
    total, distinct, ends = done.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "docs")]).first()
    # the most frequent words, at most HOT: those above a bound of the (short) histogram of their counts
    each = done.select(F.explode(F.arrays_zip("bins", "sizes")).alias("x")).groupBy(F.col("x.bins").alias("b")).agg(F.sum("x.sizes").alias("n"))
    bound, sofar = None, 0
    for r in sorted(each.collect(), key=lambda r: -r["b"]):
        sofar += r["n"]
        if sofar > HOT:
            break
        bound = r["b"]
    hot = {} if bound is None else {bytes(r["word"]): r["c"] for r in done.select("words", "counts").mapInArrow(_over(bound), "word binary, c long").collect()}
    return done.select("slice", "words", "counts", "bits"), {"slices": slices, "hot": hot, "total": total + ends, "distinct": distinct + (ends > 0), "ends": ends}


def scored(docs: DataFrame, held_out: F.Column, doc_id: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs; learns from rows not held out.

    Null texts are empty; an empty text is one end token. A null held_out counts as true. With nothing to learn from,
    every token is unknown and all probabilities are 1. Repeated rows and ids are scored each for itself. Other columns
    are not looked at. With `once` the filter holds pairs seen once too.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    trained, model = train(base.where("NOT held_out").select("text"), once=once)
    total, below = model["total"], model["total"] + 0.1 * (model["distinct"] + 1)
    shared = spark.sparkContext.broadcast(model)
    kind = base.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    asked = materialize(base.mapInArrow(_ask(shared, to_arrow_type(kind)), ASKED.format(kind.simpleString())), "asked")
    rows = asked.where("rid IS NOT NULL").select("rid", "doc_id", "held_out")
    chunks = asked.where("rid IS NULL").select("chunk", "slice", "data", "names")
    kinds = "chunk long, slice int, data binary, names binary"
    answers = trained.groupBy("slice").cogroup(chunks.where("slice >= 0").groupBy("slice")).applyInArrow(_answer(model["slices"]), kinds)
    scores = chunks.where("slice < 0").unionAll(answers).groupBy("chunk")
    scores = scores.applyInArrow(_score(shared, float(below), once), "rid long, n_tokens long, n_known long, base_score double, score double")
    return rows.join(scores, "rid").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
