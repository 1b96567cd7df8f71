"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (a marker for each space, one before the first word) and cut into marked words, as no piece runs from
other characters into a marker. The distinct words that a task has not met yet are sorted, so that they form a trie in
depth-first order, and forward scores are kept by prefix length: a word starts from those of the prefix that it shares
with the word before it. Two kinds of lattice are scored:

- unigram models: the forward score of a prefix is the best sum of piece scores.
- BPE models, whose scores rank merges and do not add up: a piece may follow another only if merging their joined text
  gives back these two. A prefix has exactly one path of admissible neighbours, and it is the one that merging the whole
  prefix gives, so its forward score is that path's last piece. This gives the library's ids exactly. Words that begin
  with several markers are merged directly, as the pieces of markers only tie in score.

Characters without a piece become byte pieces (or the unknown piece).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED = 300_000
CHUNK = 4_000_000


class Pieces:
    """Pieces and scores of a model; bpe says how they are to be read."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True) -> None:
        """pieces: (text, score, type) by id; types as in the model format: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
        self.bpe, self.prefix = bpe, prefix
        self.id = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (1, 4, 5)}
        self.score = {p: s for p, s, kind in pieces if kind in (1, 4, 5)}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((k for k, x in enumerate(pieces) if x[2] == 2), 0)
        self.longest = max(map(len, self.id), default=1)
        self.ends = {p[k:] for p in self.id for k in range(len(p))}
        self.worst = min(self.score.values(), default=0.0) - 10
        self.table = [b"" if kind == 3 else bytes([int(p[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    @classmethod
    def read(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that rewrite their input are not supported")
        pieces = [(p.piece, p.score, p.type) for p in m.pieces]
        if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (1, 4, 5)):
            raise ValueError("models with pieces over several words are not supported")
        return cls(pieces, m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix)

    def merged(self, text: str) -> list[str]:
        """Merging by best score, leftmost first, until nothing merges."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := self.score.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, both))

        score = self.score.get
        for k in range(len(part) - 1):
            if (s := score(both := text[k : k + 2])) is not None:
                heap.append((-s, k, k + 1, both))
        if not heap:
            return list(text)
        heapq.heapify(heap)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        return [p for p in part if p is not None]

    def stands(self, piece: str) -> bool:
        """Merging a piece's characters gives the piece."""
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def follows(self, a: str, b: str) -> bool:
        """Merging the two pieces' joined text gives back the two."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def segmented(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each of sorted distinct words."""
        last, starts, scores = "", [0], [0.0]
        for w in words:
            if self.bpe and w.startswith(MARK + MARK):
                yield self.merged(w)
                continue
            shared = 0
            for a, b in zip(last, w, strict=False):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], scores[shared + 1 :]
            (self._merge if self.bpe else self._add)(w, shared, starts, scores)
            last, out, at = w, [], len(w)
            while at:
                out.append(w[starts[at] : at])
                at = starts[at]
            yield out[::-1]

    def _merge(self, w: str, shared: int, starts: list[int], scores: list[float]) -> None:
        known, stands, pairs, ends = self.id, self.stands, self.pairs, self.ends
        for end in range(shared + 1, len(w) + 1):
            begin = end - 1
            p = w[begin]
            while True:
                if (p in known or begin == end - 1) and stands(p):
                    if begin == 0:
                        break
                    a = w[starts[begin] : begin]
                    ok = pairs.get((a, p))
                    if self.follows(a, p) if ok is None else ok:
                        break
                begin -= 1
                p = w[begin:end]
                if begin < 0 or p not in ends:
                    raise AssertionError("a prefix without a path")
            starts.append(begin)
            scores.append(0.0)

    def _add(self, w: str, shared: int, starts: list[int], scores: list[float]) -> None:
        for end in range(shared + 1, len(w) + 1):
            best, at = scores[end - 1] + self.score.get(w[end - 1], self.worst), end - 1
            for begin in range(max(0, end - self.longest), end - 1):
                s = self.score.get(w[begin:end])
                if s is not None and scores[begin] + s > best:
                    best, at = scores[begin] + s, begin
            starts.append(at)
            scores.append(best)

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (k := self.id.get(p)) is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def units(self, text: str) -> list[str]:
        """Marked words of a text; none of an empty one."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text or not self.prefix:
            return UNITS.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        return [MARK + x for x in text.split(" ")]


class Encoder:
    """Encodes texts, with the ids of words met before at hand: in two generations, so that a full one drops the words not met lately."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit bytes."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        units = [self.pieces.units(t) for t in texts]
        new = set().union(*units).difference(known)
        for u in new & older.keys():
            known[u] = older[u]
        words = sorted(new.difference(older))
        for w, p in zip(words, self.pieces.segmented(words), strict=True):
            known[w] = pack(f"<{len(k := self.pieces.ids(p))}I", *k)
        return [b"".join([known[u] for u in us]) for us in units]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a model, one for all tasks of a worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(Pieces.read(path))
    return _encoders[path]


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """Markers are spaces again, that before the first word goes; bytes that are no UTF-8 become U+FFFD."""
    table = pieces.table
    text = b"".join([table[k] for k in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if pieces.prefix and text[:1] == " " else text


def _path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def encoded(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", to: str = "ids") -> DataFrame:
    """docs without `text`, with a column array<int> `to` of its ids. model: a name among the public tokenizers, or a path on every worker.

    Null texts count as empty and have no ids. Other columns stay as they are.
    """
    rest = [c for c in docs.columns if c not in (text, to)]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(_path(model))
        for batch in batches:
            texts, out, at = batch.column(0), [], 0
            while at < batch.num_rows:
                part, size = [], 0
                while at < batch.num_rows and size < CHUNK:
                    part.append(texts[at].as_py() or "")
                    size, at = size + len(part[-1]), at + 1
                out += encoder.of(part)
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in out], dtype=np.int64))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=[*rest, to])

    return docs.select(text, *rest).mapInArrow(run, f"{kinds}{', ' * bool(rest)}`{to}` array<int>")


def decoded(docs: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model", to: str = "text") -> DataFrame:
    """docs without `ids`, with their text `to`, their number n_ids and ids_crc32 (little-endian 32-bit). Null ids are none; ids that the model lacks raise IndexError."""
    rest = [c for c in docs.columns if c not in (ids, to, "n_ids", "ids_crc32")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder_of(_path(model)).pieces
        for batch in batches:
            texts, n, crc = [], [], []
            for x in batch.column(0):
                own = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                texts.append(decode(pieces, own))
                n.append(len(own))
                crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[*rest, to, "n_ids", "ids_crc32"])

    return docs.select(ids, *rest).mapInArrow(run, f"{kinds}{', ' * bool(rest)}`{to}` string, n_ids long, ids_crc32 long")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, same per row of docs: encoded, decoded again, and whether that gives the text (null: empty).

    Texts holding the marker character itself do not come back: it decodes to a space.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    back = decoded(encoded(own, "text", model), "ids", model)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("digest")).alias("same"))
