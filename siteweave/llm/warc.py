"""WARC files: one gzip member per record, written by the executors into a folder that they share, and a sequential reader.

The reader holds one buffer: it inflates a member piece by piece, takes the header up to its blank line, frames the
block by Content-Length, and hashes block and payload as they pass. Wrong digests, lengths or frames raise ValueError.
It takes records of all types (what is no HTTP message is all payload), digests in hex or base32 by MD5 or the SHA family,
and records without digests. Digests of payloads that were sent in chunks or cut are not compared.
Archives are opened through pyarrow's file systems, so any folder that these reach will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm._common import fresh_path, materialize

ROLL = 8 << 20
PIECE = 1 << 16
HEADER = 1 << 20  # bytes of an HTTP header at most
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit's block holds the HTTP header of the full payload only. Record ids follow from kind, page and digest, so that a revisit can name its response; rows that repeat all three share one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    own = lambda k, p: f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{k}:page:{p}:{digest}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own(kind, page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:x-unknown', safe=';/?:@&=+$,#%[]!*()~')}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: {own('response', refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class Reader:
    """Records of one archive in order, as dicts: header (names in lower case), payload_bytes, payload_digest, offset of the member; and payload if `keep`."""

    def __init__(self, stream, keep: bool = False) -> None:
        self.stream, self.keep = stream, keep
        self.raw, self.taken, self.done = b"", 0, False

    def _member(self) -> Iterator[bytes]:
        """What one gzip member inflates to, in pieces; after it, self.raw begins with the next member."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise ValueError("the archive ends within a gzip member")
            fed, self.raw = self.raw, b""
            left = fed
            while left and not inflate.eof:
                out = inflate.decompress(left, PIECE)
                left = inflate.unconsumed_tail
                if out:
                    yield out
            self.raw = inflate.unused_data if inflate.eof else b""
            self.taken += len(fed) - len(self.raw)

    def __iter__(self) -> Iterator[dict]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
            if not self.raw:
                return
            yield self._record()

    def _record(self) -> dict:
        offset, pieces, buffer = self.taken, self._member(), b""

        def until(mark: bytes) -> bytes:
            nonlocal buffer
            while (at := buffer.find(mark)) < 0:
                more = next(pieces, None)
                if more is None or len(buffer) > 1 << 20:
                    raise ValueError(f"record at {offset}: no end of header")
                buffer += more
            out, buffer = buffer[:at], buffer[at + len(mark) :]
            return out

        first, *lines = until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"record at {offset}: {first[:40]!r} is no WARC version")
        head = _fields(lines)
        left = int(head["content-length"])
        stated, of_block = _digest(head.get("warc-payload-digest")), _digest(head.get("warc-block-digest"))
        block, sums = of_block and hashlib.new(of_block[0]), {"sha256": hashlib.sha256()}
        if stated and stated[0] != "sha256":
            sums[stated[0]] = hashlib.new(stated[0])
        size, kept, http = 0, [], b""
        inside = not head.get("content-type", "").startswith("application/http")  # what is no HTTP message is all payload
        while left:
            if not buffer:
                buffer = next(pieces, None)
                if buffer is None:
                    raise ValueError(f"record at {offset}: the block ends early")
            own, buffer = buffer[:left], buffer[left:]
            left -= len(own)
            if block:
                block.update(own)
            if not inside:
                http += own
                if (at := http.find(b"\r\n\r\n")) < 0:
                    if len(http) > HEADER:
                        raise ValueError(f"record at {offset}: no end of the HTTP header")
                    continue
                inside, own, http = True, http[at + 4 :], http[:at]
            for x in sums.values():
                x.update(own)
            size += len(own)
            if self.keep:
                kept.append(own)
        tail = buffer
        for more in pieces:  # to the end of the member, whose own checksum is tested there
            tail += more
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise ValueError(f"record at {offset}: what follows the block is no end of record")
        if block and block.digest() != of_block[1]:
            raise ValueError(f"record at {offset}: the block digest is wrong")
        fields = _fields(http.decode("latin-1").split("\r\n")[1:])
        full, kind = int(fields.get("content-length", size)) if fields.get("content-length", "0").isdigit() else size, head.get("warc-type")
        altered = "transfer-encoding" in fields or "warc-truncated" in head  # digest and length may be those of another form
        if kind != "revisit" and not altered and (stated and sums[stated[0]].digest() != stated[1] or size != full and fields):
            raise ValueError(f"record at {offset}: the payload's digest or length is wrong")
        digest = stated[1].hex() if kind == "revisit" and stated else sums["sha256"].hexdigest()
        return {"header": head, "payload_bytes": full if kind == "revisit" else size, "payload_digest": digest, "offset": offset} | ({"payload": b"".join(kept)} if self.keep else {})


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for x in lines:
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
        elif ":" in x:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _digest(text: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of a labelled digest in hex or base32; None for none, or for an algorithm that is not known."""
    name, _, value = (text or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    if len(value) == 2 * size:
        return name, bytes.fromhex(value)
    return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def _write(folder: str) -> Callable:
    names = ["path", "records", "bytes"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = opened(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        held, size, count, number, done = [], 0, 0, 0, []

        def flush() -> None:
            """A whole archive, renamed once it is written. Its name holds the attempt: a task run twice never writes over its other run, and only one run's list counts."""
            nonlocal held, size, count, number
            if held:
                name = f"part-{part:06d}-{number:05d}-{attempt}.warc.gz"
                with place.open_output_stream(f"{root}/.{name}", compression=None) as out:
                    for x in held:
                        out.write(x)
                place.move(f"{root}/.{name}", f"{root}/{name}")
                done.append((f"{folder}/{name}", count, size))
                held, size, count, number = [], 0, 0, number + 1

        for batch in batches:
            pages, urls, payloads, digests, sizes, refers = batch.columns
            for k in range(batch.num_rows):
                to = refers[k].as_py()
                payload = b"" if to is not None else (payloads[k].as_py() or "").encode("utf-8", "surrogatepass")
                held.append(record("response" if to is None else "revisit", pages[k].as_py(), urls[k].as_py(), payload, digests[k].as_py(), sizes[k].as_py(), to))
                size, count = size + len(held[-1]), count + 1
                if size >= ROLL:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=names)

    return write


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """Write a record per row into archives in `folder`; their list (path, records, bytes), which alone says what counts.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others
    revisits; smaller ones are all responses, and so are rows with a null page_id. Null payloads are empty. Which rows
    are revisits is found from ids and digests alone; payloads of revisits are not moved.
    """
    place, root = opened(folder)
    place.create_dir(root, recursive=True)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    keys = materialize(base.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = keys.join(first.repartition(n), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")
    revisits = materialize(revisits.dropDuplicates(["page_id", "digest"]), "revisits")
    rows = base.join(revisits, ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")
    return materialize(rows.mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


def read_archives(paths: DataFrame, path: str = "path") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset of each record of the archives listed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for archive in b.column(0).to_pylist():
                place, at = opened(archive)
                with place.open_input_stream(at, compression=None) as stream:
                    for r in Reader(stream):
                        h = r["header"]
                        number = lambda name: int(h[name]) if name in h else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), r["payload_bytes"], r["payload_digest"], h["warc-type"], number("x-refers-to-page-id"), h.get("warc-target-uri"), archive, r["offset"]))
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
        yield batch(rows)

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select(path).repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read them back. An empty table gives no archives and no rows."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, payload))
