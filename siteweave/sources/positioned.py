"""VCF, SAM and BED files as a data source that takes conditions on chromosome and position.

spark.read.format("positioned").option("kind", "vcf").load(path), after register(spark). A file is planned as byte
ranges. With option sorted=true - each chromosome's lines together, by position - the first line of each range is looked
at when the scan is planned; a range that begins and ends in one chromosome holds no other, and only positions between
those two lines, so ranges outside the conditions are never read. Lines are tested before they are made into rows.

Files are opened through pyarrow's file systems, by driver and executors; what only Spark reads goes through
sources.text. Compressed files are one range each. Names of chromosomes stay as they are.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


class Kind(NamedTuple):
    """Schema, the fields of chromosome and position, what is added to the latter, and the first character of header lines."""

    schema: str
    chrom: int
    position: int
    shift: int
    head: bytes
    named: str


KINDS = {
    "vcf": Kind("chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, calls array<string>", 0, 1, 0, b"#", "pos"),
    "sam": Kind("read_id string, flag int, chrom string, pos int, cigar string, seq string", 2, 3, 0, b"@", "pos"),
    "bed": Kind("chrom string, start int, end int, name string, score string, strand string", 0, 1, 1, b"#", "start"),
}
SPLIT = 32 << 20


def _row(kind: str, f: list[str]) -> tuple:
    if kind == "vcf":
        f += [None] * (9 - len(f))
        return (f[0], int(f[1]), *f[2:9], f[9:])
    if kind == "sam":
        return f[0], int(f[1]), f[2], int(f[3]), f[5], f[9]
    f += [None] * (6 - len(f))
    return f[0], int(f[1]) + 1, int(f[2]), f[3], f[4], f[5]


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None) -> None:
        self.path, self.begin, self.end = path, begin, end


class Asked(NamedTuple):
    """Chromosomes (None: all) and the least and greatest position."""

    chroms: frozenset[str] | None = None
    low: int | None = None
    high: int | None = None

    def holds(self, chrom: str, pos: int) -> bool:
        return (self.chroms is None or chrom in self.chroms) and (self.low is None or pos >= self.low) and (self.high is None or pos <= self.high)

    def may_hold(self, first: tuple[str, int] | None, after: tuple[str, int] | None) -> bool:
        """Whether a range may hold a line asked for, from its first line and the one after its last."""
        if first is None or after is None or first[0] != after[0]:
            return True
        return (self.chroms is None or first[0] in self.chroms) and (self.high is None or first[1] <= self.high) and (self.low is None or after[1] >= self.low)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PositionedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind, self.path = options.get("kind", "vcf"), options["path"]
        self.sorted, self.split = options.get("sorted", "false") == "true", int(options.get("split", SPLIT))
        self.asked = Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        of = KINDS[self.kind]
        for f in filters:
            a, own = self.asked, f.attribute == ("chrom",) if hasattr(f, "attribute") else False
            if own and isinstance(f, (EqualTo, In)):
                some = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.asked = a._replace(chroms=some if a.chroms is None else a.chroms & some)
            elif getattr(f, "attribute", None) == (of.named,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low, high = a.low, a.high
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    x = f.value + isinstance(f, GreaterThan)
                    low = x if low is None else max(low, x)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    x = f.value - isinstance(f, LessThan)
                    high = x if high is None else min(high, x)
                self.asked = a._replace(low=low, high=high)
            else:
                yield f

    def _head(self, line: bytes) -> tuple[str, int]:
        of = KINDS[self.kind]
        f = line.rstrip(b"\r\n").split(b"\t", of.position + 1)
        return f[of.chrom].decode(), int(f[of.position]) + of.shift

    def _first(self, stream, begin: int) -> tuple[str, int] | None:
        """Of the first line that begins at `begin` or later."""
        for _, line in self._lines(stream, begin, None):
            return self._head(line)
        return None

    def _lines(self, stream, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the data lines that begin in begin..end."""
        at = begin
        if begin:
            stream.seek(begin - 1)
            at = begin - 1 + len(stream.readline())  # the line that holds the byte before belongs to the range before
        head = KINDS[self.kind].head
        while end is None or at < end:
            line = stream.readline()
            if not line:
                return
            if line.strip() and not line.startswith((head, b"track", b"browser")):
                yield at, line
            at += len(line)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _place(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        out: list[InputPartition] = []
        for x in sorted(files, key=lambda x: x.path):
            if x.path.endswith((".gz", ".bz2")):
                out.append(Range(x.path, 0, None))
                continue
            edges = [*range(0, x.size, self.split), x.size]
            firsts: list = [None] * len(edges)
            if self.sorted and self.asked != Asked():
                for k, edge in enumerate(edges[:-1]):
                    with system.open_input_file(x.path) as stream:
                        firsts[k] = self._first(io.BufferedReader(stream, 1 << 16), edge)
            out += [Range(x.path, a, b) for a, b, p, q in zip(edges, edges[1:], firsts, firsts[1:], strict=False) if self.asked.may_hold(p, q)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Range):
            return
        system, _ = _place(self.path)
        stream = system.open_input_file(partition.path)
        unpack = {".gz": gzip.open, "bz2": bz2.open}.get(partition.path[-3:])
        with unpack(stream) if unpack else io.BufferedReader(stream, 1 << 20) as lines:
            for _, line in self._lines(lines, partition.begin, partition.end):
                if self.asked.holds(*self._head(line)):
                    yield _row(self.kind, line.decode("utf-8", "replace").rstrip("\r\n").split("\t"))


class Positioned(DataSource):
    @classmethod
    def name(cls) -> str:
        return "positioned"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "vcf")].schema

    def reader(self, schema) -> PositionedReader:
        return PositionedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Positioned)
