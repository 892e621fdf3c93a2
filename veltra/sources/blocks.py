"""Block-gzip (BGZF) VCF files as a data source whose partitions are ranges of blocks, and as a sink.

A BGZF file is a chain of gzip members of at most 64 KB of text each, so that reading can begin at any of them. A
partition is a range of bytes of a file: its blocks are those that begin in it, its lines those that begin behind its first
line end, up to the one that begins at or across its end. Samples that aren't asked for are cut from the lines before they
leave the reader. Filters on chrom and pos are evaluated there, too; with the option ``sorted`` (positions ascend within
a chromosome, chromosomes lie together) whole ranges are left out by what their first lines say.

``spark.read.format("vcf_blocks").option("samples", "a,b").load(path)`` -> file, chrom, pos, value (the line).
``lines.write.format("vcf_blocks").option("header", text).save(path)`` writes column value, a file for each task.

Files are opened with pyarrow's file systems: local paths, hdfs://, s3:// and gs:// alike.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

# How each block begins (gzip with an extra field), the field that holds its size, bytes of text in a block.
MAGIC, FIELD, TEXT = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 0xFF00
#: Bytes of a partition, and lines of a batch.
RANGE, BATCH = 64 << 20, 5000

SCHEMA = "file string, chrom string, pos long, value string"


def block(text: bytes) -> bytes:
    """text, at most TEXT bytes, as a block; no text: the mark that ends a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = MAGIC + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + FIELD + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def block_size(head: bytes) -> int | None:
    """The size of the block that head begins with; None if it isn't one."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 6:
        if extra[:4] == FIELD:
            return struct.unpack("<H", extra[4:6])[0] + 1
        extra = extra[4 + struct.unpack("<H", extra[2:4])[0] :]
    return None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the files of a folder, but hidden ones."""
    where, name = _opened(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))


def is_blocks(path: str) -> bool:
    """Whether path, or the first file of that folder, is made of such blocks."""
    where, name = _opened(path)
    files = _files(path)
    if not files:
        return False
    with where.open_input_file(files[0][0]) as f:
        return block_size(f.read(1024)) is not None


class Blocks:
    """The blocks of a file from the first one that begins at or behind a byte."""

    def __init__(self, file: pa.NativeFile, size: int, start: int):
        self.file, self.size = file, size
        self.at = self._first(start)

    def _first(self, start: int) -> int:
        if start == 0:
            return 0
        self.file.seek(start)
        ahead = self.file.read(3 << 16)  # a block is 64 KB at most, so that one begins here
        at = ahead.find(MAGIC)
        while at >= 0:
            size = block_size(ahead[at : at + 1024])
            then = at + size if size else 0
            if size and (block_size(ahead[then : then + 1024]) or start + then == self.size):
                return start + at
            at = ahead.find(MAGIC, at + 1)
        return self.size

    def texts(self) -> Iterator[tuple[int, bytes]]:
        """(first byte, text) of one block after the other, to the end of the file."""
        while self.at < self.size:
            self.file.seek(self.at)
            data = self.file.read(1 << 16)
            size = block_size(data)
            if size is None:
                raise ValueError(f"no block at byte {self.at}")
            text = zlib.decompressobj(31).decompress(data[:size])
            here, self.at = self.at, self.at + size
            yield here, text


def lines_of(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The lines that belong to a range of bytes."""
    tail, skip = b"", start > 0
    for at, text in Blocks(file, size, start).texts():
        beyond = at >= end
        if skip:
            if beyond:
                return  # no line begins in this range
            if b"\n" not in text:
                continue
            text, skip = text.partition(b"\n")[2], False
        *whole, tail = (tail + text).split(b"\n")
        if beyond and whole:
            yield whole[0]  # the line that begins at the end or across it
            return
        yield from whole
    if tail:
        yield tail


@dataclass
class Range(InputPartition):
    file: str
    size: int
    start: int
    end: int


def _place(line: bytes) -> tuple[str, int] | None:
    parts = line.split(b"\t", 2)
    return (parts[0].decode(), int(parts[1])) if len(parts) > 1 and parts[1].isdigit() and not line.startswith(b"#") else None


class VcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", RANGE))
        self.sorted = options.get("sorted", "false").lower() == "true"
        samples = options.get("samples")
        self.samples = None if samples is None else [s for s in samples.split(",") if s]
        self.chroms: set[str] | None = None
        self.low, self.high = None, None
        self.names = header_samples(self.path) if self.samples is not None else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("chrom",), str(value)):
                    self._only({value})
                case In(("chrom",), values) if all(isinstance(v, str) for v in values):
                    self._only(set(values))
                case EqualTo(("pos",), int(value)):
                    self._between(value, value)
                case GreaterThanOrEqual(("pos",), int(value)):
                    self._between(value, None)
                case GreaterThan(("pos",), int(value)):
                    self._between(value + 1, None)
                case LessThanOrEqual(("pos",), int(value)):
                    self._between(None, value)
                case LessThan(("pos",), int(value)):
                    self._between(None, value - 1)
                case _:
                    yield f

    def _only(self, chroms: set[str]) -> None:
        self.chroms = chroms if self.chroms is None else self.chroms & chroms

    def _between(self, low: int | None, high: int | None) -> None:
        self.low = low if self.low is None else max(self.low, low) if low is not None else self.low
        self.high = high if self.high is None else min(self.high, high) if high is not None else self.high

    def _bounded(self) -> bool:
        return self.chroms is not None or self.low is not None or self.high is not None

    def partitions(self) -> list[Range]:
        found = [Range(name, size, at, min(size, at + self.range)) for name, size in _files(self.path) for at in range(0, size, self.range)]
        return self._overlapping(found) if self.sorted and self._bounded() else found

    def _overlapping(self, ranges: list[Range]) -> list[Range]:
        """Without the ranges that lie, by their first line and that of the next, outside what is asked for."""
        where, _ = _opened(self.path)
        firsts = []
        for r in ranges:
            with where.open_input_file(r.file) as f:
                firsts.append(next((p for line in lines_of(f, r.size, r.start, r.end) if (p := _place(line))), None))
        kept = []
        for r, first, then, after in zip(ranges, firsts, [*firsts[1:], None], [*ranges[1:], None], strict=True):
            one = first and then and after.file == r.file and first[0] == then[0]  # all lines are of one chromosome
            out = one and (
                (self.chroms is not None and first[0] not in self.chroms) or (self.low is not None and then[1] < self.low) or (self.high is not None and first[1] > self.high)
            )
            if not out:
                kept.append(r)
        return kept

    def _wanted(self, place: tuple[str, int] | None) -> bool:
        if not self._bounded():
            return True
        return (
            place is not None and (self.chroms is None or place[0] in self.chroms) and (self.low is None or place[1] >= self.low) and (self.high is None or place[1] <= self.high)
        )

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = _opened(self.path)
        chosen = None if self.samples is None else [i + 9 for i, n in enumerate(self.names) if n in set(self.samples)]
        rows: list[tuple] = []
        with where.open_input_file(partition.file) as f:
            for line in lines_of(f, partition.size, partition.start, partition.end):
                line = line.removesuffix(b"\r")
                place = _place(line)
                if not self._wanted(place):
                    continue
                if chosen is not None and not line.startswith(b"##") and line.count(b"\t") >= 9:
                    fields = line.split(b"\t")
                    line = b"\t".join([*fields[:9], *(fields[i] for i in chosen if i < len(fields))])
                rows.append((partition.file, *(place or (None, None)), line.decode()))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "chrom", "pos", "value"])


def header_samples(path: str) -> list[str]:
    """The samples that the #CHROM line of the first file names."""
    where, _ = _opened(path)
    for name, size in _files(path):
        with where.open_input_file(name) as f:
            for line in lines_of(f, size, 0, size):
                if line.startswith(b"#CHROM"):
                    return line.decode().rstrip("\r").split("\t")[9:]
                if not line.startswith(b"#"):
                    break
    return []


@dataclass
class Written(WriterCommitMessage):
    name: str


class VcfWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; those of the tasks that count get their names when all are there."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], options.get("header", ""), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = _opened(self.path)
        where.create_dir(folder)
        name = f"part-{uuid.uuid4().hex}.vcf.gz"
        held = (self.header.rstrip("\n") + "\n").encode() if self.header else b""
        with where.open_output_stream(f"{folder}/.{name}", compression=None) as out:
            for batch in iterator:
                held += "".join(f"{v}\n" for v in batch.column(batch.schema.get_field_index("value")).to_pylist() if v is not None).encode()
                while len(held) > TEXT:
                    out.write(block(held[:TEXT]))
                    held = held[TEXT:]
            if held:
                out.write(block(held))
            out.write(block(b""))
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, folder = _opened(self.path)
        if self.overwrite:
            for name, _ in _files(self.path):
                where.delete_file(name)
        for m in messages:
            if m is not None:
                where.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, folder = _opened(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{folder}/.{m.name}")


class VcfBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VcfReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VcfWriter(dict(self.options), overwrite)


def block_lines(spark: SparkSession, path: str, samples: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """(file, chrom, pos, value) of a block-gzip file or folder; filters on chrom and pos reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfBlocks)
    reader = spark.read.format("vcf_blocks").option("sorted", str(in_order).lower())
    return (reader if samples is None else reader.option("samples", ",".join(samples))).load(path)


def write_blocks(lines: DataFrame, path: str, header: str = "") -> None:
    lines.sparkSession.dataSource.register(VcfBlocks)
    lines.select("value").write.format("vcf_blocks").option("header", header).mode("append").save(path)
