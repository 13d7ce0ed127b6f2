"""Vendor archives by member: a Python data source whose partitions are byte ranges of archives.

Planning reads the central directory of each archive (its end, not the archive); a member then
is a range of compressed bytes that a task seeks to and inflates as a stream. Members share a
partition until it has PARTITION bytes, a large one has its own. So one archive is read by as
many tasks as it has bytes for, and a task holds a buffer and a batch of rows.

Paths are of any file system that Arrow opens (local, hdfs, s3, gs and so on).
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

from . import files

#: Compressed bytes of the members that share a partition; bytes read at once.
PARTITION, BUFFER = 32 << 20, 1 << 20
STORED, DEFLATED, NO_ARCHIVE = 0, 8, -1


@dataclass
class Member:
    """A file, or (start >= 0) a member of an archive: where its local header is and what the directory says of it."""

    path: str
    name: str
    size: int
    start: int = -1
    method: int = STORED
    crc: int = 0
    encrypted: bool = False


class Members(InputPartition):
    def __init__(self, each: list[Member]) -> None:
        self.each = each


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path (a plain one is local) and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> Iterator[tuple[str, int]]:
    """Archives and tables under a path (a file, a folder or a pattern), with their sizes."""
    pattern = any(c in path for c in "*?[")
    fs, at = opened(path[: re.search(r"[*?[]", path).start()].rpartition("/")[0] if pattern else path)
    before = path[: path.index(at)] if at in path else ""
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    for x in sorted(found, key=lambda x: x.path):
        name = before + x.path
        if x.type == pafs.FileType.File and x.path.lower().endswith((".zip", *files.TABULAR)) and (not pattern or fnmatch(name, path)):
            yield name, x.size


def members(path: str, size: int) -> Iterator[Member]:
    """The tables in an archive, from its central directory; the file itself if it is no archive."""
    if not path.lower().endswith(".zip"):
        yield Member(path, path.rsplit("/", 1)[-1], size)
        return
    fs, at = opened(path)
    try:
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            for i in z.infolist():
                if not i.is_dir() and i.filename.lower().endswith(files.TABULAR):
                    yield Member(path, i.filename, i.compress_size, i.header_offset, i.compress_type, i.CRC, bool(i.flag_bits & 1))
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter: shorter than an empty archive
        yield Member(path, path.rsplit("/", 1)[-1], 0, method=NO_ARCHIVE)


def dealt(each: Iterator[Member], most: int = PARTITION) -> Iterator[list[Member]]:
    some: list[Member] = []
    for m in each:
        if some and sum(x.size for x in some) + m.size > most:
            yield some
            some = []
        some.append(m)
    if some:
        yield some


class Inflated(io.RawIOBase):
    """The bytes of an archive's member, from its range; length and checksum are held against the directory at the end."""

    def __init__(self, f, m: Member) -> None:
        self.f, self.m, self.left, self.crc, self.ready = f, m, m.size, 0, b""
        f.seek(m.start)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no local header")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(m.start + 30 + name + extra)
        self.engine = zlib.decompressobj(-zlib.MAX_WBITS) if m.method == DEFLATED else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready:
            raw = self.f.read(min(BUFFER, self.left)) if self.left else b""
            self.left -= len(raw)
            if raw:
                self.ready = self.engine.decompress(raw) if self.engine else raw
            elif self.left:
                raise zipfile.BadZipFile("cut short")
            else:
                self.ready = self.engine.flush() if self.engine else b""
                self.engine = None
                if not self.ready:
                    if self.crc != self.m.crc:
                        raise zipfile.BadZipFile("bad checksum")
                    return 0
            self.crc = zlib.crc32(self.ready, self.crc)
        n = min(len(into), len(self.ready))
        into[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def lines(m: Member) -> Iterator[tuple]:
    """Rows of a member; what is wrong with it is its last row."""
    try:
        if m.method == NO_ARCHIVE:
            raise zipfile.BadZipFile("not an archive")
        if m.encrypted or m.method not in (STORED, DEFLATED):
            raise zipfile.BadZipFile("encrypted" if m.encrypted else f"compressed by method {m.method}")
        fs, at = opened(m.path)
        with fs.open_input_file(at) as f:
            raw = io.BufferedReader(Inflated(f, m) if m.start >= 0 else f, BUFFER)
            yield from files.vendor_lines(m.name, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""))
    except (zipfile.BadZipFile, zlib.error) as e:
        yield (m.name, 0, f"damaged: {e}", *[None] * 8)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.most = json.loads(options["paths"]), int(options.get("partition_bytes", PARTITION))

    def partitions(self) -> list[Members]:
        found = (m for p in self.paths for path, size in listed(p) for m in members(path, size))
        return [Members(x) for x in dealt(found, self.most)] or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        yield from files.in_batches(row for m in partition.each for row in lines(m))


class VendorFiles(DataSource):
    """spark.read.format("vendor_files").option("paths", a JSON list)[.option("partition_bytes", n)]"""

    @classmethod
    def name(cls) -> str:
        return "vendor_files"

    def schema(self) -> str:
        return files.VENDOR

    def reader(self, schema) -> Reader:
        return Reader(self.options)
