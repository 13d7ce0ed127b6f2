"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages are grouped by the SHA-256 of their payload for the choice of response and
revisit records; each task then writes archives of bounded size into the shared folder. An
archive's dictionary is trained on its first records and stored in a skippable frame (magic
0x184D2A5D) before them. A file counts only if it stands in the table that the successful
task attempts return, so retried and lost tasks leave no records behind.

Reading: archives of that table are dealt one to a task (up to ``READ_TASKS`` tasks). A task
streams an archive: it loads the dictionary, follows the block headers to the end of the next
frame, decodes that one record, and checks the version line, required headers, block length,
record end, payload length and payload digest. It holds one record and a batch of results.

Defined results: a null html is an empty payload; an empty table gives no archives and an
empty result; repeated rows are records of their own, responses if they carry the smallest
page_id of their payload; a null page_id ranks after every id; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, written

#: Fixed values of the file formats.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: What a dictionary is trained on, at most: records and bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 256, 1 << 20, 16 << 10
#: Tasks that read archives, and records whose results make a batch.
READ_TASKS, BATCH = 50_000, 2048
#: Payloads of fewer bytes are never deduplicated.
MIN_REVISIT_BYTES = 0
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")
DATE = "2024-01-01T00:00:00Z"

ARCHIVES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP headers (and so the payload's length) without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not m:
        raise WarcError(f"record id {urn!r}")
    return int(m[1]) if m[1] else None


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}


def parse(raw: bytes) -> tuple:
    """The validated record as a RECORDS tuple."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    h = _headers(lines)
    if not found or first != b"WARC/1.1" or any(k not in h for k in REQUIRED):
        raise WarcError("record header")
    n = int(h["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("record length")
    http, found, payload = rest[:n].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    size = int(_headers(lines)["Content-Length"])
    sha1 = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if not found or not status.startswith(b"HTTP/1.1 "):
        raise WarcError("response header")
    if h["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha1):
        raise WarcError("payload")
    if h["WARC-Type"] == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    refers = _page(h["WARC-Refers-To"]) if h["WARC-Type"] == "revisit" else None
    return _page(h["WARC-Record-ID"]), size, sha1, h["WARC-Type"], refers, h.get("WARC-Target-URI", "")


def _exact(stream: io.RawIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise WarcError("cut archive")
    return data


def next_frame(stream: io.RawIOBase) -> bytes:
    """The Zstandard frame that begins here, found by its block headers; nothing at the end of the stream."""
    import zstandard

    head = stream.read(5)
    if not head:
        return b""
    if len(head) < 5 or int.from_bytes(head[:4], "little") != FRAME_MAGIC:
        raise WarcError("frame magic")
    parts = [head + _exact(stream, zstandard.frame_header_size(head) - 5)]
    last = False
    while not last:
        mark = _exact(stream, 3)
        block = int.from_bytes(mark, "little")
        last = bool(block & 1)
        parts += [mark, _exact(stream, 1 if block >> 1 & 3 == 1 else block >> 3)]
    if zstandard.get_frame_parameters(parts[0]).has_checksum:
        parts.append(_exact(stream, 4))
    return b"".join(parts)


def read_archive(stream: io.RawIOBase) -> Iterator[tuple]:
    """RECORDS tuples of one archive, a frame at a time."""
    import zstandard

    head = stream.read(4)
    unpack = zstandard.ZstdDecompressor()
    if len(head) == 4 and struct.unpack("<I", head)[0] == DICT_MAGIC:
        words = _exact(stream, struct.unpack("<I", _exact(stream, 4))[0])
        unpack, head = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_FULLDICT)), b""
    rest = _After(head, stream)
    while frame := next_frame(rest):
        yield parse(unpack.decompress(frame))


class _After:
    """Bytes already read, and then the stream."""

    def __init__(self, head: bytes, stream: io.RawIOBase) -> None:
        self.head, self.stream = head, stream

    def read(self, n: int) -> bytes:
        out, self.head = self.head[:n], self.head[n:]
        return out + self.stream.read(n - len(out)) if len(out) < n else out


def _dictionary(sample: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, sample)
    except zstandard.ZstdError:  # too little to train on: the archive goes without
        return None


def write_archives(folder: str, records: Iterator[bytes]) -> Iterator[tuple[str, int, int]]:
    """Write records into archives under folder (any file system pyarrow knows); ARCHIVES tuples."""
    import zstandard
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    more = True
    while more:
        sample, size = [], 0
        while (x := next(records, None)) is not None:
            sample.append(x)
            size += len(x)
            if len(sample) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                break
        if not sample:
            return
        words = _dictionary(sample)
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": words} if words else {}))
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        n = held = 0
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            if words:
                raw = words.as_bytes()
                held += out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw) or 0
            for x in sample:
                held += out.write(pack.compress(x)) or 0
                n += 1
            more = False
            for x in records:
                held += out.write(pack.compress(x)) or 0
                n += 1
                if held >= ARCHIVE_BYTES:
                    more = True
                    break
        yield f"{folder}/{name}", n, held


def with_targets(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, revisit, refers_to: equal payloads refer to the one with the smallest id."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit("")
    rows = pages.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    both = rows.join(groups.where("n > 1"), "sha", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every page as a record; the table of finished archives (path, n_records, n_bytes)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page_id, url, html, again, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                    yield record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers.as_py(), again.as_py())

        for path, n, size in write_archives(folder, records()):
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    rows = with_targets(pages, min_bytes).select("page_id", "url", "html", "revisit", "refers_to")
    return written(rows.mapInArrow(run, ARCHIVES), "warc-archives")


def read_pages(archives: DataFrame) -> DataFrame:
    """RECORDS of all archives in the table (path, n_records, ...), checked against its record counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                rows, seen = [], 0
                with system.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
                    for row in read_archive(f):
                        rows.append(row)
                        seen += 1
                        if len(rows) == BATCH:
                            yield batch(rows)
                            rows = []
                if seen != n:
                    raise WarcError(f"{path}: {seen} records, {n} written")
                if rows:
                    yield batch(rows)

    # paths are tiny, so the number of tasks is given: by size alone all archives would go to one
    tasks = max(1, min(READ_TASKS, archives.count()))
    return archives.select("path", "n_records").repartitionByRange(tasks, "path").mapInArrow(run, RECORDS)


def op8_warc(spark, sf_dir) -> DataFrame:
    return read_pages(write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
digits AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', hex[i]) - 1) AS v FROM d),
words AS (
  SELECT *, list_transform(range(8), lambda k: v[5*k+1] * 65536 + v[5*k+2] * 4096 + v[5*k+3] * 256 + v[5*k+4] * 16 + v[5*k+5]) AS w FROM digits)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((w[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM words
"""
