"""WARC archives with a two-level capture index.

Writing: each partition writes one archive, a gzip member a record, to the shared folder. Of records with equal payloads
of at least `least_bytes` bytes, the one with the largest id is a response and the others revisit it; all smaller ones are
responses.

Index: keys are URLs with the host reversed, then the capture's id; sorted by range over the cluster, each range is written as
gzip blocks of BLOCK_LINES lines. The upper level is a sparse directory, one line a block: its first key and byte range. There
are at most MOST_PARTS ranges, so the table of their first keys, which a lookup carries to all tasks, is bounded.

Lookup: keys go to their range, are searched in its directory by bisection, the block is read by its byte range and searched by
bisection, and the record itself is read from the archive by its byte range.

Files are named by attempt, and only those of tasks that succeeded are in the index, so a lost executor costs a retry
and leaves unused files. Archives and index are read and written through Arrow's file systems.

Defined results: a null payload is empty; a null URL, and one without a host, is keyed as it stands (null: empty); a null id is smaller
than any and is written as an empty one; control characters in a URL are percent-encoded in the record's header; repeated rows are records of
their own; of repeated rows with the winning id, each is a response; an empty table gives no archives; other columns aren't looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as sh

BLOCK_LINES = 1000
MOST_PARTS = 1024
#: Lines of the index in a range, about.
PART_LINES = 200_000
#: Archives that a task keeps open.
OPEN_FILES = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The URL with its host reversed: http://a.b.com/x -> com,b,a)/x."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(:\d+)?(.*)", url or "", re.S)
    if not m:
        return quote(url or "", safe="/:?#[]@!$&'()*+,;=%")
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + quote(m[3] or "/", safe="/:?#[]@!$&'()*+,;=%")


def _key(url: str | None, capture) -> str:
    """Sorts as text: by SURT, then by id (offset, so that negative ids sort first)."""
    return f"{surt(url)} {'' if capture is None else f'{int(capture) + (1 << 63):020d}'}"


def files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def record(capture, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload in an HTTP message, or a revisit without it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:capture:{'' if capture is None else capture}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?#[]@!$&' + chr(39) + '()*+,;=%')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{'' if refers_to is None else refers_to}>"]
    else:
        body += payload
    text = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + body + b"\r\n\r\n") + z.flush()


@dataclass(frozen=True)
class Capture:
    capture: int | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parsed(raw: bytes) -> Capture:
    """Reads one record; a response's digest and length are checked against its payload."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    number = lambda s: int(s) if s else None
    capture = number(fields["WARC-Record-ID"][len("<urn:capture:") : -1])
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "revisit":
        return Capture(capture, "revisit", number(fields["WARC-Refers-To"][len("<urn:capture:") : -1]), length, digest, None)
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if len(payload) != length or sha1(payload) != digest:
        raise ValueError(f"record {capture} doesn't match its digest")
    return Capture(capture, "response", None, length, digest, payload)


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def _with_targets(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """capture, url, payload, target: the id that a record revisits (null: a response)."""
    payload = _payload(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("capture"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = [F.unhex(F.sha2("payload", 256)).alias("__key"), F.octet_length("payload").alias("__bytes")]
    groups = rows.select("capture", *key).groupBy("__key", "__bytes").agg(F.max("capture").alias("__last"), F.count(F.lit(1)).alias("__n"))
    groups = groups.where((F.col("__n") > 1) & (F.col("__bytes") >= least_bytes)).select("__key", "__bytes", "__last")
    # Both sides of the join have unique or split keys: a payload of many copies is dealt out by adaptive execution.
    found = rows.select("*", *key).join(groups, ["__key", "__bytes"], "left")
    target = F.when(F.col("__last").isNotNull() & ~F.col("capture").eqNullSafe(F.col("__last")), F.col("__last"))
    return found.select("capture", "url", "payload", target.alias("target"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives; key, file, offset, length of each record, as a written table."""
    target, folder = folder, folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files(target)
        name, at, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                for part in sh.slices(batch, 2, 8 << 20):
                    keys, offsets, lengths = [], [], []
                    if out is None and len(part):
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    for capture, url, payload, revisited in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        raw = record(capture, url, payload, sha1(payload), revisited, revisited is not None)
                        out.write(raw)
                        keys.append(_key(url, capture))
                        offsets.append(at)
                        lengths.append(len(raw))
                        at += len(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = _with_targets(pages, id_col, url_col, html_col, least_bytes)
    return sh.written(rows.mapInArrow(run, "key string, file string, offset bigint, length bigint"), "warc-records")


@dataclass(frozen=True)
class Index:
    """The parts' first keys in order (at most MOST_PARTS), and the folder that holds blocks and directories."""

    folder: str
    firsts: list[str]
    names: list[str]


def index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts the records' lines into blocks; writes blocks and directories."""
    parts = max(1, min(MOST_PARTS, records.count() // PART_LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files(folder)
        name, at, first, lines, directory, out = f"part-{uuid.uuid4().hex}", 0, None, [], [], None

        def block() -> None:
            nonlocal at, lines
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress("\n".join(lines).encode()) + z.flush()
            out.write(raw)
            directory.append(f"{lines[0].split(chr(9))[0]}\t{at}\t{len(raw)}")
            at, lines = at + len(raw), []

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, first = fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None), key
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "name"])

    found = sh.written(records.select("key", "file", "offset", "length").repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(run, "first string, name string"), "warc-parts")
    # One row a part. A part whose lines all have the key of the one before comes after it.
    got = sorted((r["first"], r["name"]) for r in found.collect())
    return Index(folder, [f for f, _ in got], [n for _, n in got])


class _Reader:
    """Looks keys up in one part after the other, with the last block and a few archives at hand."""

    def __init__(self, archive_folder: str, index: Index) -> None:
        (self.fs, self.base), (self.index_fs, self.index_base) = files(archive_folder), files(index.folder)
        self.index, self.open, self.part, self.block = index, OrderedDict(), None, None

    def _directory(self, part: int) -> None:
        if self.part != part:
            with self.index_fs.open_input_stream(f"{self.index_base}/{self.index.names[part]}.dir", compression=None) as f:
                rows = [line.split("\t") for line in f.read().decode().split("\n")]
            self.part, self.firsts, self.ranges, self.block = part, [r[0] for r in rows], [(int(a), int(n)) for _, a, n in rows], None

    def _lines(self, k: int) -> None:
        if self.block != k:
            at, n = self.ranges[k]
            with self.index_fs.open_input_file(f"{self.index_base}/{self.index.names[self.part]}.cdx.gz") as f:
                rows = [line.split("\t") for line in zlib.decompress(f.read_at(n, at), 31).decode().split("\n")]
            self.block, self.keys, self.rows = k, [r[0] for r in rows], rows

    def lines(self, key: str) -> Iterator[list[str]]:
        """The index lines of the key: from the last block that starts before it on, over as many blocks and parts as hold it."""
        part = max(0, bisect.bisect_left(self.index.firsts, key) - 1)
        while part < len(self.index.firsts) and self.index.firsts[part] <= key:
            self._directory(part)
            k = max(0, bisect.bisect_left(self.firsts, key) - 1)
            while k < len(self.firsts) and self.firsts[k] <= key:
                self._lines(k)
                i = bisect.bisect_left(self.keys, key)
                while i < len(self.keys) and self.keys[i] == key:
                    yield self.rows[i]
                    i += 1
                k += 1
            part += 1

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[file] = self.fs.open_input_file(f"{self.base}/{file}")
        self.open.move_to_end(file)
        return self.open[file].read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def lookup(keys: DataFrame, archive_folder: str, found: Index, payloads: bool = False) -> DataFrame:
    """The records of each distinct key (column key): page_id, payload_bytes, payload_digest, record_type, refers_to, and with `payloads` payload binary (null for revisits)."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(archive_folder, found)
        for batch in batches:
            for first in range(0, len(batch), 500):
                got = [parsed(reader.read(file, int(at), int(n))) for key in batch.column(0)[first : first + 500].to_pylist() for _, file, at, n in reader.lines(key)]
                columns = [[r.capture for r in got], [r.payload_bytes for r in got], [r.payload_digest for r in got], [r.record_type for r in got], [r.refers_to for r in got]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array([r.payload for r in got], pa.binary())] if payloads else [])], names=[*names, *(["payload"] if payloads else [])])
        reader.close()

    # Neighbouring keys share blocks, so they are dealt out by range.
    dealt = keys.select("key").distinct()
    parts = max(1, min(MOST_PARTS * 8, dealt.count() // 5_000))
    return dealt.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, RESULT + (", payload binary" if payloads else ""))


def url_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u")).mapInArrow(run, "key string")


def archived(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes, indexes and reads back all pages."""
    folder = sh.scratch(spark, "warc")
    records = write(pages, f"{folder}/archives", id_col, url_col, html_col, least_bytes)
    return lookup(url_keys(pages, id_col, url_col), f"{folder}/archives", index(records, f"{folder}/index"))
