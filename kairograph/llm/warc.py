"""WARC archives as seekable Zstandard bundles.

Records are gathered into independent Zstandard frames of about FRAME_BYTES;
a bundle ends with a skippable frame that holds the seek table (compressed and
uncompressed size of each frame) in the published seekable format. The index
maps each record identifier to bundle, frame and offset within the frame, so
that one record is read by decompressing one frame.

Bundles are written by the tasks that hold the pages, through
``pyarrow.fs``, into a folder that driver and executors share. Their names
carry the task attempt: an attempt that was lost leaves a file that no index
names, and only bundles that the staged index names are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_shared_path, staged

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 128 << 20
#: Payloads from this size are stored once.
REVISIT_BYTES = 1000
#: Groups of equal payloads up to which their table (a digest and a key each) is broadcast.
BROADCAST_ROWS = 200_000

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:|/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(identifier: str) -> int | None:
    value = identifier.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if it refers to another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url or ""),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        at = stop + 4


def describe(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS from a record; a response whose payload doesn't have its digest raises ValueError."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    to = head.get("WARC-Refers-To")
    return page_of(head["WARC-Record-ID"]), size, sha1, head["WARC-Type"], page_of(to) if to else None


@dataclass
class BundleWriter:
    """Writes one bundle; ``index`` gets a tuple per record."""

    stream: object
    name: str
    frame_bytes: int = FRAME_BYTES
    frames: list[tuple[int, int]] = field(default_factory=list)
    index: list[tuple] = field(default_factory=list)
    written: int = 0

    def __post_init__(self):
        self.buffer = bytearray()
        self.codec = zstandard.ZstdCompressor(level=3)

    def add(self, page: int | None, data: bytes) -> None:
        if self.buffer and len(self.buffer) + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((page, record_id(page), self.name, len(self.frames), len(self.buffer), len(data)))
        self.buffer += data

    def flush(self) -> None:
        if self.buffer:
            packed = self.codec.compress(bytes(self.buffer))
            self.stream.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.written += len(packed)
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """Position, compressed and uncompressed size of each frame."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums")
    file.seek(size - 9 - 8 * count)
    table, at = file.read(8 * count), 0
    out = []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, frame: tuple[int, int, int]) -> bytes:
    file.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(file.read(frame[1]), max_output_size=max(1, frame[2]))


def read_record(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, as the index places it."""
    where, path = open_fs(bundle)
    with where.open_input_file(path) as f:
        data = read_frame(f, seek_table(f)[frame])
    return next(parse_records(data[offset : offset + length]))


def revisits(pages: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html`` (bytes) and ``refers_to``: the largest page_id with an equal payload of at least ``least`` bytes, else null.

    Equal means equal SHA-256. Rows that share the largest page_id are all
    responses. Null page_ids never are the target; where all of a group are
    null, all its records are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    large = F.octet_length("html") >= least
    sha = F.when(large, F.unhex(F.sha2("html", 256)))
    groups = (
        rows.where(large).select("page_id", sha.alias("sha")).groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("target")).where("n > 1 and target is not null")
    )
    groups = staged(groups.select("sha", "target"), "warc_groups")
    small = groups.count() <= BROADCAST_ROWS
    joined = rows.withColumn("sha", sha).join(F.broadcast(groups) if small else groups.hint("shuffle_hash"), "sha", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write rows of ``revisits`` as bundles into ``folder``; returns the staged index."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, path = open_fs(folder)
        where.create_dir(path, recursive=True)
        task = TaskContext.get()
        out, made = None, 0
        for batch in batches:
            for page, url, payload, to in zip(batch["page_id"].tolist(), batch["url"].tolist(), batch["html"].tolist(), batch["refers_to"].tolist(), strict=True):
                if out is None:
                    name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{made}.warc.zst"
                    out = BundleWriter(where.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}", frame_bytes)
                    made += 1
                page = None if page is None else int(page)
                out.add(page, record(page, url, payload, None if to is None else int(to)))
                if out.written >= bundle_bytes:
                    out.close()
                    yield _index(out)
                    out = None
        if out:
            out.close()
            yield _index(out)

    keys = {k: F.col(k).cast("string") for k in ("page_id", "refers_to")}  # pandas would turn longs with nulls into doubles
    return staged(pages.withColumns(keys).mapInPandas(write, INDEX), "warc_index")


def _index(out: BundleWriter) -> pd.DataFrame:
    frame = pd.DataFrame(out.index, columns=["page_id", "record_id", "bundle", "frame", "offset", "length"])
    frame["page_id"] = frame["page_id"].astype("Int64")
    return frame


def read_archives(index: DataFrame) -> DataFrame:
    """RECORDS of all bundles that the index names, a frame at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle in batch["bundle"]:
                where, path = open_fs(bundle)
                with where.open_input_file(path) as f:
                    for frame in seek_table(f):
                        rows = pd.DataFrame([describe(*x) for x in parse_records(read_frame(f, frame))], columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                        yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    bundles = index.select("bundle").distinct()
    # a task per bundle: by their few bytes, adaptive execution would put the names of very many bundles into one
    return bundles.repartition(max(1, bundles.count())).mapInPandas(read, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write every page as a record, then read all records back.

    Null html is an empty payload. No rows: no bundles and no records.
    """
    folder = new_shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(revisits(pages), folder))
