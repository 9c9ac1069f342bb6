"""WARC archives as seekable Zstandard bundles.

Records are written into bundles of independent Zstandard frames (records are
grouped until a frame holds ``FRAME_BYTES``); a skippable frame at the end holds
the seek table (compressed and decompressed size of each frame, then the frame
count and a magic number).  The index maps every record to its bundle, frame
and offset inside the frame, so one record costs one read and one small
decompression.  Any Zstandard reader sees a bundle as one WARC file.

Payloads that occur more than once are stored once: of records with equal
payloads of ``least`` bytes or more the one with the largest id is a response,
the others are revisits that refer to it (rows that repeat it whole are
responses, too).

Tasks write bundles under names of their own in the shared folder and return
the index; only bundles named in the index that Spark committed count, so a
task that is retried or run twice leaves at most an orphan.  Bundles are
reached by URI with pyarrow's file systems.

Defined results: a null payload is empty; null url gives an empty target URI;
a null id is a record without id (it never becomes a response that others refer
to unless all ids are null, then refers_to is null); an empty table writes no
bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .frames import prepared, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


#: Hadoop's names of file systems that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file below the shared folder, by its URI or local path."""
    scheme, sign, rest = uri.partition("://")
    if not sign and not uri.startswith("file:"):
        uri = f"file://{uri}"
    elif sign:
        uri = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"bundles cannot be written to {uri}: its file system is not one of pyarrow's") from e


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame."""
    stream.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    stream.seek(size - 9 - count * width)
    raw, at, out = stream.read(count * width), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """One archive being written: frames go out as they fill."""

    def __init__(self, uri: str):
        import zstandard
        system, path = place(uri)
        self.uri, self.stream, self.frames, self.plain, self.size, self.written = uri, system.open_output_stream(path, compression=None), [], [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame)."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.plain.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.plain:
            packed = self.packer.compress(b"".join(self.plain))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.plain, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.frames))
        self.stream.close()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """Header lines hold no line ends: those and '%' are percent-coded."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in text)


def record(page_id, url: str, kind: str, payload: bytes, refers, date: str) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id if page_id is not None else uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", header_value(url)),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    body = payload
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
        body = b""
    fields.append(("Content-Length", str(len(body))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, body and where the next record begins."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin, size = end + 4, int(headers["Content-Length"])
    return headers, raw[begin:begin + size], begin + size + 4


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) rows as bundles below ``folder``; the index: page_id, bundle, frame, offset, length."""
    system, path = place(folder)  # a file system that will not do is an error before any work
    system.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("size", F.octet_length("html"))
    # a payload's digest and its largest id; only payloads that occur again travel further
    again = rows.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").select("sha", "refers")
    told = rows.join(again, "sha", "left").select("page_id", "url", "html", F.when(F.col("refers") > F.col("page_id"), F.col("refers")).alias("refers"))

    def run(batches):
        import zstandard  # noqa: F401
        bundle = None
        for batch in batches:
            out: list = [[], [], [], [], []]
            for i, url, html, refers in zip(*(batch.column(j).to_pylist() for j in range(4))):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                raw = record(i, url, "response" if refers is None else "revisit", html.encode(), refers, date)
                frame, offset = bundle.add(raw)
                for column, value in zip(out, (i, bundle.uri, frame, offset, len(raw))):
                    column.append(value)
                if bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return written(told.mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles, read frame by frame by their seek tables.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest, body (null for a revisit).
    """
    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = place(uri)
                with system.open_input_file(path) as stream:
                    for at, packed, _ in read_seek_table(stream, stream.size()):
                        stream.seek(at)
                        raw, begin = unpack.decompressobj().decompress(stream.read(packed)), 0
                        out: list = [[] for _ in range(7)]
                        while begin < len(raw):
                            h, body, begin = parse(raw, begin)
                            kind = h["WARC-Type"]
                            if kind == "response" and (f"sha1:{digest(body)}" != h["WARC-Payload-Digest"] or len(body) != int(h["X-Payload-Length"])):
                                raise ValueError(f"damaged record {h['WARC-Record-ID']} in {uri}")
                            values = (int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], kind, int(h["WARC-Refers-To"][10:-1]) if kind == "revisit" else None,
                                      int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], body if kind == "response" else None)
                            for column, value in zip(out, values):
                                column.append(value)
                        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "body"])

    # a task a bundle: the few names would otherwise end up in one partition, whatever the archive's size
    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, bundles.count())).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, body binary")


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, record) of the wanted page_ids: one frame is read and unpacked a record."""
    def run(batches):
        import zstandard
        for batch in batches:
            out = []
            for uri, frame, offset, length in zip(*(batch.column(j).to_pylist() for j in range(1, 5))):
                system, path = place(uri)
                with system.open_input_file(path) as stream:
                    at, packed, _ = read_seek_table(stream, stream.size())[frame]
                    stream.seek(at)
                    out.append(zstandard.ZstdDecompressor().decompressobj().decompress(stream.read(packed))[offset:offset + length])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "record"])

    return index.join(wanted.select("page_id").distinct(), "page_id").select("page_id", "bundle", "frame", "offset", "length").mapInArrow(run, "page_id long, record binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to a fresh folder below the shared one and read every record back."""
    spark = prepared(pages.sparkSession)
    return read_archives(write_archives(pages, shared_dir(spark, f"warc-{uuid.uuid4().hex}"), least))
