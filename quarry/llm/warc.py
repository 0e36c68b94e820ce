"""WARC archives in seekable Zstandard bundles.

A bundle groups records into independent Zstandard frames and ends with a seek table in a
skippable frame (the published seekable format: magic 0x184D2A5E, an entry of compressed and
decompressed size for each frame, and the footer with the number of frames, a descriptor byte
and magic 0x8F92EAB1). An index maps each record's identifier to its frame and to its offset in
the decompressed frame, so one record costs one frame's read.

Each task writes bundles below a folder that all machines reach, under names no other attempt
uses; only the bundles that the manifest lists count, so a lost or repeated task leaves at most
files that nothing refers to.

Cases: a null page counts as empty; a null url gives an empty target; rows of one page_id are
separate records of the same identifier, and those with the smallest id of their payload are all
responses; rows with a null id are written and read back like others, always as responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column_or_null, cut_lineage, map_columns, scratch, table

#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEVEL = 3
SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
#: A WARC-Date is required; the pages have no time, so all records carry this one.
DATE = "2024-01-01T00:00:00Z"
#: Equal payloads of so many bytes and more are stored once.
LEAST_BYTES = 0


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, number: str) -> bytes:
    """One WARC/1.1 record. A revisit has headers alone; Refers-To names the response's page."""
    target = re.sub(r"[\r\n]", "", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:quarry:page:{number}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:quarry:page:{refers_to}>"]
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at offset, and the offset of the next one."""
    head_end = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:head_end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {offset}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {offset} does not end where it should")
    return headers, data[start:end], end + 4


class BundleWriter:
    """Groups records into frames; finish() gives the bundle's bytes."""

    def __init__(self):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out, self.frames, self.index = io.BytesIO(), [], []
        self.frame: list[bytes] = []
        self.size = 0

    def add(self, number: str, data: bytes) -> None:
        self.index.append((number, len(self.frames), self.size))
        self.frame.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC))
        return self.out.getvalue()


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        file.seek(size - 9 - n * width)
        table, at, self.frames = file.read(n * width), 0, []
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def open_path(path: str):
    """The file system of a URI and the path in it; no local folder is assumed."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages (page_id, html, sha1) that revisit another page.

    A payload's copies are counted with partial sums, and they look their response up in a join
    whose large partitions adaptive execution splits, so a payload that a third of all pages has
    is not one task's work."""
    rows = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= LEAST_BYTES)).select("page_id", "sha1").distinct()
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, "sha1").where("page_id <> refers_to")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages and gives the manifest: path of each bundle, records
    in it, bytes, and its index (record, frame, offset). The manifest is in the shared folder."""
    base = pages.select(
        column_or_null(pages, id_col, "long").alias("page_id"),
        F.coalesce(column_or_null(pages, url_col, "string"), F.lit("")).alias("url"),
        F.coalesce(column_or_null(pages, html_col, "string"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1("html"))
    rows = base.join(decide(base).hint("shuffle_hash"), ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        fs, root = open_path(folder)
        fs.create_dir(root, recursive=True)
        writer = BundleWriter()

        def close() -> list[tuple]:
            nonlocal writer
            data, index = writer.finish(), writer.index
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(data)
            writer = BundleWriter()
            return [(f"{folder}/{name.rsplit('/', 1)[1]}", len(index), len(data), [x[0] for x in index], [x[1] for x in index], [x[2] for x in index])]

        for batch in batches:
            for page_id, url, page, refers_to in zip(*batch, strict=True):
                payload = page.encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                number = "null" if page_id is None else str(page_id)
                writer.add(number, record(kind, page_id, url, payload, digest(payload), refers_to, number))
                if writer.out.tell() >= BUNDLE_BYTES:
                    yield close()
        if writer.index:
            yield close()

    return cut_lineage(map_columns(rows, "path string, records long, bytes long, record array<string>, frame array<int>, offset array<long>", run))


def read_bundles(manifest: DataFrame) -> DataFrame:
    """Reads every record that the manifest lists back from the archives, at its place in the
    index, and checks responses' payloads against their digests."""

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        for paths, numbers, frames, offsets in batches:
            for path, number, frame, offset in zip(paths, numbers, frames, offsets, strict=True):
                fs, name = open_path(path)
                out, at, data = [], -1, b""
                with fs.open_input_file(name) as f:
                    reader = BundleReader(f)
                    for want, i, start in zip(number, frame, offset, strict=True):
                        if i != at:
                            at, data = i, reader.frame(i)
                        headers, body, _ = parse(data, start)
                        if headers["WARC-Record-ID"] != f"<urn:quarry:page:{want}>":
                            raise ValueError(f"{path}: {want} is not where the index says")
                        sha1 = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        size = int(headers["X-Payload-Length"])
                        if kind == "response":
                            payload = body[body.index(b"\r\n\r\n") + 4 :]
                            if digest(payload) != sha1 or len(payload) != size:
                                raise ValueError(f"{path}: the payload of {want} is damaged")
                        refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:quarry:page:").removesuffix(">")
                        page = headers["X-Page-ID"]
                        out.append((int(page) if page else None, size, sha1, kind, int(refers) if refers else None))
                        if len(out) >= 5000:
                            yield out
                            out = []
                yield out

    return map_columns(manifest.select("path", "record", "frame", "offset"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", run)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc")))
