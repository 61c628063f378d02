"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, followed by
a skippable frame that maps record identifiers to (frame, offset in the frame, length) and by the seek
table of the seekable format, also a skippable frame, so that any Zstandard tool can still read the
whole file. Tasks write bundles straight to the shared folder under a name of their own attempt; the
manifest that they return names only files of attempts that ended, so lost executors leave at most
unreferenced files.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SMALL_ROWS, join_groups, materialize, shared_dir

#: Of the Zstandard seekable format and of WARC 1.1. Fixed values.
SKIPPABLE_SEEK, SKIPPABLE_MAP = 0x184D2A5E, 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2000-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; with refers_to a revisit, whose block keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, with the HTTP header's content length as http-length, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")).decode()
    return fields, payload


class BundleWriter:
    """Gathers records into frames of about frame_bytes; close() appends the record map and the seek table."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.pending, self.held, self.written = [], 0, 0
        self.places: list[tuple[str, int, int, int]] = []

    def add(self, name: str, data: bytes) -> tuple[int, int, int]:
        """The record's frame number, offset within the frame and length."""
        if len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.held, len(data)
        self.places.append((name, *place))
        self.pending.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        places = self.zstd.compress(json.dumps(self.places).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_MAP, len(places)) + places)
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle by its seek table; keeps the last frame."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        entries = struct.unpack(f"<{2 * count}I", source.read(8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(entries[::2], entries[1::2], strict=True):
            self.frames.append((at, packed, plain))
            at += packed
        self.map_at, self.last = at, (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.frames[number]
            self.source.seek(at)
            self.last = number, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def places(self) -> list[list]:
        """The record map kept in the bundle itself."""
        self.source.seek(self.map_at)
        _, n = struct.unpack("<II", self.source.read(8))
        return json.loads(zstandard.ZstdDecompressor().decompress(self.source.read(n)))


def dedup_decisions(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to, null for rows whose payload is to be stored.

    Only the digest's smallest page_id is grouped, with map-side aggregation, and written where several pages share it.
    Up to SMALL_ROWS such digests are broadcast, so that no payload moves; more are joined by a shuffle, in which a
    payload that very many pages share is dealt to several tasks.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = own.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialize(first, "repeated-payloads")
    groups = first.select("digest", "first_id")
    if first.count() <= SMALL_ROWS:
        joined = own.join(F.broadcast(groups), "digest", "left")
    else:
        joined = join_groups(own, groups, ["digest"], F.col("page_id"), counts=first.select(F.xxhash64("digest").alias("of"), "n"))
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_bundles(decided: DataFrame, folder: str, bundle_bytes: int = 256 << 20, frame_bytes: int = 1 << 20) -> DataFrame:
    """Write the archives; returns the manifest bundle, records, one row per bundle. Where a record lies only the bundle's own map says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":/", ":///", 1))
        store.create_dir(base, recursive=True)
        writer = out = path = None

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([len(writer.places)], pa.int64())], ["bundle", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = row
                if writer is None:
                    path = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path, compression=None)
                    writer = BundleWriter(out, frame_bytes)
                writer.add(f"urn:page:{'' if page_id is None else page_id}", record(page_id, url, html.encode(), digest, refers_to))
                if writer.written >= bundle_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return decided.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "bundle string, records long")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the bundles that a manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each record is looked up by the map in its bundle. A response's size and digest are of the bytes read; a revisit's are
    those that its record states.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    number = lambda urn: int(x) if (x := urn.strip("<>").removeprefix("urn:page:")) else None

    def read(reader: BundleReader, bundle: str, name: str, frame: int, start: int, length: int) -> tuple:
        fields, payload = parse_record(reader.record(frame, start, length))
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-record-id"] != f"<{name}>":
            raise ValueError(f"{bundle}: another record lies where the map says {name}")
        if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != int(fields["http-length"])):
            raise ValueError(f"{bundle}: a payload differs from its digest")
        return number(fields["warc-record-id"]), int(fields["http-length"]), stated, fields["warc-type"], number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":/", ":///", 1))
        for batch in batches:
            for bundle, records in zip(batch.column("bundle").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with store.open_input_file(bundle) as source:
                    reader = BundleReader(source, source.size())
                    places = reader.places()
                    if len(places) != records:
                        raise ValueError(f"{bundle}: {len(places)} records instead of {records}")
                    for at in range(0, len(places), 4096):
                        out = [read(reader, bundle, *place) for place in places[at : at + 4096]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.repartition(tasks, "bundle")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_archive(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write pages (page_id, url, html) to archives in `folder` and return what reading them back gives.

    One row per input row. Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are
    responses and the others revisits of it; rows with smaller payloads are all responses. A null html is an empty
    payload, a null url is archived as about:blank, a null page_id stays null and never is the one referred to. A row
    repeated with its page_id has the role of the first. A record is never split: a frame ends with
    the record that fills it. Other columns
    are not read. An empty table writes nothing.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = materialize(write_bundles(dedup_decisions(pages, least), folder), "warc-manifest")
    return read_bundles(manifest, folder)
