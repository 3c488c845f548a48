"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table in a skippable frame (the public seekable format),
and its index maps every record identifier to (frame, offset in the frame's content, length). Bundles are rows of a table in the shared folder,
so any store that Spark reaches can hold them; export_bundles() writes them and their indexes as files, find_records() opens single records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import bounded, join_by_size, map_arrow, stash

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 23, 3
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the seekable format and of the WARC revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
BUNDLE = "bundle_id string, data binary, records array<struct<record_id: string, page_id: long, frame: int, offset: long, length: long>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record whose block has no payload."""
    digest, uri = payload_digest(payload), "".join((url or "urn:x-page:none").split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload; raises if lengths or a response's digest do not hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError("payload does not match its digest")
    return fields, payload


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.out, self.held, self.size = [], [], 0
        self.index: list[dict] = []

    def add(self, page_id: int | None, name: str, record: bytes) -> None:
        if self.size and self.size + len(record) > self.frame_bytes:
            self.cut()
        self.index.append({"record_id": name, "page_id": page_id, "frame": len(self.frames), "offset": self.size, "length": len(record)})
        self.held.append(record)
        self.size += len(record)

    def cut(self) -> None:
        if self.held:
            frame = self.coder.compress(b"".join(self.held))
            self.frames.append((len(frame), self.size))
            self.out.append(frame)
            self.held, self.size = [], 0

    def bytes_held(self) -> int:
        return self.size + sum(n for _, n in self.frames)

    def close(self) -> bytes:
        self.cut()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE, len(table)), table])


class BundleReader:
    """Opens frames by the seek table; keeps the last one."""

    def __init__(self, data: bytes):
        n, _, magic = struct.unpack("<IBI", data[-9:])
        start = len(data) - 9 - 8 * n
        if magic != SEEKABLE or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("no seek table")
        self.data, self.at, self.sizes = data, [0], list(struct.iter_unpack("<II", data[start : start + 8 * n]))
        for packed, _ in self.sizes:
            self.at.append(self.at[-1] + packed)
        self.open, self.content = -1, b""

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.open:
            packed = self.data[self.at[frame] : self.at[frame + 1]]
            self.content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[frame][1])
            self.open = frame
        return self.content[offset : offset + length]


def write_bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> the stored table of bundles. Among equal payloads the smallest page_id is the response.

    Null html is an empty payload. A page without page_id revisits where a page with an id has its payload, else it is a response; rows that
    repeat both page_id and payload are all responses and share a record identifier. A very long html is one record of one frame of its own
    size. Other columns are ignored; an empty table gives no bundles."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    groups = stash(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    told = join_by_size(rows, groups, ["sha"], "n", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(w: BundleWriter) -> pa.RecordBatch:
            data = w.close()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()[:32]]), pa.array([data], pa.binary()), pa.array([w.index], INDEX)], ["bundle_id", "data", "records"])

        w = BundleWriter(frame_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                w.add(page, record_id(page, payload_digest(payload)), write_record(page, url, payload, refers_to))
                if w.bytes_held() >= bundle_bytes:
                    yield row(w)
                    w = BundleWriter(frame_bytes)
        if w.index:
            yield row(w)

    return stash(map_arrow(told, run, BUNDLE), "warc")


def read_bundles(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the bundles, opened through seek table and index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the length and digest of the response it refers to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader, rows = BundleReader(batch.column(0)[i].as_py()), []
                for e in batch.column(1)[i].as_py():
                    fields, payload = read_record(reader.record(e["frame"], e["offset"], e["length"]))
                    page, to, kind = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID"), fields["WARC-Type"]
                    if (page and int(page)) != e["page_id"] or fields["WARC-Record-ID"] != e["record_id"]:
                        raise ValueError("the index names another record")
                    rows.append((e["page_id"], len(payload) if kind == "response" else None, fields["WARC-Payload-Digest"][5:], kind, int(to) if to else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = stash(map_arrow(bundles.select("data", "records"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes")
    needed = stash(revisits.groupBy(F.col("refers_to").alias("page_id"), "payload_digest").agg(F.count("*").alias("n")), "needed")
    full = read.where("record_type = 'response'").join(bounded(needed), ["page_id", "payload_digest"])
    full = stash(full.groupBy(F.col("page_id").alias("refers_to"), "payload_digest", "n").agg(F.max("payload_bytes").alias("payload_bytes")), "responses")
    told = join_by_size(revisits, full, ["refers_to", "payload_digest"], "n")
    return read.where("record_type = 'response'").select(names).unionByName(told.select(names))


def find_records(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(record_id) -> record_id, header, payload of each: only the frames that hold them are opened. Identifiers that no bundle has give no row."""
    each = bundles.select("bundle_id", F.explode("records").alias("r")).select("bundle_id", "r.*")
    wanted = each.join(ids.select("record_id").distinct(), "record_id").groupBy("bundle_id")
    wanted = wanted.agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("wanted"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = BundleReader(batch.column(0)[i].as_py())
                for e in batch.column(1)[i].as_py():
                    fields, payload = read_record(reader.record(e["frame"], e["offset"], e["length"]))
                    yield pa.RecordBatch.from_arrays([pa.array([e["record_id"]]), pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([payload], pa.binary())], ["record_id", "header", "payload"])

    return map_arrow(bundles.join(wanted, "bundle_id").select("data", "wanted"), run, "record_id string, header map<string, string>, payload binary")


def export_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Write each bundle as a .warc.zst file, and its index as JSON lines beside it, in a folder that the driver can write, one bundle in
    memory at a time. Returns the bundles' names."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in bundles.select("bundle_id", "data", "records").toLocalIterator():
        names.append(os.path.join(folder, f"{r['bundle_id']}.warc.zst"))
        with open(names[-1], "wb") as f:
            f.write(r["data"])
        with open(f"{names[-1]}.idx.jsonl", "w") as f:
            f.writelines(json.dumps(e.asDict()) + "\n" for e in r["records"])
    return names
