"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a seek table in a skippable frame (the
seekable format of zstd: magic 0x184D2A5E, entries of two sizes, footer 0x8F92EAB1). An index maps record ids to bundle, frame and
place in the frame, so that one record costs one range read and one frame.

A page whose payload equals that of a page with a smaller id is a ``revisit`` of the first such page. Payloads are told apart
by SHA-256 and length; the SHA-1 that the records carry decides nothing, as equal ones can be made for different payloads. The rows are
numbered in a table that is written first; which page is the first is found over digests alone (a partial aggregation and a join whose hot keys
adaptive execution splits), and only the rows that revisit another meet the payloads again.

Reading goes through the index: each bundle is opened once, each frame that the index names is decompressed once, and records are cut out at
their places. A record that is not the one the index names, a frame whose records do not fill it or a payload that does not fit its digest raises.

Bundles are written by the executors to the folder that the session shares, through pyarrow's file systems, under names
that hold the task attempt; the index names the files of the attempts that ended well, so a lost executor leaves no wrong record.

A null html is an empty payload, a null url is written as urn:page:<id>. A null id is larger than any other. Rows that repeat an id
and a payload revisit the first of them. A payload that is longer than a frame or a bundle has one to itself. Extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import quoted, slices, utf8

FRAME = 1 << 20
BUNDLE = 32 << 20
# Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{rid}')}>"


def record(page_id: int | None, rid: int, url: str | None, payload: bytes, sha1: str, first: tuple[int | None, int] | None) -> bytes:
    """A WARC/1.1 record. first: id and row of the page it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url is not None else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(page_id, rid)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*first)}"]
        if first[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {first[0]}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(place, length, headers, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        head["X-Payload-Length"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
        stop = end + 4 + size + 4
        yield at, stop - at, head, payload
        at = stop


class Bundle:
    """A bundle in the making: frames, seek table and the places of its records."""

    def __init__(self, level: int = 3, frame: int = FRAME):
        self.most, self.packer, self.out, self.frames = frame, zstandard.ZstdCompressor(level=level), [], []
        self.size, self.frame, self.held, self.places = 0, [], 0, []

    def add(self, data: bytes) -> None:
        if self.held and self.held + len(data) > self.most:
            self.close_frame()
        self.places.append((len(self.frames), self.held, len(data)))
        self.frame.append(data)
        self.held += len(data)

    def close_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.frames.append((len(packed), self.held))
            self.out.append(packed)
            self.size += len(packed)
            self.frame, self.held = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE, len(table)), table])


class Reader:
    """Random access to a bundle's frames."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, raw = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def record(self, frame: int, place: int, length: int) -> tuple[dict[str, str], bytes]:
        _, _, head, payload = next(parse(self.frame(frame)[place : place + length]))
        return head, payload


def typed(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Rows with their payload, digest and the page they revisit, if any."""
    body = utf8(quoted(html_col))
    rows = scratch.write(
        pages.select(
            F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"), body.alias("body"), F.sha1(body).alias("sha1"),
            F.unhex(F.sha2(body, 256)).alias("sha2"), F.octet_length(body).alias("n"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    slim = rows.where(F.col("n") >= least).select("sha2", "n", "page_id", "rid")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("rid").alias("rid"))
    # written, so that only an exchange stands between the rows and the join: then adaptive execution can split a hot payload
    first = scratch.write(slim.groupBy("sha2", "n").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    again = scratch.write(slim.join(first, ["sha2", "n"]).where("rid <> first.rid").select("rid", F.col("first.id").alias("first_id"), F.col("first.rid").alias("first_rid")))
    return rows.select("page_id", "rid", "url", "body", "sha1").join(again, "rid", "left")


def write(pages: DataFrame, uri: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, bundle: int = BUNDLE, frame: int = FRAME) -> DataFrame:
    """Write the pages as bundles under ``uri``; the index: page_id, record_id, bundle, frame, place, length.

    least: bytes of payload from which equal ones become revisits; bundle: compressed bytes from which a bundle is closed;
    frame: bytes of whole records in a frame, unless one record has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        made, ids, open_bundle = 0, [], Bundle(frame=frame)

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(open_bundle.finish())
            frames, places, lengths = zip(*open_bundle.places, strict=True)
            pages_, names = zip(*ids, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(pages_, pa.int64()), pa.array(names), pa.array([f"{uri}/{name}"] * len(ids)), *(pa.array(x, pa.int64()) for x in (frames, places, lengths))],
                ["page_id", "record_id", "bundle", "frame", "place", "length"],
            )

        for b in slices(batches, "body"):
            for r in b.to_pylist():
                first = None if r["first_rid"] is None else (r["first_id"], r["first_rid"])
                open_bundle.add(record(r["page_id"], r["rid"], r["url"], r["body"], r["sha1"], first))
                ids.append((r["page_id"], record_id(r["page_id"], r["rid"])))
                if open_bundle.size >= bundle:
                    yield close()
                    made, ids, open_bundle = made + 1, [], Bundle(frame=frame)
        if ids:
            yield close()

    rows = typed(pages, scratch, id_col, url_col, html_col, least)
    return scratch.write(rows.mapInArrow(run, "page_id long, record_id string, bundle string, frame long, place long, length long"))


def read(index: DataFrame) -> DataFrame:
    """The records that an index names, their payloads checked against their digests: page_id, record_id, url, record_type, payload (null for
    revisits), payload_bytes, payload_digest, refers_to, bundle, frame, place."""
    schema = "page_id long, record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, bundle string, frame long, place long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def records(reader: Reader, uri: str, frame: int, wanted: list[dict]) -> Iterator[tuple]:
        data, at = reader.frame(frame), 0
        for want in sorted(wanted, key=lambda w: w["place"]):
            place, length = want["place"], want["length"]
            _, used, head, payload = next(parse(data[place : place + length]))
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            if (place, length, head["WARC-Record-ID"]) != (at, used, want["record_id"]):
                raise ValueError(f"{uri}, frame {frame}, {place}: not the record of the index")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{uri}, frame {frame}, {place}: payload and digest differ")
            number = lambda key, head=head: int(head[key]) if key in head else None
            yield (number("X-Page-ID"), want["record_id"], head["WARC-Target-URI"], kind, payload if kind == "response" else None,
                   int(head["X-Payload-Length"]), digest, number("X-Refers-To-Page-ID"), uri, frame, place)
            at += length
        if at != len(data):
            raise ValueError(f"{uri}, frame {frame}: records that the index does not name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, wanted in zip(b.column("bundle").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                reader, frames = Reader(uri), {}
                for w in wanted:
                    frames.setdefault(w["frame"], []).append(w)
                if len(frames) != len(reader.frames):
                    raise ValueError(f"{uri}: frames that the index does not name")
                for frame, own in sorted(frames.items()):
                    rows = list(records(reader, uri, frame, own))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # a bundle's records are as many as fit its size, and each has its own group
    bundles = index.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "place", "length")).alias("wanted"))
    n = min(max(index.select("bundle").distinct().count(), 1), 20_000)  # a task a bundle, whatever the index's own size
    return bundles.repartition(n).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, then read the archives back."""
    scratch = Scratch(spark, "warc")
    return read(write(pages, scratch.path("bundles"), scratch, least=least))
