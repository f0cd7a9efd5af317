"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently. A bundle is its frames, one after the other, then a
skippable frame with the seek table of the public seekable format: the compressed and the plain size of each frame, the
number of frames, a descriptor byte and the magic number. An index maps each record to its bundle, its frame, and its
offset and length inside the frame, so a reader decompresses one frame to get a record.

A bundle is built in one task and stored as a row (bundle_id, content) of a Parquet table: writing is transactional and
survives the loss of executors on any file system. `export` writes each content as a file where that is wanted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.common import materialise, raw_texts, slices

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 32 << 20, 1
#: A table of repeated payloads of at most this many rows (about 60 bytes each) is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 500_000
#: A bundle is closed at BUNDLE_BYTES stored, or at so many plain bytes or records, so that what a task holds is bounded.
PLAIN_BYTES, RECORDS = 1 << 29, 200_000
WRITTEN = "2024-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if revisit else "response"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {WRITTEN}",
        "WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in (url or "")),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record that starts at a position."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + n], stop + 4 + n + 4


class BundleWriter:
    """Collects records into frames and, at close(), gives the bundle's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.stored = self.plain = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the frame and length of the record."""
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self._close_frame()
        place = (len(self.frames), self.filled, len(data))
        self.open.append(data)
        self.filled += len(data)
        self.plain += len(data)
        return place

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.compress(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.filled))
            self.stored += len(self.frames[-1])
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and plain size of each frame, from the bundle's footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - width * (n - k))
        out.append((start, packed, plain))
        start += packed
    return out


def frame(bundle: bytes, table: list[tuple[int, int, int]], number: int) -> bytes:
    start, packed, plain = table[number]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def read_record(bundle: bytes, number: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Random access: the record at a place of the index; only its frame is decompressed."""
    plain = frame(bundle, seek_table(bundle), number)
    return parse(plain[offset : offset + length])[:2]


def repeated_payloads(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(digest, response, n): of each payload that several rows hold, the largest id, and their number. Only digests are
    shuffled, pre-aggregated."""
    payload = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    rows = pages.select(F.unhex(F.sha1(payload)).alias("digest"), pages[id_col].alias("id"), F.length(payload).alias("n"))
    return rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, bundle_bytes: int = BUNDLE_BYTES, most_broadcast: int = MOST_BROADCAST, records: int = RECORDS) -> DataFrame:
    """(bundle_id string, content binary, index array<struct<page_id, frame, offset, length>>): the bundles of all pages.

    Of the rows whose payloads (UTF-8, null is empty) are equal and have at least `least` bytes, those with the largest
    id are responses and the others revisit it; smaller payloads are responses. Repeated rows with that id are all
    responses. A null id never is the largest; if all are null, all are responses. The pages are not shuffled unless
    more than most_broadcast payloads repeat. A task holds one bundle at a time; a record larger than a bundle has a
    bundle, and a frame, of its own.
    """
    same = materialise(repeated_payloads(pages, id_col, payload_col, least), "warc-repeated")
    rows = pages.select(pages[id_col].cast("long").alias("i"), pages[url_col].cast("string").alias("u"), pages[payload_col].alias("t"))
    rows = rows.withColumn("d", F.unhex(F.sha1(F.coalesce("t", F.lit("")).cast("binary"))))

    def attached(rows: DataFrame, same: DataFrame, name: str, small) -> DataFrame:
        return rows.join(small(same.select(F.col("digest").alias("of"), F.col("response").cast("long").alias(name))), F.col("d") == F.col("of"), "left").drop("of")

    repeated, total = same.select(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if repeated <= most_broadcast:
        rows = attached(rows, same, "r", F.broadcast)
    else:
        # payloads so frequent that at most most_broadcast can be are broadcast; no other one is hot in the shuffle
        often = F.col("n") > total // most_broadcast
        rows = attached(rows, same.where(often), "often", F.broadcast)
        rows = attached(rows.where("often is null").drop("often"), same.where(~often), "r", lambda x: x).unionByName(rows.where("often is not null").withColumnRenamed("often", "r"))
    rows = rows.select("i", "u", "t", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

        def out(writer: BundleWriter, index: list) -> pa.RecordBatch:
            content = writer.close()
            name = hashlib.sha1(content).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([index], pa.list_(place))], ["bundle_id", "content", "index"])

        writer, index = BundleWriter(), []
        for batch in slices(batches, "t"):
            for i, u, t, r in zip(batch.column("i").to_pylist(), batch.column("u").to_pylist(), raw_texts(batch.column("t")), batch.column("r").to_pylist(), strict=True):
                data = record(i, u, t, base32(hashlib.sha1(t).digest()), r, len(t) >= least and r is not None and i != r)
                n, offset, length = writer.add(data)
                index.append({"page_id": i, "frame": n, "offset": offset, "length": length})
                if writer.stored >= bundle_bytes or writer.plain >= PLAIN_BYTES or len(index) >= records:
                    yield out(writer, index)
                    writer, index = BundleWriter(), []
        if index:
            yield out(writer, index)

    return rows.mapInArrow(run, "bundle_id string, content binary, index array<struct<page_id: long, frame: int, offset: long, length: long>>")


def read_back(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, found through index and seek table.

    The digest is computed from what was read: a response's own body. A revisit has no body, so it carries its header's.
    A record whose body does not match its header fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content, index = batch.column("content")[row].as_py(), batch.column("index")[row].as_py()
                table = seek_table(content)
                current, plain = -1, b""
                found: list[tuple] = []
                for x in index:
                    if x["frame"] != current:
                        current = x["frame"]
                        plain = frame(content, table, current)
                    head, body, _ = parse(plain, x["offset"])
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (digest != base32(hashlib.sha1(body).digest()) or int(head["X-Payload-Length"]) != len(body)):
                        raise ValueError(f"record {x} is damaged")
                    page = head["X-Page-ID"]
                    found.append((int(page) if page else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as folder/<bundle_id>.warc.zst, a folder that every executor mounts; (bundle_id, bytes) written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            names, sizes = batch.column("bundle_id").to_pylist(), []
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}.warc.zst")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["bundle_id", "bytes"])

    return bundles.select("bundle_id", "content").mapInArrow(run, "bundle_id string, bytes long")
