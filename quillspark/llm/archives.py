"""Web archives packed in ZIP files: written as stored members, read by range requests without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_per_batch, settle, shared_dir

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
CHUNK_RECORDS = 2000  # index lines that one reader row covers
HOT_ROWS, HOT_SHARE = 1000, 10_000  # a payload is hot from so many rows, and from one of so many of all rows


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.1 record: an HTTP response block; a revisit has its headers alone, with the full payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or 'about:blank').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[3:3] = [f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises ValueError where a length or a digest does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or f"sha1:{payload_digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("a record's block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or f"sha1:{payload_digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError("a record's payload is damaged")
    number = lambda x: int(v) if (v := fields[x][len("<urn:x-page:") : -1]) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": number("WARC-Refers-To") if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


@dataclass
class Member:
    name: str
    offset: int  # of the local header
    size: int
    method: int


class ZipDirectory:
    """Members of a ZIP file, from its end: the end record, the ZIP64 locator and end record, the central directory.

    read(offset, length) fetches a range; nothing else of the file is touched. Raises ValueError for damaged archives.
    """

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0 or len(tail) < at + 22:
            raise ValueError("no end of central directory")
        _, _, _, n, length, start, _ = struct.unpack("<4H2LH", tail[at + 4 : at + 22])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            data = read(end64, 56)
            if data[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack("<3Q", data[32:56])
        directory = read(start, length)
        self.members: dict[str, Member] = {}
        p = 0
        for _ in range(n):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack("<2H", directory[p + 8 : p + 12])
            packed, full, n_name, n_extra, n_comment = struct.unpack("<2L3H", directory[p + 20 : p + 34])
            (offset,) = struct.unpack("<L", directory[p + 42 : p + 46])
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, m = struct.unpack("<2H", extra[:4])
                if kind == 1:  # ZIP64: only what does not fit in the entry, in this order
                    wide = iter(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + m :]
            self.members[name] = Member(name, offset, packed, method)
            p += 46 + n_name + n_extra + n_comment

    def data_offset(self, name: str) -> int:
        """Where a stored member's bytes begin: its local header has lengths of its own."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(member.offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack("<2H", head[26:30])
        return member.offset + 30 + n_name + n_extra


def _filesystem(folder: str):
    """pyarrow's file system of a folder's URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, force_zip64: bool = False) -> DataFrame:
    """Write one record a row into ZIP archives under folder; returns (path, n_records) of the archives.

    Among rows of one payload of at least min_payload bytes those of the largest page_id are responses (null is least; rows
    that repeat it are all responses) and the others revisit it; smaller payloads are all responses. Null html is empty,
    other columns are not written. A task streams its rows into one archive of its
    attempt, which gets its final name when whole; a lost task is written again under another name, and only returned
    paths count. An empty table gives no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # A hot payload: its one keeper row is copied to salts, over which its rows spread. Payloads of more than `hot` rows are
    # HOT_SHARE at most, whose numbers of salts are broadcast.
    hot = max(HOT_ROWS, pages.count() // HOT_SHARE)
    keepers = settle(keyed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.ceil(F.count(F.lit(1)) / F.lit(hot)).cast("int").alias("salts")))
    spread = keyed.join(F.broadcast(keepers.where("salts > 1").select("digest", "salts")), "digest", "left")
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = keepers.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    marked = spread.join(copies, ["digest", "salt"]).select(
        "page_id", "url", "payload", "keeper", ((F.octet_length("payload") < min_payload) | F.col("page_id").eqNullSafe(F.col("keeper"))).alias("own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        where, root = _filesystem(folder)
        where.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        partial, final = f"{root}/.{name}.part", f"{root}/{name}.zip"
        n = at = 0
        with where.open_output_stream(partial) as sink, tempfile.SpooledTemporaryFile(8 << 20) as index:
            with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
                with z.open(RECORDS, "w", force_zip64=True) as out:
                    for batch in _chain(first, batches):
                        for part in rows_per_batch(iter([batch])):
                            for page_id, url, payload, keeper, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                                kind = "response" if own else "revisit"
                                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                                data = packer.compress(record(page_id, url, payload, None if own else keeper, kind)) + packer.flush()
                                out.write(data)
                                index.write(json.dumps({"offset": at, "length": len(data), "page": page_id}).encode() + b"\n")
                                at += len(data)
                                n += 1
                index.seek(0)
                with z.open(INDEX, "w", force_zip64=force_zip64) as out:
                    while chunk := index.read(1 << 20):
                        out.write(chunk)
        where.move(partial, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.zip"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return marked.mapInArrow(run, "path string, n_records long")


def _chain(first, rest):
    yield first
    yield from rest


def _ranges(path: str):
    where, name = _filesystem(path)
    f = where.open_input_file(name)
    return f, lambda offset, length: f.read_at(length, offset)


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Records of the archives at `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    First the directories and indexes are read (a few ranges an archive), then stretches of index lines are dealt out
    and each stretch's records fetched by range, unpacked and checked. Revisits have no payload of their own. No
    archives: no rows; archives of one path are read each. A damaged archive or record raises ValueError.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                f, read = _ranges(path)
                with f:
                    z = ZipDirectory(read, f.size())
                    base, at, size = z.data_offset(RECORDS), z.data_offset(INDEX), z.members[INDEX].size
                    starts, lengths, left, done = [], [], b"", 0
                    while done < size or left:
                        chunk = read(at + done, min(1 << 20, size - done))
                        done += len(chunk)
                        *lines, left = (left + chunk).split(b"\n")
                        for x in map(json.loads, lines):
                            starts.append(base + x["offset"])
                            lengths.append(x["length"])
                        while len(starts) >= CHUNK_RECORDS or (starts and done >= size):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([starts[:CHUNK_RECORDS]], pa.list_(pa.int64())), pa.array([lengths[:CHUNK_RECORDS]], pa.list_(pa.int64()))], ["path", "starts", "lengths"])
                            starts, lengths = starts[CHUNK_RECORDS:], lengths[CHUNK_RECORDS:]
                        if done >= size:
                            break

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for path, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, read = _ranges(path)
                with f:
                    rows, held = [], 0
                    for i, (offset, length) in enumerate(zip(starts, lengths, strict=True)):
                        rows.append(parse_record(zlib.decompress(read(offset, length), 31)))
                        held += len(rows[-1]["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 500 or i + 1 == len(starts):
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)
                            rows, held = [], 0

    parts = archives.select("path").mapInArrow(indexed, "path string, starts array<long>, lengths array<long>")
    dealt = parts.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(fetched, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    return read_archives(spark, settle(write_archives(pages, folder, min_payload)))
