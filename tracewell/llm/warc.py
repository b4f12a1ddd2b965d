"""WARC archives in Zstandard: one frame per record, a shared dictionary first.

An archive starts with a skippable frame that holds the dictionary; each
record after it is a frame of its own. Archives are written by the tasks to
the shared folder, each within a bound of payload bytes, under a name that no
other attempt uses; only those that a finished task reports are read. Reading
takes a frame at a time and checks version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import new_path, save

#: Magic number of the skippable frame with the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: The dictionary's size, and the pages (chosen by a hash of the id) from which it is trained.
DICTIONARY_BYTES, SAMPLE_PAGES = 32 << 10, 256
#: Up to so many repeated payloads (40 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
STEP = 1 << 14
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One record; a revisit has no block, but the digest and length of its payload."""
    block = b"" if revisits else payload
    head = [
        ("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisits:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; a ValueError says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError(f"{where}: no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(": ")
        if not colon or name in headers:
            raise ValueError(f"{where}: bad header line {line!r}")
        headers[name] = value
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length", "X-Payload-Length"} - headers.keys()
    if missing:
        raise ValueError(f"{where}: missing {sorted(missing)}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if headers["WARC-Type"] == "response":
        if headers["WARC-Payload-Digest"] != f"sha1:{digest(block)}" or int(headers["X-Payload-Length"]) != size:
            raise ValueError(f"{where}: the payload's digest or length differs")
    elif headers["WARC-Type"] != "revisit" or size or "WARC-Refers-To" not in headers:
        raise ValueError(f"{where}: bad record of type {headers['WARC-Type']}")
    return headers, block


def store_at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from samples; too few of them serve as plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    """Archives of one task, one after another."""

    def __init__(self, uri: str, prefix: str, dictionary: bytes):
        self.fs, self.dir = store_at(uri)
        self.prefix, self.dictionary, self.number, self.out = prefix, dictionary, 0, None
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)

    def add(self, data: bytes) -> tuple | None:
        """Writes a record; an archive that is full by then is closed and reported."""
        if self.out is None:
            self.name, self.number = f"{self.prefix}-{self.number}.warc.zst", self.number + 1
            self.fs.create_dir(self.dir, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.dir}/{self.name}", compression=None)
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(self.dictionary)) + self.dictionary)
            self.records = self.bytes = 0
        self.out.write(self.packer.compress(data))
        self.records += 1
        self.bytes += len(data)
        return self.close() if self.bytes >= ARCHIVE_BYTES else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return self.name, self.records, self.bytes


def frames(source, where: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame after the dictionary's."""
    head = source.read(8)
    if len(head) < 8:
        raise ValueError(f"{where}: shorter than a frame's header")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError(f"{where}: no dictionary frame")
    stored = source.read(size)
    if len(stored) != size:
        raise ValueError(f"{where}: the dictionary is cut off")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored) if stored else None)
    at, rest = 8 + size, b""
    while rest or (rest := source.read(STEP)):
        frame, start, out = unpacker.decompressobj(), at, []
        while not frame.eof:
            if not rest and not (rest := source.read(STEP)):
                raise ValueError(f"{where}: the frame at {start} is cut off")
            out.append(frame.decompress(rest))
            unused = frame.unused_data if frame.eof else b""
            at += len(rest) - len(unused)
            rest = unused
        yield start, b"".join(out)


def write(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Archives of all rows of ``pages`` (page_id, url, html): their folder and a table (archive, records, bytes).

    A null html is an empty payload. Of equal payloads of at least
    ``min_bytes``, the one with the largest page_id is the response (all that
    share this id are) and the others revisit it; smaller payloads, and equal
    ones that have no id at all, are responses. Null ids and urls stay null.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    sampled = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    samples = [bytes(r[0]) for r in pages.join(F.broadcast(sampled), "page_id", "left_semi").orderBy(F.xxhash64("page_id")).limit(SAMPLE_PAGES).select("payload").collect()]
    dictionary = train_dictionary([x for x in samples if x])
    keyed = pages.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    groups = save(keyed.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("source")).filter("n > 1 and source is not null").select("key", "source"), "payloads")
    groups = F.broadcast(groups) if groups.count() <= MAX_BROADCAST_ROWS else groups
    rows = keyed.join(groups, "key", "left").select("page_id", "url", "payload", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"{task.partitionId()}-{task.taskAttemptId()}", dictionary)
        done = []
        for batch in batches:
            for page, url, payload, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done.append(writer.add(record(page, url, payload, source is not None and source != page, source)))
        done = [x for x in [*done, writer.close()] if x]
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return folder, save(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read(folder: str, archives: DataFrame) -> DataFrame:
    """RECORDS of the archives named in ``archives`` (archive) under ``folder``, each record validated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store_at(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            rows = []
            with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                for offset, data in frames(source, name):
                    head, _ = parse(data, f"{name} at {offset}")
                    back = head.get("WARC-Refers-To")
                    rows.append((page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], page_of(back) if back else None, name, offset))
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in rows], kinds)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(run, RECORDS)
