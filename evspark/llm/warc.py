"""WARC archives whose records are Zstandard frames of their own, compressed with a dictionary that each archive carries.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, as the WARC-Zstandard convention
asks; one frame for each record follows. The dictionary is trained once, on a bounded sample of the payloads that are
archived. Records of equal payload are stored once: the one of the largest id is the response, others revisit it.

Nulls: a null payload is empty, a null url is written as `urn:none`, a null id sorts below all others. Repeated rows
of the response's id and payload are responses too. Payloads of any length are stored whole. Rows of an empty table
make no archive. Other columns don't matter. A task's archives have names of their own and count only once the
table that lists them is written, so a task that runs twice leaves nothing double.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import new_path, table, written

#: Magic of the skippable frame that holds a dictionary; a fixed value of the format.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads that the dictionary is trained on, and the bytes taken of each; both only bound the training sample.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
#: Uncompressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | None) -> str:
    """A version-8 UUID that holds the id, so that it can be read back."""
    low = 0 if key is None else (1 << 61 | (key & 0x0FFFFFFF_FFFFFFFF))
    high = 0 if key is None else key >> 60 & 0xF
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | 2 << 62 | low)}>"


def key_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>")).int
    if not n >> 61 & 1:
        return None
    key = (n >> 80 & 0xF) << 60 | n & 0x0FFFFFFF_FFFFFFFF
    return key - (1 << 64) if key >> 63 else key


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def train(payloads: list[bytes]) -> bytes:
    """A dictionary of the payloads; where there are too few to train one, their bytes are the dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    def __init__(self, folder: str, dictionary: bytes):
        import zstandard
        from pyarrow.fs import FileSystem

        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.out = files.open_output_stream(f"{path}/{self.name}")
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        self.records = self.raw = 0

    def add(self, data: bytes) -> None:
        self.out.write(self.compress(data))
        self.records += 1
        self.raw += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.raw


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = stream.read(size)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = io.BufferedReader(unpack.stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := data.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the beginning of a record: {line[:80]!r}")
        headers = {}
        while (line := data.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = data.read(int(headers["content-length"]))
        if data.read(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield headers, block


def with_roles(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """key, url, payload, digest and refers_to (null: response) of each row. Keys are pre-aggregated by digest; Spark splits hot ones in the join."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    kept = rows.groupBy("digest").agg(F.max("key").alias("kept"))
    joined = rows.join(kept, "digest")
    return joined.withColumn("revisits", ~F.col("key").eqNullSafe(F.col("kept"))).withColumn("refers_to", F.when(F.col("revisits"), F.col("kept")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every row of pages to archives below folder; a table of their file, records and raw_bytes."""
    some = pages.filter(F.length(payload) > 0)
    share = SAMPLES / max(some.count(), SAMPLES)  # about SAMPLES rows reach the driver, however many tasks there are
    # the payload counts in the hash, as rows without key and url have nothing else; rows equal in all are picked once
    picked = some.filter(F.pmod(F.xxhash64(key, url, payload), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = picked.select(F.encode(F.substring(payload, 1, SAMPLE_BYTES // 4), "UTF-8").alias("p")).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLES)
    dictionary = train(sorted(bytes(r.p) for r in sample.collect()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for k, address, text, digest, revisits, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = ArchiveWriter(folder, dictionary)
                    out.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                data = text.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                head = [
                    ("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(k)), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", "", address or "urn:none")),
                    ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(data))),
                ]
                out.add(record([*head, ("WARC-Refers-To", record_id(refers)), ("WARC-Profile", REVISIT_PROFILE)], http) if revisits else record(head, http + data))
                if out.raw >= ARCHIVE_BYTES:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "raw_bytes"])

    rows = with_roles(pages, key, url, payload).select("key", "url", "payload", "digest", "revisits", "refers_to")
    return written(rows.mapInArrow(write, "file string, records long, raw_bytes long"), "archives")


READ_SCHEMA = "record_key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit record of the archives; what a response holds is checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(folder)
        names = [x.partition(" ")[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}") as stream:
                    for head, block in records_of(stream):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        digest, data = head["warc-payload-digest"].removeprefix("sha1:"), None
                        if head["warc-type"] == "response":
                            data = block.partition(b"\r\n\r\n")[2]
                            if base64.b32encode(hashlib.sha1(data).digest()).decode() != digest or len(data) != int(head["x-payload-length"]):
                                raise ValueError(f"a payload in {name} doesn't match its digest")
                        rows.append((key_of(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], key_of(head["warc-refers-to"]) if "warc-refers-to" in head else None, data if payloads else None))
                        held += len(data or b"") if payloads else 0
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    n = max(1, archives.count())
    return archives.select("file").repartition(n).mapInArrow(read, READ_SCHEMA)


def op1_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    back = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return back.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
