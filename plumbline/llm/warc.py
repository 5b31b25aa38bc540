"""WARC archives under zstandard: one frame per record, and the dictionary in a leading skippable frame.

Writing: each task packs its records into archives of bounded size, trains a dictionary on each archive's own records,
and puts the files into a folder that all executors share; a manifest names the files of the attempts that succeeded, so
a lost executor leaves no double records. Reading: archives are dealt out one by one; a reader loads the dictionary,
decodes frame by frame and checks every record's version, headers, lengths and digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, written
from .common import bounded_batches, map_batches

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes of records in one archive; one longer record makes an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16_384
#: Bytes of an archive's records that its dictionary is trained on.
TRAINING_BYTES = 1 << 20
LEVEL = 3
READ_BYTES = 1 << 16
#: Bytes of archives that one task reads, and of payloads that one batch of records holds.
TASK_BYTES = 128 << 20
BATCH_PAYLOADS = 4 << 20
#: Payloads whose copies are matched by broadcast: each has more than a HOT_PAYLOADS-th of all records.
HOT_PAYLOADS = 1024
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Record:
    """One record. A revisit has no payload, only the payload's length and digest."""

    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    date: str = "1970-01-01T00:00:00Z"

    def encode(self) -> bytes:
        revisit = self.refers_to is not None
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.payload_bytes}\r\n\r\n".encode()
        block = head + (b"" if revisit else self.payload)
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if self.page_id is None else self.page_id}>"),
            ("WARC-Date", self.date),
            *([("WARC-Target-URI", _escaped(self.url))] if self.url is not None else []),
            ("WARC-Payload-Digest", f"sha1:{self.payload_digest}"),
            *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{self.refers_to}>")] if revisit else []),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ]
        return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _escaped(url: str) -> str:
    """The URL with percent signs and control characters escaped, so that it stays on its line."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 33 or ord(c) == 127 else c for c in url)


def _unescaped(text: str) -> str:
    parts = text.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"unknown record id {urn}")
    return int(urn[10:-1]) if urn[10:-1] else None


def decode(raw: bytes) -> Record:
    """The record of a frame's bytes; ValueError says what is wrong with it."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", VERSION):
        raise ValueError(f"unknown version {version[:20]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header {line[:40]!r}")
        fields[name.strip(" \t").lower()] = value.strip(" \t")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise ValueError(f"missing header {missing[0]}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or not sizes:
        raise ValueError("no HTTP headers")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    url = _unescaped(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    page = _page(fields["warc-record-id"])
    if fields["warc-type"] == "revisit":
        if payload:
            raise ValueError("revisit with a payload")
        return Record(page, url, None, sizes[0], digest, _page(fields.get("warc-refers-to", "")), fields["warc-date"])
    if fields["warc-type"] != "response":
        raise ValueError(f"unknown type {fields['warc-type']}")
    if len(payload) != sizes[0]:
        raise ValueError(f"payload of {len(payload)} bytes, HTTP length {sizes[0]}")
    if sha1_base32(payload) != digest:
        raise ValueError("payload and digest differ")
    return Record(page, url, payload, len(payload), digest, None, fields["warc-date"])


def archive(records: list[bytes]) -> bytes:
    """The archive's bytes: dictionary frame, if there are records enough to train one, and a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size + len(r) <= TRAINING_BYTES:
            sample.append(r)
            size += len(r)
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        dictionary = b""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    lead = struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored if dictionary else b""
    return lead + b"".join(codec.compress(r) for r in records)


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one."""
    at, dictionary = 0, None
    while len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
        magic, length = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + length]
        if magic == DICTIONARY_FRAME and at == 0:
            if body[:4] == FRAME_MAGIC:
                body = zstandard.ZstdDecompressor().decompress(body)
            if body[:4] != DICTIONARY_MAGIC:
                raise ValueError("the leading frame holds no dictionary")
            dictionary = zstandard.ZstdCompressionDict(body)
        at += 8 + length
    codec = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        decoder, parts = codec.decompressobj(), []
        while not decoder.eof:
            chunk = data[at : at + READ_BYTES]
            if not chunk:
                raise ValueError("the last frame is cut off")
            parts.append(decoder.decompress(chunk))
            at += len(chunk) - len(decoder.unused_data)
        yield b"".join(parts)


def mark_revisits(pages: DataFrame, *, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id of the records with an equal payload, null for that record.

    Payloads are compared by length and SHA-1; those of fewer than min_bytes bytes refer to none. A null html is an empty
    payload. A null page_id is never referred to and refers to none. Rows that share the largest page_id are responses
    all. Groups are counted by digest, without payloads, before they are joined back. The HOT_PAYLOADS payloads with the
    most copies are broadcast (that many rows at most), so the copies of an empty or error page aren't moved to one task;
    no other payload can have more than a HOT_PAYLOADS-th of the records.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"))
    rows = rows.withColumn("__key", F.concat_ws(":", F.octet_length("html"), F.sha1("html")))
    last = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("__key")
        .agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
    )
    last = written(last, "payloads")
    hot = written(last.orderBy(F.desc("__n"), "__key").limit(HOT_PAYLOADS).select("__key", F.col("__last").alias("__hot")), "hot")
    cold = last.join(F.broadcast(hot), "__key", "left_anti").select("__key", "__last")
    # a hot key is no key of the second join, so its rows stay spread by their ids
    found = rows.join(F.broadcast(hot), "__key", "left")
    spread = F.when(F.col("__hot").isNotNull(), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("__key"))
    found = found.withColumn("__key", spread).join(cold, "__key", "left").withColumn("__last", F.coalesce("__hot", "__last"))
    refers = F.when(F.col("page_id") < F.col("__last"), F.col("__last"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write mark_revisits() rows as archives in folder; path, records and bytes of every archive. Empty input, no archive."""

    def flush(records: list[bytes]) -> pa.RecordBatch:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        data = archive(records)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, refers = (c[k].as_py() for c in batch.columns)
                payload = html.encode()
                records.append(Record(page, url, payload, len(payload), sha1_base32(payload), refers).encode())
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return written(bounded_batches(marked.select("page_id", "url", "html", "refers_to")).mapInArrow(write, "path string, records long, bytes long"), "manifest")


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"


def read_archives(manifest: DataFrame, *, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of the archives in manifest (path, records, bytes), with the columns of RECORDS.

    A record that fails a check is an error that names its archive, and so are a broken frame and an archive with another
    number of records than the manifest says. With strict=False such a record, or what follows a broken frame, is a row
    with nothing but the error. With payloads=False payloads are checked but left null. Archives are dealt out to tasks by
    bytes, TASK_BYTES to a task where there are archives enough for all cores.
    """
    found = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = min(max(1, found.n), max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(found.bytes or 0) // TASK_BYTES)))
    shape = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(path: str, records: int) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as source:
            data = source.read()
        n = 0
        try:
            for raw in frames(data):
                n += 1
                try:
                    r = decode(raw)
                except ValueError as e:
                    if strict:
                        raise
                    yield (None,) * 7 + (str(e),)
                    continue
                kind = "response" if r.refers_to is None else "revisit"
                yield r.page_id, r.url, kind, r.payload if payloads else None, r.payload_bytes, r.payload_digest, r.refers_to, None
            if n != records:
                raise ValueError(f"{n} records instead of {records}")
        except (ValueError, zstandard.ZstdError) as e:
            if strict:
                raise ValueError(f"{path}, record {n}: {e}") from e
            yield (None,) * 7 + (str(e),)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for row in read(path, records):
                rows.append(row)
                size += 256 + len(row[3] or b"")
                if size >= BATCH_PAYLOADS:
                    yield _batch(rows, shape, names)
                    rows, size = [], 0
        yield _batch(rows, shape, names)

    return map_batches(manifest.select("path", "records").repartition(tasks), step, RECORDS)


def _batch(rows: list[tuple], shape: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape, strict=True)], names=names)


def round_trip(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write all pages into archives in the shared folder and read these back."""
    return read_archives(write_archives(mark_revisits(pages, min_bytes=min_bytes), fresh_path(spark, "warc")), payloads=payloads)
