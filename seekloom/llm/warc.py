"""WARC archives whose records are compressed one by one with an embedded dictionary.

Writing: pages with equal payloads are found by their SHA-1; the one with the smallest
id is a ``response`` record, the others are ``revisit`` records that refer to it and
have no body. A task gathers records up to ``ARCHIVE_BYTES``, trains a Zstandard
dictionary on them, and writes an archive: the dictionary in a leading skippable
frame, then each record as a frame of its own. File names are new for each attempt;
only those that a finished task returned are in the manifest, so a retried or lost
task leaves no wrong archive behind.

Reading: each archive is one row of the manifest; its frames are read as a stream.

Defined cases: a null payload is empty; payloads smaller than ``least`` bytes are all
responses; of rows that share both payload and smallest id all are responses; a null id
sorts after all others; a null url has no target header; line ends in a url are
percent-encoded; archives whose records are too few or too small for a dictionary have
none; an empty table writes no archive; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Folder, remove, scratch, sized, table

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 6 << 20
SKIPPABLE = 0x184D2A5D
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(page: str | None) -> str:
    """A record's name; a missing id has one that no id gets."""
    return "<urn:x-page>" if page is None else f"<urn:x-page:{quote(page, safe='')}>"


def _page(name: str | None) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1]) if name and name != _id(None) else None


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records spread over the archive; what they hold is bounded."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def write_archive(path: str, records: list[bytes]) -> tuple[int, int]:
    """Bytes of the archive and of its dictionary."""
    trained = _dictionary(records)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained else zstandard.ZstdCompressor(level=LEVEL)
    raw = trained.as_bytes() if trained else b""
    store, name = fs.FileSystem.from_uri(path)
    size = 0
    with store.open_output_stream(name, compression=None) as out:
        if raw:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
            size += out.write(struct.pack("<II", SKIPPABLE, len(packed))) + out.write(packed)
        for r in records:
            size += out.write(compressor.compress(r))
    return size, len(raw)


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one record in memory at a time."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as source:
        start = source.read(8)
        decompressor, rest = zstandard.ZstdDecompressor(), start
        if len(start) == 8 and struct.unpack("<II", start)[0] == SKIPPABLE:
            raw = zstandard.ZstdDecompressor().decompress(source.read(struct.unpack("<II", start)[1]))
            decompressor, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
        buffer = bytearray()
        with decompressor.stream_reader(_Joined(rest, source), read_across_frames=True) as plain:

            def fill(n: int) -> bool:
                while len(buffer) < n:
                    more = plain.read(max(1 << 16, n - len(buffer)))
                    if not more:
                        return False
                    buffer.extend(more)
                return True

            while True:
                at = buffer.find(b"\r\n\r\n")
                while at < 0 and fill(len(buffer) + 1):
                    at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    if buffer:
                        raise ValueError(f"{path} ends within a record")
                    return
                lines = bytes(buffer[:at]).decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines[1:])
                length = int(headers["Content-Length"])
                del buffer[: at + 4]
                if not fill(length + 4):
                    raise ValueError(f"{path} ends within a record")
                block = bytes(buffer[:length])
                del buffer[: length + 4]
                yield headers, block


class _Joined:
    """A readable that gives ``first`` before what ``then`` has."""

    def __init__(self, first: bytes, then) -> None:
        self._first, self._then = first, then

    def read(self, n: int = -1) -> bytes:
        if self._first:
            first, self._first = self._first, b""
            return first
        return self._then.read(n)


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archive ``page_id, url, html`` below ``folder``; the manifest: ``path, records, bytes, dictionary_bytes``."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = sized(again.where("n > 1").select(F.col("digest").alias("__digest"), "first"))
    # ``again`` has each digest once, so a digest that a third of the rows share adds no row; beyond a
    # broadcast's size, adaptive execution splits that digest's partition.
    joined = rows.join(again, (F.col("digest") == F.col("__digest")) & (F.octet_length("payload") >= least), "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"), later.alias("revisit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(records: list[bytes]) -> pd.DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            size, dictionary = write_archive(path, records)
            return pd.DataFrame({"path": [path], "records": [len(records)], "bytes": [size], "dictionary_bytes": [dictionary]})

        records, size = [], 0
        for batch in batches:
            for page, url, body, digest, first, revisit in batch.itertuples(index=False, name=None):
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                records.append(record(page, url, bytes(body), base32, first, bool(revisit)))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield done(records)
                    records, size = [], 0
        if records:
            yield done(records)

    store, name = fs.FileSystem.from_uri(folder)
    store.create_dir(name, recursive=True)
    return Folder(pages.sparkSession, "manifest").cut(ready.mapInPandas(run, "path string, records long, bytes long, dictionary_bytes long"))


def read(manifest: DataFrame, key: str = "bigint") -> DataFrame:
    """A row per record of the manifest's archives.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``, ids of the type ``key``; a response's
    length and digest are computed from its body, and a wrong digest is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for headers, block in read_archive(path):
                    revisit = headers["WARC-Type"] == "revisit"
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if not revisit and (size != len(body) or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"a record of {path} has another payload than its digest")
                    page, first = (_page(headers.get(k)) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((page, headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], first))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    archives = max(1, manifest.count())
    spread = manifest.select("path").repartition(min(archives, 20_000), "path")
    made = spread.mapInPandas(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return made.withColumn("page_id", F.col("page_id").cast(key)).withColumn("refers_to", F.col("refers_to").cast(key))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    manifest = write(pages, folder)
    made = Folder(spark, "records").cut(read(manifest, pages.schema["page_id"].dataType.simpleString()).drop("url"))
    remove(spark, folder)
    return made


SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    (((CAST('0x' || substr(hex || '0', CAST(i * 5 // 4 AS INTEGER) + 1, 1) AS INTEGER) * 16 + CAST('0x' || substr(hex || '0', CAST(i * 5 // 4 AS INTEGER) + 2, 1) AS INTEGER))
      >> (3 - (i * 5) % 4)::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (hex)"""
}
QUERIES = {"op4_warc": op4_warc}
