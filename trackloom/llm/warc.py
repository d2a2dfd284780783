"""Deterministic sharded WARC writer and reader.

Pages are cut into shards by ranges of their id. The ranges depend only on the data (the id span and the
total payload size), each shard is sorted and written by one task, and its files are rolled by compressed
size, so any cluster writes the same bytes under the same names. Record headers, ids and digests are
generated anew; of pages with equal payloads the one of least id is a response and the others revisit it.

A file is written under a temporary name of its task attempt and renamed when complete; the renamed
file's name, size and digest become a manifest row, and the manifest, itself written by Spark and
committed at its end, names the files that count. A lost or repeated attempt leaves at most an
unnamed temporary file or renames the same bytes again.

Defined results: a null payload is empty; a null URL is written as ``urn:page:<id>`` and read back as
null; rows with a null id come first, in a shard of their own, and read back as null; of repeated rows
with one id and payload one is the response and the others revisit it; an empty table gives an empty
manifest and no files. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

#: Payload bytes of a shard, compressed bytes at which a file is rolled, and the records' fixed date.
SHARD_BYTES = 32 * 2**20
ROLL_BYTES = 16 * 2**20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("7d2f6f5a-58a5-4f0e-9e0c-6f3f3f0d8f11")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, serial: int) -> str:
    """The same for the same page on any run; serial tells repeated ids apart."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{serial}')}>"


def build_record(page_id: int | None, serial: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = url if url is not None else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, serial)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 0)}", f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; a plain path is local."""
    if "://" not in uri and ":" in uri.split("/")[0]:
        uri = uri.replace(":", "://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _File:
    """One archive file: written under a temporary name, renamed by close()."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str) -> None:
        self.store, self.name = store, name
        self.temporary, self.final = f"{folder}/_temporary/{name}.{uuid.uuid4().hex}", f"{folder}/{name}"
        self.stream = store.open_output_stream(self.temporary)
        self.bytes = self.records = 0
        self.digest = hashlib.sha256()

    def add(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        self.store.move(self.temporary, self.final)
        return {"file": self.name, "bytes": self.bytes, "records": self.records, "sha256": self.digest.hexdigest()}


MANIFEST = "file string, bytes long, records long, sha256 string"
_MANIFEST = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def _write_shards(folder: str, roll_bytes: int, least_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        store.create_dir(f"{path}/_temporary", recursive=True)
        shard, roll, file, last, serial, firsts, led = object(), 0, None, object(), -1, {}, set()
        for b in batches:
            done = []
            rows = zip(*(b[c].to_pylist() for c in ("shard", "page_id", "part", "url", "html", "body", "first_id")))
            for s, page, part, url, html, body, first_id in rows:
                if page != last:
                    last, serial, firsts, led = page, -1, {}, set()
                if part == 0:  # what the page's payloads refer to
                    firsts[body] = first_id
                    continue
                if s != shard or file is None or file.bytes >= roll_bytes:
                    if file is not None:
                        done.append(file.close())
                    roll = roll + 1 if s == shard else 0
                    shard = s
                    file = _File(store, path, f"pages-{s + 1:09d}-{roll:05d}.warc.gz")
                serial += 1
                payload = (html or "").encode()
                own = hashlib.sha256(payload).digest()
                first = firsts[own]
                lead = len(payload) < least_bytes or (first == page and own not in led)
                led.add(own)
                file.add(build_record(page, serial, url, payload, sha1_base32(payload), first, not lead))
            if done:
                yield pa.RecordBatch.from_pylist(done, _MANIFEST)
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], _MANIFEST)

    return run


def first_of_equals(pages: DataFrame) -> DataFrame:
    """(page_id, body, first_id): for each page and payload digest the least id that has it; no payloads."""
    rows = pages.select("page_id", _body().alias("body")).distinct()
    return rows.join(rows.groupBy("body").agg(F.min("page_id").alias("first_id")), "body")


def _body() -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per page below ``folder`` and return the committed manifest."""
    spark = pages.sparkSession
    span = pages.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum(F.octet_length(F.coalesce("html", F.lit(""))).cast("long")).alias("size")).first()
    lo, hi, size = span["lo"] or 0, span["hi"] or 0, span["size"] or 0
    shards = max(1, -(-size // shard_bytes))
    width = max(1, -(-(hi - lo + 1) // shards))
    shard = F.coalesce(F.floor((F.col("page_id") - lo) / F.lit(width)), F.lit(-1)).cast("long").alias("shard")
    # payloads are shuffled once: the small table of firsts comes to the same shard, ahead of its page
    firsts = first_of_equals(pages).select(shard, "page_id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "body", "first_id")
    texts = pages.select(shard, "page_id", F.lit(1).alias("part"), "url", "html", F.lit(None).cast("binary").alias("body"), F.lit(None).cast("long").alias("first_id"))
    rows = firsts.union(texts).repartitionByRange("shard").sortWithinPartitions("shard", "page_id", "part", "url", "html")
    rows.mapInArrow(_write_shards(folder, roll_bytes, least_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip stream, one record in memory at a time."""
    plain = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while True:
        line = plain.readline()
        if not line:
            return
        if not line.strip():
            continue
        head: dict[str, str] = {}
        for line in iter(plain.readline, b"\r\n"):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        yield head, plain.read(int(head["Content-Length"]))


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files that the manifest names, one task per file; digests are computed again."""

    def parse(head: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        revisit = head["WARC-Type"] == "revisit"
        stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
        digest = stated if revisit else sha1_base32(payload)
        size = int(fields["Content-Length"])
        number = lambda k: int(head[k]) if head.get(k) else None
        url = head["WARC-Target-URI"]
        return {
            "page_id": number("WARC-Page-ID"), "url": None if url.startswith("urn:page:") else url, "payload_bytes": size if revisit else len(payload),
            "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"),
            "intact": digest == stated and (revisit or size == len(payload)) and head["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}",
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        for b in batches:
            for name in b["file"].to_pylist():
                held = []
                with store.open_input_file(f"{path}/{name}") as f:
                    for head, block in _members(f):
                        held.append(parse(head, block))
                        if len(held) == 2000:
                            yield pa.RecordBatch.from_pylist(held, _RECORDS)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORDS)

    return manifest.select("file").repartition("file").mapInArrow(run, RECORDS)
