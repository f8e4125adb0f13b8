"""WARC archives: writing pages, turning monolithic gzip files into one member per record, reading through an index.

A monolithic archive is one gzip stream over all records: it can only be read from its start. The normaliser inflates
such a file once, as a stream, writes each record as a gzip member of its own and a sidecar index (offset, length and
headers of each record), so a record can be read alone and a file can be split.

Pages with equal payloads are stored once: the one with the largest id is the response, the others are revisits that
refer to it. Tasks open files by the URI of the shared folder; the manifest a stage writes commits its files, so files
of lost or repeated tasks are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.json
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import filesystem, shared_folder, slices, written

MANIFEST = "path string, records long, bytes long"
INDEXED = "path string, index string, records long, bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
PLAIN, MEMBERS = 1, 1      # compression levels of the two forms


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record of a page, or with refers_to a revisit record, which keeps the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header lines of a record by lower-case name."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if line)}


def parsed(raw: bytes) -> dict:
    """The columns of a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of a
    response; null for a revisit). A response whose payload doesn't have the digest it claims is an error."""
    head, block = raw.split(b"\r\n\r\n", 1)
    named = headers(head)
    block = block[:int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, v in (line.split(b":", 1) for line in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    claimed = named["warc-payload-digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := named.get(name, "<urn:page:None>")[10:-1]) != "None" else None
    if named["warc-type"] == "response" and (len(payload) != size or digest(payload) != claimed):
        raise ValueError(f"record {named['warc-record-id']} is damaged")
    return {"page_id": number("warc-record-id"), "url": named["warc-target-uri"], "payload_bytes": size, "payload_digest": claimed,
            "record_type": named["warc-type"], "refers_to": number("warc-refers-to"),
            "payload": payload if named["warc-type"] == "response" else None}


def records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The records of a gzip file given a function that reads up to n bytes: one stream or many members, each inflated
    once. Holds one record and a chunk."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need: int | None = None
    while True:
        raw = read(CHUNK)
        if not raw:
            break
        while raw:
            held += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if need is None and (end := held.find(b"\r\n\r\n", at)) >= 0:
                need = end + 8 + int(headers(bytes(held[at:end]))["content-length"]) - at
            if need is None or len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def member(raw: bytes, level: int = MEMBERS) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest id among pages with an equal payload of at least
    least_bytes bytes, null for that page itself and for payloads nobody shares."""
    page = F.col("page_id").cast("long")
    keyed = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
                         ).withColumn("_digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # payloads that several pages share; small or not, the planner knows its true size
    shared = written(keyed.filter(F.octet_length("html") >= least_bytes).groupBy("_digest")
                     .agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n")).filter("_n > 1 AND _largest IS NOT NULL"), "shared-payloads")
    refers = F.when((F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_largest")), F.col("_largest"))
    return keyed.join(shared.drop("_n"), "_digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) as archives of one gzip stream each, one per task; returns the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, count, size = None, 0, 0
        for batch in slices(batches, column="html"):
            if sink is None:
                fs, root = filesystem(folder)
                fs.create_dir(root)
                name = f"{uuid.uuid4().hex}.warc.gz"
                sink, squeeze = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(PLAIN, zlib.DEFLATED, 31)
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                raw = squeeze.compress(record(page, url, html.encode(), refers))
                sink.write(raw)
                count, size = count + 1, size + len(raw)
        if sink is not None:
            raw = squeeze.flush()
            sink.write(raw)
            sink.close()
            yield pa.record_batch([pa.array([x]) for x in (f"{folder}/{name}", count, size + len(raw))], names=["path", "records", "bytes"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST), "warc-plain")


def _per_file(manifest: DataFrame) -> DataFrame:
    """One task per file."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of a manifest (path) with one gzip member per record and a sidecar index beside it; returns
    the new manifest (path, index, records, bytes). The index has a JSON line per record: offset, length, id, type."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                (source_fs, source_path), (fs, root) = filesystem(path), filesystem(folder)
                fs.create_dir(root)
                stem, at, count = uuid.uuid4().hex, 0, 0
                with (source_fs.open_input_stream(source_path, compression=None) as source, fs.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as sink,
                      fs.open_output_stream(f"{root}/{stem}.index.jsonl") as index):
                    for raw in records(source.read):
                        named, packed = headers(raw.split(b"\r\n\r\n", 1)[0]), member(raw)
                        sink.write(packed)
                        index.write((json.dumps({"offset": at, "length": len(packed), "id": named["warc-record-id"], "type": named["warc-type"]}) + "\n").encode())
                        at, count = at + len(packed), count + 1
                yield pa.record_batch([pa.array([x]) for x in (f"{folder}/{stem}.warc.gz", f"{folder}/{stem}.index.jsonl", count, at)],
                                      names=["path", "index", "records", "bytes"])

    return written(_per_file(manifest.select("path")).mapInArrow(run, INDEXED), "warc-members")


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each read through its index entry: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (binary; null for revisits, or unless keep_payload)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                (fs, place), (_, index_place) = filesystem(path), filesystem(index)
                with fs.open_input_file(place) as source, fs.open_input_stream(index_place) as lines:
                    entries, rows, held = pa.json.read_json(lines).to_pylist() if fs.get_file_info(index_place).size else [], [], 0
                    for entry in entries:
                        row = parsed(zlib.decompress(source.read_at(entry["length"], entry["offset"]), 31))
                        held += len(row["payload"] or b"")
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row)
                        if held > 4 << 20 or entry is entries[-1]:
                            yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
                            rows, held = [], 0

    return _per_file(manifest.select("path", "index")).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives, normalise them and drop the monolithic files; returns the
    manifest of the normalised archives.

    html is stored as UTF-8, null as an empty payload; a null url as an empty target. Pages that repeat both id and
    payload are all responses if their id is the largest; a null id is below every other. Other columns are ignored."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    plain = write_monolithic(with_originals(pages, least_bytes), f"{folder}/plain")
    done = normalise(plain, f"{folder}/members")
    fs, root = filesystem(f"{folder}/plain")
    if fs.get_file_info(root).type.name == "Directory":
        fs.delete_dir(root)
    return done
