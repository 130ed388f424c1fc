"""WARC archives: a normaliser for monolithic gzip, a writer and an indexed reader.

A monolithic archive is one gzip stream over the whole file, so that nothing in it can be reached without inflating
all before it. The normaliser inflates the stream once, in blocks, rewrites every record as a gzip member of its own
and writes a sidecar index (offset, length, type and id of each record) next to it. The reader seeks by the index.

Files are written under names of their own for each attempt, and only the manifest that Spark commits names the ones
that count: a lost executor leaves at most a file that nothing reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import new_path, written

BLOCK = 1 << 20
LEVEL = 4
MEMBER = 31  # zlib's window bits for gzip
ARCHIVE_BYTES = 128 << 20
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(uri: str):
    """(filesystem, path) of a URI that pyarrow knows (file, hdfs, s3, gs), or of an absolute local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One uncompressed record: a response with its payload, or (payload None) a revisit that refers to one."""
    block = HTTP + (payload if payload is not None else b"")
    where = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or f"urn:page:{page_id}"
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", where),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", size),
        ("X-Page-Id", "" if page_id is None else page_id),
    ]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", "" if refers_to is None else refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(read) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, block by block; a stream that breaks off is an error."""
    stream, fresh = zlib.decompressobj(MEMBER), True
    while data := read(BLOCK):
        while data:
            out = stream.decompress(data, BLOCK)
            fresh = False
            if out:
                yield out
            if stream.eof:
                data, stream, fresh = stream.unused_data.lstrip(b"\0"), zlib.decompressobj(MEMBER), True
            else:
                data = stream.unconsumed_tail
                if not data and len(out) < BLOCK:
                    break
    if not fresh:
        if tail := stream.flush():
            yield tail
        if not stream.eof:
            raise EOFError("the gzip stream breaks off")


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed archive, each whole with its two line ends."""
    have = bytearray()
    for block in blocks:
        have += block
        while True:
            end = have.find(b"\r\n\r\n")
            if end < 0:
                break
            size = end + 4 + int(parse_head(bytes(have[:end]))["content-length"]) + 4
            if len(have) < size:
                break
            yield bytes(have[:size])
            del have[:size]
    if have.strip():
        raise EOFError("the archive ends inside a record")


def normalise(source: str, target: str) -> int:
    """Rewrites the archive at source (any gzip) as one member a record at target, with target.idx; returns the count."""
    fs, path = _open(source)
    out_fs, out_path = _open(target)
    offset, index = 0, []
    with fs.open_input_file(path) as f, out_fs.open_output_stream(out_path, compression=None) as out:
        for rec in split_records(inflate(f.read)):
            head = parse_head(rec[: rec.find(b"\r\n\r\n")])
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, MEMBER)
            member = packer.compress(rec) + packer.flush()
            out.write(member)
            index.append(json.dumps({"offset": offset, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id")}))
            offset += len(member)
    with out_fs.open_output_stream(f"{out_path}.idx", compression=None) as out:
        out.write("".join(f"{x}\n" for x in index).encode())
    return len(index)


def indexed_records(archive: str) -> Iterator[bytes]:
    """The records of a normalised archive, each reached by its offset."""
    fs, path = _open(archive)
    with fs.open_input_file(f"{path}.idx") as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    with fs.open_input_file(path) as f:
        for entry in index:
            f.seek(entry["offset"])
            yield zlib.decompress(f.read(entry["length"]), MEMBER)


def decided(pages: DataFrame) -> DataFrame:
    """pages as page_id, url, payload (binary), size, digest, refers_to (null: a response).

    Of equal payloads of REVISIT_BYTES at least, the largest page_id is the response. Groups are reduced to their
    largest id before they are joined to the pages, and only groups of several ids are; Spark splits a hot payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").drop("n"), "warc-groups")
    out = rows.join(groups, ["digest", "size"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "size", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A manifest (path, records) of the monolithic archives that hold the rows of decided(); about archive_bytes of records each."""

    def run(batches):
        out = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for page_id, url, payload, size, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    fs, root = _open(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, count, total = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, MEMBER), 0, 0
                rec = record(page_id, url, payload if refers_to is None else None, digest, size, refers_to)
                out.write(packer.compress(rec))
                count, total = count + 1, total + len(rec)
                if total >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})

    return written(records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "path string, records long"), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """The manifest with about one archive a task; it has a short row for each archive."""
    return manifest.repartition(max(1, min(10_000, manifest.count())))


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A manifest (path, records) of the normalised copies of the archives of a manifest."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                fs, root = _open(folder)
                fs.create_dir(root, recursive=True)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                yield pa.RecordBatch.from_pydict({"path": [target], "records": [normalise(source, target)]})

    return written(_spread(manifest.select("path")).mapInArrow(run, "path string, records long"), "warc-normalised")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of normalised archives.

    A response's size and digest are taken from the payload read back, and must be those its head states.
    """

    def parsed(rec: bytes) -> tuple:
        end = rec.find(b"\r\n\r\n")
        head = parse_head(rec[:end])
        number = lambda name: int(head[name]) if head.get(name) else None
        size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            payload = rec[end + 4 + len(HTTP) : -4]
            if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"record {head['warc-record-id']} doesn't hold the payload that it states")
        return number("x-page-id"), head["warc-target-uri"], size, digest, head["warc-type"], number("x-refers-to-page-id")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for rec in indexed_records(path):
                    rows.append(parsed(rec))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _spread(manifest.select("path")).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages through monolithic archives, the normaliser and the indexed reader.

    Null html is an empty payload, a null or odd URL is encoded; a null page_id never is the response of a group that
    has an id. Repeated rows are records of their own. An empty table writes nothing and reads nothing back.
    """
    spark = pages.sparkSession
    mono, members = new_path(spark, "warc-mono"), new_path(spark, "warc-members")
    manifest = write_archives(decided(pages), mono)
    return read_archives(normalise_archives(manifest, members))
