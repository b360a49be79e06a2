"""WARC archives: writing pages, normalising monolithic gzip files, reading.

* ``write_archives``: one task writes one archive as a single gzip stream
  (the form this module's normaliser exists for).  Of records with equal
  payloads of at least ``MIN_REVISIT`` bytes, the one with the largest
  page_id is a response and the others revisit it without a payload.
* ``normalise``: inflates each archive once, front to back, rewrites every
  record as a gzip member of its own, and writes a sidecar index (one JSON
  line per record: offset, length, type, id, target).  Memory holds one
  record and one read buffer.
* ``read_records``: takes records by offset from the normalised archives.  The
  index rows are range-partitioned by (archive, offset), so a large archive
  is read by many tasks.

Files are written under names of their own per task attempt, and only those
that a finished task reported are read, so a lost executor leaves orphans but
no wrong result.  They go to the shared folder through ``pyarrow.fs`` (local
or shared mounts, HDFS with libhdfs, S3, GCS).

Defined cases: a null page is an empty payload; a null url becomes
``urn:page:<id>``; a null page_id is written as ``null`` and, if its payload
has an id'd twin, revisits it; repeated rows of the largest page_id are all
responses; no pages give no archives.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

MIN_REVISIT = 1000
READ = 1 << 20
SPLIT_BYTES = 64 << 20  # of archives, for one reading task
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
RECORD_DDL = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, archive string, offset long")


def file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record (uncompressed).  ``digest`` is hex; a record that
    refers to another carries the HTTP head only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def page_of(name: str | None):
    name = (name or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def inflate(stream):
    """Bytes of a gzip file as they come, through one or many members."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(READ):
        while chunk:
            yield z.decompress(chunk, READ)
            chunk = z.unconsumed_tail
            if z.eof:
                chunk = z.unused_data
                z = zlib.decompressobj(31)
    yield z.flush()


def records(stream):
    """(head, whole record) of every record of a gzip file, one at a time."""
    held = bytearray()
    parts = inflate(stream)

    def fill() -> bool:
        for p in parts:
            if p:
                held.extend(p)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("a WARC file ends within a record's head")
                return
        head = parse_head(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not fill():
                raise ValueError("a WARC file ends within a record")
        yield head, bytes(held[:size])
        del held[:size]


def _attempt() -> str:
    from pyspark import TaskContext
    t = TaskContext.get()
    return f"part-{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to); refers_to is null
    for responses.  Groups of equal payloads are pre-aggregated; a hot payload
    is split by the adaptive skew join."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     body.alias("payload"), F.octet_length(body).cast("long").alias("size"),
                     F.sha1(body).alias("digest"))
    top = (p.where(F.col("size") >= min_revisit).groupBy("digest", "size")
           .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
           .select(F.col("digest").alias("d"), F.col("size").alias("s"), "top"))
    return (p.join(top, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
            .select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                    "size", "digest", "refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 6, **cols) -> DataFrame:
    """Write the pages' records; returns (archive) - one monolithic gzip file
    per task.  Runs now (the files are written once)."""
    schema = pa.schema([("archive", pa.string())])

    def run(batches):
        fs, base = file_system(folder)
        out, z, path = None, None, None
        for batch in batches:
            for r in zip(*[batch.column(c) for c in range(6)]):
                page_id, url, payload, size, digest, refers_to = [x.as_py() for x in r]
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/{_attempt()}.warc.gz"
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(level, wbits=31)
                out.write(z.compress(record_bytes(page_id, url, payload or b"", size, digest, refers_to)))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], schema=schema)

    return cut(with_roles(pages, **cols).mapInArrow(run, "archive string"))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite gzip archives of any form record by record; returns (archive,
    sidecar, n_records, n_bytes).  Runs now."""
    schema = pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64()),
                        ("n_bytes", pa.int64())])

    def run(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                fs.create_dir(base, recursive=True)
                path = f"{base}/{_attempt()}.warc.gz"
                offset = n = 0
                with fs.open_input_stream(source, compression=None) as src, \
                        fs.open_output_stream(path, compression=None) as out, \
                        fs.open_output_stream(path + ".idx", compression=None) as index:
                    for head, raw in records(src):
                        z = zlib.compressobj(level, wbits=31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.write((json.dumps({
                            "offset": offset, "length": len(member), "type": head.get("warc-type"),
                            "id": head.get("warc-record-id"), "target": head.get("warc-target-uri")}) + "\n").encode())
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([path + ".idx"]), pa.array([n]), pa.array([offset])], schema=schema)

    spread = archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "archive")
    return cut(spread.mapInArrow(run, "archive string, sidecar string, n_records long, n_bytes long"))


def offsets(normal: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length) of every record, from the sidecars."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(sidecar, compression=None) as f:
                    rest = b""
                    while chunk := f.read(READ):
                        *lines, rest = (rest + chunk).split(b"\n")
                        rows = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(rows), pa.string()),
                             pa.array([r["offset"] for r in rows], pa.int64()),
                             pa.array([r["length"] for r in rows], pa.int64())], schema=schema)

    return normal.select("archive", "sidecar").mapInArrow(run, "archive string, offset long, length long")


def read_records(normal: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives (``RECORD_DDL``).  A response's
    digest is computed from the payload that was read and must equal the
    record's; a revisit has its head's digest and length, and no payload."""
    import hashlib
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
                        ("offset", pa.int64())])

    def one(raw: bytes, path: str, offset: int):
        end = raw.index(b"\r\n\r\n")
        head = parse_head(raw[:end])
        block = raw[end + 4: end + 4 + int(head["content-length"])]
        body = block.index(b"\r\n\r\n")
        http = parse_head(block[:body])
        stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        payload = None
        if head["warc-type"] == "response":
            payload = block[body + 4:]
            if hashlib.sha1(payload).hexdigest() != stated or len(payload) != int(http["content-length"]):
                raise ValueError(f"{path} at {offset}: the payload is not what the record states")
        return (page_of(head["warc-record-id"]), head["warc-target-uri"], payload, int(http["content-length"]),
                stated, head["warc-type"], page_of(head.get("warc-refers-to")), path, offset)

    def run(batches):
        fs, _ = file_system(folder)
        path, f = None, None
        for batch in batches:
            out, held = [], 0
            for p, offset, length in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                if p != path:
                    path, f = p, fs.open_input_file(p)
                raw = zlib.decompress(f.read_at(length, offset), 31)
                out.append(one(raw, p, offset))
                held += len(raw)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    # tasks by the bytes of the archives, not of their index
    total = normal.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(normal.sparkSession.sparkContext.defaultParallelism, -(-total // SPLIT_BYTES))
    where = offsets(normal, folder).repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return where.mapInArrow(run, RECORD_DDL)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; per page (page_id, payload_bytes,
    payload_digest, record_type, refers_to).  Archives stay only where a
    ``folder`` is given; else they are removed once the result is written."""
    own = folder is None
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    raw = write_archives(pages, f"{folder}/raw")
    normal = normalise(raw, f"{folder}/normal")
    out = read_records(normal, folder).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                              "refers_to")
    if own:
        out = cut(out)
        fs, path = file_system(folder)
        if raw.count():
            fs.delete_dir(path)
    return out
