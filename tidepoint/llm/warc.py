"""WARC archives, index first: every record's file, offset, length, URI and digest go to an index table;
reads take sorted byte ranges of the selected records, near ones joined into one read.

Writing: each task writes gzip members, one for each record, to archive files of its own under the
shared folder and yields the index rows. The index is what counts: it is committed by Spark's
writer, so files of failed or repeated attempts are never referred to. Of records with equal
payloads of at least `revisit_bytes` bytes the one with the largest page_id is a response, the
others are revisits that name it and carry no payload; smaller ones are responses.

Reading: index rows are range-partitioned by (file, offset); a task walks its rows in that order
and joins ranges that lie at most `gap` bytes apart, up to `span` bytes a read. A record longer
than that is read alone. Digests are verified on read.

Null html is an empty payload; a null url becomes `urn:page:<id>`, and other URIs have control
characters and spaces percent-encoded. Rows without page_id are responses, as are repeated
rows of the largest page_id of a payload. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import new_folder, stored, table

REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30
GAP, SPAN = 64 << 10, 2 << 20
BROADCAST_ROWS = 500_000  # about 30 MB
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
INDEX = (
    "file string, offset long, length long, uri string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string"
)
RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
# Fixed value: the profile that marks a revisit with an identical payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(file system, path) of a URI; s3a is the Hadoop name of s3."""
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record_bytes(page_id, uri: str, kind: str, refers_to, payload: bytes, digest: bytes, when: str) -> bytes:
    """One record as a gzip member. A revisit keeps the reply's head and the digest, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}')}>",
        f"WARC-Date: {when}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {IDENTICAL}", f"X-Refers-To-Page-ID: {refers_to}"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def parse_record(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    reply, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload digest differs: {fields['WARC-Record-ID']}")
    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page else None, "uri": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": int(refers) if refers else None, "payload_digest": digest.hex(),
        "payload_bytes": int(reply.decode().rsplit("Content-Length: ", 1)[1]),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, uri, payload, payload_digest (SHA-1, binary) and the record's type and target."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).alias("uri"),
        payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"),
    )
    # One row for each repeated payload; copies are counted where they are read, so a hot payload is one row a task.
    # Up to BROADCAST_ROWS such rows the payloads need no shuffle to meet them.
    kept = stored(pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= revisit_bytes).groupBy(
        F.unhex(F.sha1("payload")).alias("digest")
    ).agg(F.max(F.col("page_id").cast("long")).alias("refers_to"), F.count("page_id").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    rows = rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "digest", "left")
    again = F.octet_length("payload") >= revisit_bytes
    again = again & F.col("refers_to").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("refers_to"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("refers_to")))


def write(pages: DataFrame, folder: str, when: str = "2000-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives under `folder` and return the stored index."""
    def put(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            index = {k: [] for k in ("file", "offset", "length", "uri", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")}
            for r in batch.to_pylist():
                r["uri"] = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", r["uri"])
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(r["page_id"], r["uri"], r["record_type"], r["refers_to"], r["payload"], r["digest"], when)
                out.write(member)
                for k, v in (("file", name), ("offset", at), ("length", len(member)), ("payload_bytes", len(r["payload"])),
                             ("payload_digest", r["digest"].hex())):
                    index[k].append(v)
                for k in ("uri", "page_id", "record_type", "refers_to"):
                    index[k].append(r[k])
                at += len(member)
            yield pa.RecordBatch.from_pydict(index, schema)
        if out is not None:
            out.close()

    schema = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("uri", pa.string()), ("page_id", pa.int64()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])
    return stored(planned(pages, revisit_bytes).mapInArrow(put, INDEX), "warc-index")


def read(spark: SparkSession, index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that `index` selects, parsed (RECORD)."""
    def get(batches):
        system, root = file_system(folder)
        held, name = None, None

        def ranges():
            run = []
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if run and (r[0] != run[0][0] or r[1] - run[-1][1] - run[-1][2] > gap or r[1] + r[2] - run[0][1] > span):
                        yield run
                        run = []
                    run.append(r)
            if run:
                yield run

        for run in ranges():
            if run[0][0] != name:
                if held is not None:
                    held.close()
                name = run[0][0]
                held = system.open_input_file(f"{root}/{name}")
            start = run[0][1]
            data = held.read_at(run[-1][1] + run[-1][2] - start, start)
            rows = [parse_record(data[o - start : o - start + n]) for _, o, n in run]
            yield pa.RecordBatch.from_pylist(rows, schema)
        if held is not None:
            held.close()

    schema = pa.schema([
        ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(get, RECORD)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS owner FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""


@query("op8_warc", SQL)
def warc(spark, sf):
    folder = new_folder(spark, "warc")
    index = write(table(spark, sf, "pages"), folder)
    return read(spark, index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
