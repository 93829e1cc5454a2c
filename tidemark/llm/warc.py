"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Writing. Payloads of at least MIN_REVISIT bytes that occur more than once are stored once, in the response record of the
smallest page_id; the others become revisit records with the payload's digest, its length (in the kept HTTP header) and
the response's id. Every task writes files of its own under names that no other attempt uses, and the manifest lists
only those of the attempts that Spark accepted, so a lost executor leaves at most files that nothing refers to.

Reading. Files are cut into byte ranges. A task looks for the gzip magic from the start of its range, takes a candidate
for a record only if it inflates to a WARC version line, then follows the records, each one starting where the last one
ended, as long as they start inside the range: the last one may end beyond it. So each record has one owner whatever the
ranges are. (UTF-8 payloads can't hold the magic, as 0x8B never follows 0x1F there.)

Defined results: a null html is an empty payload; a null url has no target header; a null page_id is read back as null
and never is what others refer to, unless all of its group are null: then all are responses; repeated rows of the
smallest page_id are all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage_table

MIN_REVISIT = 100
#: Bytes of a file after which a task begins another, and of a range that one task reads.
ROLL, SPLIT = 256 << 20, 8 << 20
#: Tasks of a read, at most: beyond, a task reads several ranges one after the other.
MAX_TASKS = 20_000
#: Up to so many repeated digests are broadcast (under 10 MB); more are joined by a salted shuffle.
BROADCAST_DIGESTS, SALTS = 50_000, 32
MAGIC = b"\x1f\x8b\x08"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI: local, S3, GCS, Azure (abfs, abfss) or HDFS, as Arrow has them; others are an
    error that names the URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    plain = re.sub(r"^s3[an]://", "s3://", uri)
    try:
        return pafs.FileSystem.from_uri(plain)
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for {uri}") from e


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    body = http
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """The fields of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = fields["WARC-Record-ID"][len(URN) + 1 : -1]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": None if page == "null" else int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind}
    if kind == "revisit":
        return out | {"payload_bytes": length, "payload_digest": digest, "refers_to": int(fields["WARC-Refers-To"][len(URN) + 1 : -1]), "payload": None}
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {page}: payload and header disagree")
    return out | {"payload_bytes": length, "payload_digest": digest, "refers_to": None, "payload": payload}


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the html itself is not shuffled unless repeated digests are very many."""
    html = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).alias("__n"))
    groups = marked.where(F.col("__n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    repeated = stage_table(groups.where("c > 1 and first is not null").select("digest", "first"), "repeated")
    if repeated.count() <= BROADCAST_DIGESTS:
        joined = marked.join(F.broadcast(repeated), "digest", "left")
    else:
        salted = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = marked.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = marked.join(salted, ["digest", "__salt"], "left")
    own = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", own.cast("long").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archive; the manifest (path, records, bytes), already written."""
    target = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        fs, base = file_system(target)
        fs.create_dir(base, recursive=True)
        out, name, done, size, n = None, "", [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(r["page_id"], r["url"], r["html"].encode("utf-8"), r["digest"], r["refers_to"])
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL:
                    out.close()
                    done, out = [*done, (f"{target}/{name}", n, size)], None
        if out is not None:
            out.close()
            done.append((f"{target}/{name}", n, size))
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return stage_table(plan_records(pages).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def records_in(f, start: int, end: int, size: int, chunk: int = 1 << 18):
    """Inflated records that start in [start, end) of an open file of this size."""
    at, buffer, base = start, b"", start  # buffer holds the bytes from base on

    def fill(upto: int) -> None:
        nonlocal buffer
        have = base + len(buffer)
        if upto > have:
            f.seek(have)
            buffer += f.read(min(size, max(upto, have + chunk)) - have)

    while at < end:
        buffer, base = buffer[at - base :], at
        fill(min(size, at + chunk))
        hit = buffer.find(MAGIC)
        if hit < 0:
            at = base + max(1, len(buffer) - 2)
            if base + len(buffer) >= size:
                return
            continue
        at = base + hit
        if at >= end:
            return
        z, got, pos, valid = zlib.decompressobj(31), [], at, True
        while not z.eof:
            fill(min(size, pos + chunk))
            part = buffer[pos - base : pos - base + chunk]
            if not part:
                valid = False
                break
            try:
                got.append(z.decompress(part))
            except zlib.error:
                valid = False
                break
            if not got[0] and len(got) == 1:
                got.pop()
            elif not got[0].startswith(b"WARC/1."[: len(got[0])]):
                valid = False
                break
            pos += len(part)
        data = b"".join(got)
        if not valid or not data.startswith(b"WARC/1."):
            at += 1
            continue
        at = pos - len(z.unused_data)
        yield data


def read_archive(manifest: DataFrame, payloads: bool = True, split: int = SPLIT) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if wanted, payload (null for revisits) of
    every record of the manifest's files."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    count = ranges.count()
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    types = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())))

    def batch(rows):
        return pa.record_batch([pa.array([r[k] for r in rows], types[k]) for k in names], names=names)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = file_system(r["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for data in records_in(f, r["start"], min(r["bytes"], r["start"] + split), r["bytes"]):
                        rows.append(parse(data))
                        held += len(data) if payloads else 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return ranges.repartition(max(1, min(count, MAX_TASKS)), "path", "start").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archive of the pages."""
    got = read_archive(write_archive(pages), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM q)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
