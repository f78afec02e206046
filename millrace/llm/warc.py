"""WARC archives, index first: records are written with an index of file, offset, length, URL and digest; reading sorts the selected index rows and coalesces their byte ranges.

Writing: each task writes files of its own into the shared folder, one gzip member a record, and returns the index rows. Only files named in the committed index count, so what a lost or repeated
task has written is never read. Equal payloads are stored once: the record with the largest id is the response, the others revisit it.

Reading: index rows are dealt by file and stretch of the file over as many tasks as there are TASK bytes to read (and at least one for each core), sorted by offset; neighbouring ranges become one read of at most READ bytes, from which the members are cut. Every payload is checked against its digest.

Folders are reached by pyarrow.fs, which knows file, hdfs, s3 and gs addresses.

Defined cases: null html is an empty payload; a null url is written as an empty target; payloads below min_revisit_bytes are all responses; rows that repeat an id are written each, and with the
largest id of their payload are all responses. A null id never is a response that others refer to; if no equal payload has an id, the record is a response.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, shared_path, python_ready, table

FILE_BYTES, READ, GAP, STRETCH, TASK = 256 << 20, 8 << 20, 64 << 10, 16 << 20, 128 << 20
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
#: The header lines of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the HTTP body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archive and return its index."""
    spark = pages.sparkSession
    python_ready(spark)
    folder = folder or shared_path(spark, "warc")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    light = materialise(rows.select("_id", F.sha2(F.col("_html").cast("binary"), 256).alias("_k"), F.octet_length("_html").alias("_n")), "payloads")
    same = light.where(F.col("_n") >= min_revisit_bytes).groupBy("_k").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_c")).where("_c > 1 AND _top IS NOT NULL")
    revisits = light.where(F.col("_n") >= min_revisit_bytes).join(same, "_k").where(~F.col("_id").eqNullSafe(F.col("_top"))).select(F.col("_id").alias("_r"), F.col("_k").alias("_rk"), F.col("_top")).distinct()
    keyed = rows.withColumn("_k", F.sha2(F.col("_html").cast("binary"), 256))
    told = keyed.join(revisits, keyed["_id"].eqNullSafe(revisits["_r"]) & (keyed["_k"] == revisits["_rk"]), "left").select("_id", "_url", "_html", "_top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for i, u, text, top in zip(*(batch.column(c).to_pylist() for c in range(4))):
                payload = text.encode()
                digest = base32_sha1(payload)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record(i, u, payload, digest, len(payload), top, date)) + deflate.flush()
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                index.append((i, f"{folder}/{name}", at, len(member), u, digest, len(payload), "response" if top is None else "revisit", top))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialise(told.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records that the index rows name: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), payload empty for revisits."""
    python_ready(index.sparkSession)
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(-(-total // TASK), index.sparkSession.sparkContext.defaultParallelism)
    picked = index.select("file", "offset", "length").withColumn("_stretch", F.floor(F.col("offset") / STRETCH)).repartition(tasks, "file", "_stretch").sortWithinPartitions("file", "offset").drop("_stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None

        def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
            held: list[tuple[str, int, int]] = []
            for row in rows:
                if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > GAP or row[1] + row[2] - held[0][1] > READ):
                    yield held
                    held = []
                held.append(row)
            if held:
                yield held

        def number(field: str | None) -> int | None:
            text = (field or "").removeprefix("<urn:page:").removesuffix(">")
            return int(text) if text else None

        for batch in batches:
            for near in ranges(list(zip(*(batch.column(c).to_pylist() for c in range(3))))):
                if near[0][0] != opened:
                    fs, path = pafs.FileSystem.from_uri(near[0][0])
                    opened, source = near[0][0], fs.open_input_file(path)
                start = near[0][1]
                raw = source.read_at(near[-1][1] + near[-1][2] - start, start)
                out = []
                for _, offset, length in near:
                    fields, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                    if response and (base32_sha1(payload) != digest or len(payload) != int(fields["WARC-Payload-Length"])):
                        raise ValueError(f"{opened} at {offset}: the payload does not have its digest")
                    out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], None if response else number(fields["WARC-Refers-To"]), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return picked.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS d
  FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "pages"))
    return read(index).drop("url", "payload")
