"""WARC archives, compressed record by record with an embedded Zstandard dictionary.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame
per record. The dictionary is trained on a bounded, documented sample of the records about to be archived.
Tasks write to the shared folder; the table of finished archives is committed by Spark, so archives of lost or
repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, mapped, shared_folder, stored, table, text_or_empty

DICT_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record. A revisit states digest and length of the payload that it does not repeat."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body += b"\r\n"
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and payload of one record; the payload of a revisit is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Records of an open archive, one after the other; one record and one chunk are in memory."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no leading dictionary frame")
    raw = stream.read(n)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if n else None)
    one, out, buf = d.decompressobj(), [], b""
    while True:
        buf = buf or stream.read(chunk)
        if not buf:
            break
        out.append(one.decompress(buf))
        buf = b""
        if one.eof:
            buf = one.unused_data
            yield b"".join(out)
            one, out = d.decompressobj(), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_payload: int = 0, samples: int = 512, sample_chars: int = 16384,
                   dict_bytes: int = 112640, level: int = 3, archive_bytes: int = 64 << 20,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` and return the stored table (path, records) of archives.

    Of rows with equal payloads of at least ``min_payload`` bytes, the one with the smallest id is a response,
    the others revisit it. Null html is an empty payload; a null url is left out; a row with null id is a
    response unless its payload has a row with an id. Rows that repeat the smallest id are all responses.
    The dictionary sees ``samples`` rows (those of the smallest id hashes), ``sample_chars`` characters each.
    """
    # a cluster names a shared store; pyarrow opens file:, hdfs: (with libhdfs), s3: and gs: alike
    payload = text_or_empty(F.col(html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("n"))
    first = stored(rows.where(F.col("n") >= min_payload).groupBy("key", "n")
                   .agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
                   .select(F.col("key").alias("fkey"), "first"), "warc-first")
    marked = rows.join(first, (F.col("key") == F.col("fkey")) & (F.col("n") >= min_payload), "left").select(
        "id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))
    seen = hash_sample(rows.select("id", "url", "payload", F.xxhash64("id").alias("h")), "h", samples).select(
        "id", "url", F.substring("payload", 1, sample_chars).alias("payload"), "h").collect()
    trained = train([record(r["id"], r["url"], r["payload"].encode(), None, date)
                     for r in sorted(seen, key=lambda r: (r["h"], r["payload"]))], dict_bytes)

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        zdict = zstandard.ZstdCompressionDict(trained) if trained else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_checksum=True)
        out, path, count, done = None, "", 0, 0
        for b in batches:
            for i, url, text, ref in zip(*(b.column(c).to_pylist() for c in range(4))):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(path, compression=None)
                    out.write(struct.pack("<II", DICT_FRAME, len(trained)) + trained)
                    count = done = 0
                packed = zip_.compress(record(i, url, text.encode(), ref, date))
                out.write(packed)
                count, done = count + 1, done + len(packed)
                if done >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return stored(mapped(marked, write, "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str, batch_rows: int = 2048, most_tasks: int = 20_000) -> DataFrame:
    """Records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. The payload of
    each response is checked against its digest, and each archive against its number of records. There are as many
    tasks as archives, ``most_tasks`` at most."""

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in frames(f):
                        h, payload = parse(raw)
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} in {path} does not match its digest")
                        n = len(payload) if h["warc-type"] == "response" else int(h["x-payload-length"])
                        rows.append((page_of(h["warc-record-id"]), n, digest, h["warc-type"],
                                     page_of(h.get("warc-refers-to", "<urn:page:>"))))
                        seen += 1
                        if len(rows) >= batch_rows:
                            yield batch(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, not {records}")
                if rows:
                    yield batch(rows)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page_of(urn):
        return int(urn[10:-1]) if len(urn) > 11 else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    tasks = max(1, min(archives.count(), most_tasks))  # a number of its own, or adaptive execution joins the short rows of paths in one task
    return mapped(
        archives.repartition(tasks, "path"), read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, sha256(h) AS k FROM p),
f AS (SELECT k, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (k)
"""

QUERIES = {"op6_warc": (op6_warc, SQL)}
