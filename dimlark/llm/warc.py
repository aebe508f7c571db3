"""WARC archives: a writer with revisit records and a splittable reader.

An archive holds one gzip member for each record. The reader needs no index: each task gets a
byte range of a file, scans it for the gzip magic, takes a place for a record's start only if
the bytes from there decode to a WARC header with a length, and owns the records that start
inside its range, reading past its end where the last one does. One record is held at a time.

Archives lie in the shared folder, or anywhere that ``pyarrow.fs`` can open. A task writes to
a name of its own and renames the file when it is whole, so a task that is run again replaces
its file. Files and byte ranges are rows of a table and never gathered on the driver.

Cases: a null payload is an empty one. Of records with equal payloads of ``min_bytes`` or more,
that with the smallest id is the response, and rows that repeat this id are responses too; the
others revisit it. Rows with a null id revisit it as well, or are responses when no row of that
payload has an id. A null or unprintable URL is left out or percent-encoded. Headers may be of
any length: what begins like a WARC record is decoded up to its blank line.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_folder, table, written

MAGIC = b"\x1f\x8b\x08"
#: zlib's number for one gzip member with the largest window
GZIP = 31
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str):
    """The file system of a URI, and the path on it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c not in "% " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, *, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row; ``(path, length)`` of each archive file."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"),
        col(url_col).cast("string").alias("url"),
        F.coalesce(col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = written(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-first")
    planned = rows.join(first, "digest", "left").select("page_id", "url", "payload", "first", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("later"))
    planned = planned.withColumn("revisit", F.col("first").isNotNull() & F.col("later")).drop("later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        name = f"{at}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, length = f"{name}.{uuid.uuid4().hex}.open", 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                page_id, url, payload, before, again = batch.columns
                for i in range(batch.num_rows):
                    length += out.write(record(page_id[i].as_py(), url[i].as_py(), payload[i].as_py(), before[i].as_py(), again[i].as_py()))
        if length:
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "length": [length]})
        else:
            system.delete_file(draft)

    return written(planned.mapInArrow(run, "path string, length long"), "warc-files")


def archives(spark: SparkSession, uri: str) -> DataFrame:
    """``(path, length)`` of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(uri).select("path", "length")


def header_at(source, place: int) -> tuple[dict[str, str], zlib._Decompress, bytes, int] | None:
    """The header of the record that starts at ``place``; the decoder, what it gave after it, and how far it read.

    None if the bytes there are no gzip member, or the member is no WARC record.
    """
    decoder, out, at, looked = zlib.decompressobj(GZIP), bytearray(), place, 0
    try:
        while out.find(b"\r\n\r\n", looked) < 0:
            looked = max(0, len(out) - 3)
            source.seek(at)
            piece = source.read(CHUNK)
            if not piece or decoder.eof:
                return None
            out += decoder.decompress(piece)
            at += len(piece)
            if not b"WARC/1."[: len(out)] == out[:7]:
                return None
    except zlib.error:
        return None
    out = bytes(out)
    top, _, rest = out.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return (fields, decoder, rest, at) if fields.get("content-length", "").isdigit() else None


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record that starts in [start, end)."""
    place = start
    while place < end:
        source.seek(place)
        window = source.read(min(CHUNK, end - place + len(MAGIC) - 1))
        found = window.find(MAGIC)
        if found < 0:
            place += max(1, len(window) - len(MAGIC) + 1)
            continue
        place += found
        if place >= end:
            return
        opened = header_at(source, place)
        if not opened:
            place += 1
            continue
        fields, decoder, block, at = opened
        parts = [block]
        try:
            while not decoder.eof and at < size:
                source.seek(at)
                piece = source.read(CHUNK)
                at += len(piece)
                parts.append(decoder.decompress(piece))
        except zlib.error:
            decoder = None
        if decoder is None or not decoder.eof:  # broken off: look on behind its start
            place += 1
            continue
        place = at - len(decoder.unused_data)
        yield fields, b"".join(parts)[: int(fields["content-length"])]


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD_SCHEMA."""
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    kind = fields.get("warc-type")
    if kind == "revisit":
        told = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        length, digest, payload = int(told[0]) if told and told[0].isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    else:
        length, digest = len(payload), digest_of(payload)
    return number("x-page-id"), fields.get("warc-target-uri"), length, digest, kind, number("x-refers-to-page-id"), payload


def read(files: DataFrame, *, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """The records of ``files(path, length)``, in tasks of ``split_bytes``; columns of RECORD_SCHEMA."""
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.partition(" ")[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path, size, start in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                system, at = file_system(path)
                rows, held = [], 0
                with system.open_input_file(at) as source:
                    for fields, block in records_in(source, size, start, min(size, start + split_bytes)):
                        row = parsed(fields, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(block) if with_payload else 100
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.repartition(int(tasks), "path", "start").mapInArrow(run, RECORD_SCHEMA)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages"))
    return read(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
