"""WARC: an index of the records first, then sorted byte-range reads of those wanted."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, staging_path
from .common import arrow_map

INDEX = ("file string, offset long, length long, url string, digest string, page_id long, record_type string")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url, payload: bytes, digest: str, refers_to, response: bool) -> bytes:
    """One WARC record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
              f"X-Payload-Length: {len(payload)}"]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if response else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _open(uri: str):
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: repeats point to the largest page id of their payload.

    A payload counts by length and SHA-1. Digests are summed up before they are shuffled, so a payload that a
    third of all pages share sends one row per task; the join back may be split by adaptive execution.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    repeats = (rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes")
               .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("copies"))
               .filter((F.col("copies") > 1) & F.col("newest").isNotNull()).drop("copies"))
    joined = rows.join(repeats, ["digest", "n_bytes"], "left")
    older = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "digest", F.when(older, F.col("newest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write one gzip member per record to ``.warc.gz`` files in ``folder``; the index of what was written.

    Each task opens files under names of its own, and the index names the files of the attempt that
    succeeded: a task run again writes anew and leaves no wrong rows. Files end after ``file_bytes``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(
                    *(batch.column(i).to_pylist() for i in (0, 1)),
                    batch.column(2).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (3, 4))):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                packed = _record(page_id, url, payload, digest, refers_to, refers_to is None)
                out.write(packed)
                rows.append((f"{folder}/{name}", at, len(packed), url, digest, page_id,
                             "response" if refers_to is None else "revisit"))
                at += len(packed)
                if at >= file_bytes:
                    out.close()
                    out = None
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 [part.split()[0] for part in INDEX.split(", ")])
        if out is not None:
            out.close()

    return arrow_map(records, run, INDEX)


def _parse(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, names in lower case, and its payload."""
    head, _, block = zlib.decompress(packed, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, block[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def read_ranges(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Read the records of ``index`` back: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Index rows are dealt out by file and offset and sorted; neighbours less than ``gap`` bytes apart are read
    together, up to ``most`` bytes at once. Length and SHA-1 of a response are taken from the payload itself and
    held against its headers; a revisit has them from its headers and no payload.
    """
    def slices(rows: list[tuple]) -> Iterator[tuple[int, bytes]]:
        store = handle = opened = None
        i = 0
        while i < len(rows):
            name, start, length, _ = rows[i]
            end, j = start + length, i + 1
            while j < len(rows) and rows[j][0] == name and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= most:
                end, j = max(end, rows[j][1] + rows[j][2]), j + 1
            if opened != name:
                store, path = _open(name)
                handle, opened = store.open_input_file(path), name
            run = handle.read_at(end - start, start)
            for k in range(i, j):
                yield rows[k][3], run[rows[k][1] - start:rows[k][1] - start + rows[k][2]]
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), range(batch.num_rows)))
            urls, found, held = batch.column(3).to_pylist(), [], 0
            for at, packed in slices(rows):
                fields, payload = _parse(packed)
                said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(fields["x-payload-length"])
                if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (said, size):
                    raise ValueError(f"record at {rows[at][:2]} does not match its digest")
                ids = [int(v) if (v := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page")]
                whole = payload.decode() if fields["warc-type"] == "response" else None
                found.append((ids[0], urls[at], whole, size, said, fields["warc-type"], ids[1]))
                held += size
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    dealt = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return arrow_map(dealt, run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long")


def archive(pages: DataFrame, least_bytes: int = 1000, file_bytes: int = 64 << 20) -> DataFrame:
    """Write all pages to archives in the shared folder and return their index, itself stored as Parquet.

    A null page is an empty payload. Among equal payloads of at least ``least_bytes``, rows with the largest
    page id are responses (repeated rows with that id all are) and the others revisit it; without any page id
    all are responses. A null page id or url stays null.
    """
    spark = pages.sparkSession
    folder = staging_path(spark, "warc")
    return stage(write_archives(with_revisits(pages, least_bytes), folder, file_bytes), "warc-index")
