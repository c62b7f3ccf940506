"""WARC archives with an index: write records, then read selected ones by byte range.

Method: index first. Each task appends its records to an archive of its own, one gzip member
a record, and returns offset, length, URL and digest of each; these rows, stored, are the
index. A reader sorts the index rows it selects by archive and offset, joins neighbouring
ranges to single reads and cuts the records out of these.

Archives of failed or repeated tasks are in no index row and so are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import durable, durable_root

# Smaller payloads are always stored.
REVISIT_BYTES = 1000
# An archive is closed at this size; reads join ranges up to a gap and a total size.
ARCHIVE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
    ]
)
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write one record for each row of ``pages``; returns the stored index.

    Of rows with equal payloads of at least ``revisit_bytes`` those with the largest id become
    responses, the others revisit records without a payload; smaller payloads are all
    responses. A null html is an empty payload, a null url leaves the field out, control
    characters in a url are percent-encoded in the archive. A null id counts as smaller than
    all others. Repeated rows each get a record; those with the largest id are all responses.
    Other columns are not looked at. ``folder`` must be reachable from all executors; by
    default it lies in the session's checkpoint folder. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    app = spark.sparkContext.applicationId
    folder = folder or f"{durable_root(spark)}/filingloom/{app}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    named = pages.select(
        F.coalesce(pages[id_col].cast("long"), F.lit(C.NULL_ID)).alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        html.alias("html"),
        F.sha1(html).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    leads = (
        named.where(F.col("size") >= revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("lead"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    planned = named.join(leads, ["digest", "size"], "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("lead") != F.col("page_id"), F.col("lead")).alias("lead")
    )
    return durable(planned.mapInArrow(lambda b: _write(b, folder), C.ddl(INDEX)), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, read back and checked against their digests.

    Select rows of the index first (by url, digest, type, ...); only their ranges are read.
    Without ``payloads`` that column is null. ``refers_to`` is the response's id of a revisit.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        index.select("archive", "offset", "length")
        .repartitionByRange(parts, "archive", "offset")
        .sortWithinPartitions("archive", "offset")
    )
    return ranged.mapInArrow(lambda b: _read(b, payloads), C.ddl(RECORDS))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _name(page_id: int) -> str:
    return f"<urn:x-page:{'null' if page_id == C.NULL_ID else page_id}>"


def _number(name: str) -> int:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return C.NULL_ID if text == "null" else int(text)


def _record(page_id: int, url: str | None, payload: bytes, digest: str, lead: int | None) -> bytes:
    block = HTTP_HEAD if lead is not None else HTTP_HEAD + payload
    fields = {
        "WARC-Type": "response" if lead is None else "revisit",
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": str(len(payload)),
    }
    if url is not None:
        # everything but white space and control characters stays as it is
        safe = "".join(c if c.isprintable() and not c.isspace() else quote(c) for c in url)
        fields["WARC-Target-URI"] = safe
    if lead is not None:
        fields["WARC-Refers-To"] = _name(lead)
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _write(batches, folder: str):
    system, path = _store(folder)
    system.create_dir(path, recursive=True)
    out, name, offset = None, "", 0
    try:
        for batch in batches:
            rows = []
            for page_id, url, html, digest, lead in zip(*batch.columns, strict=True):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                page, link, sha, first = page_id.as_py(), url.as_py(), digest.as_py(), lead.as_py()
                record = _record(page, link, html.as_py().encode(), sha, first)
                out.write(record)
                kind = "response" if first is None else "revisit"
                rows.append((f"{folder}/{name}", offset, len(record), page, link, sha, kind))
                offset += len(record)
            columns = list(zip(*rows, strict=True)) or [[]] * len(INDEX)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX
            )
    finally:
        if out is not None:
            out.close()


def _read(batches, payloads: bool):
    run: list[tuple[int, int]] = []
    archive, end = None, 0
    for batch in batches:
        for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near = name == archive and offset - end <= GAP_BYTES
            if run and not (near and offset + length - run[0][0] <= READ_BYTES):
                yield _records(archive, run, payloads)
                run = []
            archive, end = name, offset + length
            run.append((offset, length))
    if run:
        yield _records(archive, run, payloads)


def _records(archive: str, run: list[tuple[int, int]], payloads: bool) -> pa.RecordBatch:
    """One read for all records of a run of near ranges."""
    system, path = _store(archive)
    start = run[0][0]
    with system.open_input_file(path) as file:
        data = file.read_at(sum(run[-1]) - start, start)
    rows = [_parse(zlib.decompress(data[o - start : o - start + n], 31), payloads) for o, n in run]
    return pa.RecordBatch.from_pylist(rows, schema=RECORDS)


def _parse(record: bytes, payloads: bool) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    page = _number(fields["WARC-Record-ID"])
    lead = None if response else _number(fields["WARC-Refers-To"])
    return {
        "page_id": None if page == C.NULL_ID else page,
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": lead,
        "payload": payload if payloads and response else None,
    }
