"""WARC archives, index first: write records and their index, then read selected records by ranges.

Every record is a gzip member of its own, so (file, offset, length) is enough to read it back. A task
writes files named after its attempt and returns index rows for exactly these bytes; the index is a
Parquet table, committed by Spark, so a lost or repeated task can only leave a file that no index row
names. Reading deals the selected index rows out by (file, slice of offsets), sorts them and joins
neighbouring ranges into one read.

Defined cases: null html is an empty payload; pages of equal payloads refer to the smallest page_id
among them, whose own rows (all of them, if repeated) are responses, also when the payload is empty;
a null page_id refers to that of its payload, or is a response if no row of the payload has an id; a
null url leaves the target out; an empty table writes and reads nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import hot_join, scratch, ship, written

FILE_BYTES = 1 << 28           # a file is closed once it is larger
SLICE_BYTES = 1 << 25          # index rows of one slice of a file are read by one task
GAP_BYTES = 1 << 16            # ranges nearer than this are read together
READ_BYTES = 1 << 23           # and at most so many bytes at once, or one record
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url if page_id is None else ""}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """An uncompressed record and its payload digest."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, url), "WARC-Date": WARC_DATE,
            "WARC-Target-URI": None if url is None else "".join(url.split()), "WARC-Payload-Digest": f"sha1:{digest}",
            "Content-Type": "application/http; msgtype=response", "X-Page-Id": page_id, "X-Payload-Length": len(payload)}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, None), "X-Refers-To-Page-Id": refers_to}
    lines = [f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items() if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """Columns of RECORD from an uncompressed record; a payload that misses its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    field = dict(line.split(": ", 1) for line in lines)
    payload = rest[:int(field["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload and digest differ in {field['WARC-Record-ID']}")
    number = lambda name: int(field[name]) if name in field else None
    return number("X-Page-Id"), field.get("WARC-Target-URI"), int(field["X-Payload-Length"]), digest, field["WARC-Type"], number("X-Refers-To-Page-Id"), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page below ``folder`` (any store pyarrow opens) and return the written index."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).alias("n_bytes"))
    firsts = written(rows.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "digests")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    known = hot_join(rows, firsts, ["sha1", "n_bytes"], "n", total)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            made: tuple[list, ...] = ([], [], [], [], [], [])
            for page, url, text, ref in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is None or offset > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data, digest = record(page, url, text.as_py().encode(), ref)
                packed = gzip.compress(data, 6, mtime=0)
                out.write(packed)
                for column, value in zip(made, (page, url, digest, name, offset, len(packed))):
                    column.append(value)
                offset += len(packed)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                  names=["page_id", "url", "digest", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(known.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Read the records of the given index rows, neighbouring ranges at once."""
    ship(index.sparkSession)
    tasks = max(1, math.ceil((index.agg(F.sum("length")).first()[0] or 0) / SLICE_BYTES), min(64, index.sparkSession.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        source, name = None, None

        def fetch(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal source, name
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name = run[0][0]
                source = fs.open_input_file(f"{path}/{name}")
            start = run[0][1]
            data = source.read_at(run[-1][1] + run[-1][2] - start, start)
            found = [parse(gzip.decompress(data[offset - start:offset - start + length])) for _, offset, length in run]
            columns = list(zip(*found))
            if not payload:
                columns[6] = [None] * len(found)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                end = run[-1][1] + run[-1][2] if run else 0
                if run and (at[0] != run[0][0] or at[1] - end > GAP_BYTES or at[1] + at[2] - run[0][1] > READ_BYTES):
                    yield fetch(run)
                    run = []
                run.append(at)
        if run:
            yield fetch(run)
        if source is not None:
            source.close()

    chosen = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / SLICE_BYTES)).sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(read, RECORD)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages below the shared folder and read every record back, without payloads."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, payload=False).drop("payload")
