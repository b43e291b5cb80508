"""Web archives written from ``pages``, so that the scan has files to read."""

from __future__ import annotations

import gzip
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An archive holds about so many pages; there are at least LEAST archives.
PAGES = 500
LEAST = 4
# Bodies are read whole.
LIMIT = -1
_BREAK = b"\r\n"


def _record(kind: str, number: int, target: str, block: bytes, extra: str = "") -> bytes:
    media = "application/warc-fields" if kind == "warcinfo" else f"application/http; msgtype={kind}"
    head = (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}:{number}>\r\n"
        f"WARC-Date: 2023-09-21T09:47:51Z\r\nWARC-Target-URI: {target}\r\n{extra}"
        f"Content-Type: {media}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + 2 * _BREAK


def _page_records(number: int, url: str, html: str) -> list[bytes]:
    """Request and response of one page; form varies with its number."""
    body = html.encode()
    status = "404 Not Found" if number % 7 == 0 else "200 OK"
    coding = ""
    if number % 3 == 0:
        body, coding = gzip.compress(body, mtime=0), "Content-Encoding: gzip\r\n"
    elif number % 5 == 0:
        coding = "Content-Encoding: x-unknown\r\n"
    request = f"GET /{number} HTTP/1.1\r\nHost: ex\r\n\r\n".encode()
    response = f"HTTP/1.1 {status}\r\nContent-Type: text/html\r\n{coding}\r\n".encode() + body
    extra = "WARC-IP-Address: 10.0.0.1\r\n"
    if number % 2 == 0:
        extra += f"WARC-Concurrent-To: <urn:request:{number}>\r\n"
    return [
        _record("request", number, url, request),
        _record("response", number, url, response, extra),
    ]


def write(pages: DataFrame, folder: str) -> str:
    """One archive per task, as many as the pages need, alternately plain and zipped record by record."""
    files = max(LEAST, -(-pages.count() // PAGES))
    os.makedirs(folder, exist_ok=True)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        zipped = part % 2 == 0
        path = os.path.join(folder, f"part-{part:05d}.warc" + (".gz" if zipped else ""))
        n = 0
        with open(path, "wb") as out:
            def put(record: bytes) -> None:
                out.write(gzip.compress(record, mtime=0) if zipped else record)

            put(_record("warcinfo", part, "", b"software: demo\r\n"))
            for batch in batches:
                for row in batch.to_pylist():
                    for record in _page_records(row["page_id"], row["url"], row["html"]):
                        put(record)
                    n += 1
        yield pa.RecordBatch.from_pylist([{"n": n}], schema=pa.schema([("n", pa.int64())]))

    spread = pages.select("page_id", "url", "html").repartition(files, F.col("page_id"))
    spread.mapInArrow(write_part, "n bigint").agg(F.sum("n")).collect()
    return folder

# Python workers get the code of this module along with the task, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
