"""Web archive scan.

``spark.read.format("warc")`` reads files and folders, one partition per file;
:func:`scan` reads a table of paths, in byte ranges if asked to, and :func:`store` keeps
what such a scan of large files returns.  The reader of one file is the only per-record
Python of the package.  It keeps one record in memory, bounded by the content limit,
and hands on what only a sequential reader knows without a shuffle: where the record
ends and which request came before it.
"""

from __future__ import annotations

import glob
import gzip
import os
import sys
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitestance import config

REQUEST_TYPE = "struct<record_id:string,target:string,http_block:string>"
SCHEMA = (
    "file string, offset bigint, length bigint, file_size bigint, type string, "
    "record_id string, concurrent_to array<string>, target string, date timestamp, "
    "ip string, media_type string, http_status int, "
    "headers array<struct<name:string,value:string>>, http_block string, "
    f"preceding_request {REQUEST_TYPE}, truncated string, content binary, "
    "full_length bigint, decode_status string, error string"
)
_COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("file_size", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("target", pa.string()),
        ("date", pa.timestamp("us", tz="UTC")), ("ip", pa.string()),
        ("media_type", pa.string()), ("http_status", pa.int32()),
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("http_block", pa.string()),
        ("preceding_request", pa.struct(
            [("record_id", pa.string()), ("target", pa.string()), ("http_block", pa.string())]
        )),
        ("truncated", pa.string()), ("content", pa.binary()), ("full_length", pa.int64()),
        ("decode_status", pa.string()), ("error", pa.string()),
    ]
)
_PIECE = 1 << 16
_DEFAULT_LIMIT = config.CONTENT_LIMIT
_HEAD_LIMIT = 1 << 20
# Bytes after the start of a gzip member that show whether a record starts in it.
_LOOK = 1 << 12
SPLIT_BYTES = 128 << 20

_ZIPPED = b"\x1f\x8b"


class _Stream:
    """Bytes of an archive, plain or gzip, with the file offset of the next record.

    A gzip member is entered only when the one before is used up, so the offset at a
    record start is the offset of its member.
    """

    def __init__(self, handle, start: int = 0):
        self._handle = handle
        self._raw = b""
        self._raw_end = start
        self._buffer = b""
        self._inflater = None
        self._more()
        self.zipped = self._raw[:2] == _ZIPPED
        self.member = start

    def _more(self) -> bool:
        piece = self._handle.read(_PIECE)
        self._raw += piece
        self._raw_end += len(piece)
        return bool(piece)

    def _fill(self) -> bool:
        """Add bytes to the buffer; False at the end of the file."""
        if not self.zipped:
            if not self._raw and not self._more():
                return False
            self._buffer, self._raw = self._buffer + self._raw, b""
            return True
        while True:
            if not self._raw and not self._more():
                if self._inflater is not None:
                    raise EOFError("archive ends inside a gzip member")
                return False
            if self._inflater is None:
                self.member = self._raw_end - len(self._raw)
                self._inflater = zlib.decompressobj(31)
            out = self._inflater.decompress(self._raw, _PIECE)
            if self._inflater.eof:
                self._raw = self._inflater.unused_data
                self._inflater = None
            else:
                self._raw = self._inflater.unconsumed_tail
            if out:
                self._buffer += out
                return True

    def at_end(self) -> bool:
        return not self._buffer and not self._fill()

    def offset(self) -> int:
        """File offset of the next byte (of its member, when zipped)."""
        if self.zipped:
            return self.member if not self.at_end() else self._raw_end
        return self._raw_end - len(self._raw) - len(self._buffer)

    def line(self) -> bytes:
        while b"\n" not in self._buffer:
            if len(self._buffer) > _HEAD_LIMIT:
                raise ValueError("header line too long")
            if not self._fill():
                break
        head, newline, self._buffer = self._buffer.partition(b"\n")
        return head + newline

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size > 0:
            if not self._buffer and not self._fill():
                raise EOFError("archive ends inside a record")
            piece, self._buffer = self._buffer[:size], self._buffer[size:]
            size -= len(piece)
            yield piece

    def skip_blank(self) -> None:
        """Move over the line ends between records."""
        while not self.at_end() and self._buffer[:1] in (b"\r", b"\n"):
            self._buffer = self._buffer.lstrip(b"\r\n")


class _Body:
    """A payload kept up to a limit while all of it is counted."""

    def __init__(self, limit: int):
        self.limit = limit
        self.kept = bytearray()
        self.size = 0

    def add(self, piece: bytes) -> None:
        self.size += len(piece)
        if self.limit < 0:
            self.kept += piece
        elif len(self.kept) < self.limit:
            self.kept += piece[: self.limit - len(self.kept)]


def _unchunk(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Chunked transfer coding; stops at the first malformed chunk."""
    buffer, missing = b"", None
    for piece in pieces:
        buffer += piece
        while buffer:
            if missing:
                part, buffer = buffer[:missing], buffer[missing:]
                missing -= len(part)
                yield part
                continue
            line, newline, rest = buffer.partition(b"\n")
            if not newline:
                break
            if missing == 0 and not line.strip():
                buffer = rest  # line end after a chunk
                continue
            try:
                missing = int(line.split(b";")[0].strip(), 16)
            except ValueError:
                missing = -1
            buffer = rest
            if missing <= 0:
                for _ in pieces:
                    pass
                return


def _decode(pieces: Iterator[bytes], encodings: list[str], limit: int) -> tuple[bytes, int, str]:
    """Content, its full length and how it was decoded."""
    coding = encodings[0].strip().lower() if len(encodings) == 1 else ""
    raw = _Body(limit)
    if len(encodings) > 1 or coding not in ("", "identity", "none", "gzip", "x-gzip", "deflate"):
        for piece in pieces:
            raw.add(piece)
        return bytes(raw.kept), raw.size, "unsupported"
    if coding in ("", "identity", "none"):
        for piece in pieces:
            raw.add(piece)
        return bytes(raw.kept), raw.size, "raw"
    decoded, status = _Body(limit), "decoded"
    inflater = None
    ended = False
    for piece in pieces:
        raw.add(piece)
        if status != "decoded" or ended:
            continue
        try:
            while piece:
                if inflater is None:
                    zlib_head = coding == "deflate" and (piece[0] & 0x0F) == 8
                    inflater = zlib.decompressobj(31 if coding != "deflate" else 15 if zlib_head else -15)
                decoded.add(inflater.decompress(piece, _PIECE))
                piece = inflater.unconsumed_tail
                if inflater.eof:
                    # Another gzip member may follow; anything else after the end is no content.
                    piece = inflater.unused_data
                    ended = coding == "deflate" or piece[:1] not in (b"", b"\x1f")
                    inflater = None
                    if ended:
                        break
        except zlib.error:
            status = "partial" if decoded.size else "failed"
    if inflater is not None and status == "decoded":
        status = "partial" if decoded.size else "failed"
    if status == "failed":
        return bytes(raw.kept), raw.size, status
    return bytes(decoded.kept), decoded.size, status


def _headers(stream: _Stream, budget: int | None = None) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines up to the blank line, folded lines joined, and the bytes read."""
    found: list[tuple[str, str]] = []
    block = b""
    while budget is None or len(block) < budget:
        line = stream.line()
        block += line
        if not line.strip(b"\r\n"):
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and found:
            name, value = found[-1]
            found[-1] = (name, f"{value} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            found.append((name.strip(), value.strip()))
    return found, block


def _http_head(block: bytes) -> tuple[int | None, list[tuple[str, str]]]:
    """Status and header lines of an HTTP message head."""
    first, _, rest = block.partition(b"\n")
    words = first.split()
    status = int(words[1]) if first.startswith(b"HTTP/") and len(words) > 1 and words[1].isdigit() else None
    lines: list[tuple[str, str]] = []
    for raw in rest.decode("utf-8", "replace").splitlines():
        if raw[:1] in (" ", "\t") and lines:
            lines[-1] = (lines[-1][0], f"{lines[-1][1]} {raw.strip()}")
        elif ":" in raw:
            name, _, value = raw.partition(":")
            lines.append((name.strip(), value.strip()))
    return status, lines


def _date(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
    except (AttributeError, ValueError):
        return None


def _record(stream: _Stream, limit: int) -> dict:
    """Read one record; the stream stands behind it afterwards."""
    version = stream.line()
    if not version.startswith(b"WARC/"):
        raise ValueError("not a record start")
    named, _ = _headers(stream)
    single = {}
    for name, value in named:
        single.setdefault(name.lower(), value)
    row = dict.fromkeys(_COLUMNS)
    row.update(
        type=single.get("warc-type"),
        record_id=single.get("warc-record-id"),
        concurrent_to=[v for n, v in named if n.lower() == "warc-concurrent-to"],
        target=single.get("warc-target-uri", "").strip("<>") or None,
        date=_date(single.get("warc-date")),
        ip=single.get("warc-ip-address"),
        media_type=single.get("content-type"),
        truncated=single.get("warc-truncated"),
    )
    size = int(single["content-length"])
    pieces = stream.pieces(size)
    http = (row["media_type"] or "").lower().startswith("application/http")
    if not http or row["type"] not in ("request", "response"):
        for _ in pieces:
            pass
        return row
    head = b""
    ends = (b"\r\n\r\n", b"\n\n")
    for piece in pieces:
        head += piece
        if any(e in head for e in ends) or len(head) > _HEAD_LIMIT:
            break
    cuts = [head.find(e) + len(e) for e in ends if e in head]
    cut = min(cuts) if cuts else len(head)
    block, start = head[:cut], head[cut:]
    status, lines = _http_head(block)
    row.update(
        http_status=status,
        headers=[{"name": n, "value": v} for n, v in lines],
        http_block=block.decode("utf-8", "replace"),
    )

    def body() -> Iterator[bytes]:
        if start:
            yield start
        yield from pieces

    def values(name: str) -> list[str]:
        return [v for n, v in lines if n.lower() == name]

    if row["type"] == "response":
        chunked = [v.lower() for v in values("transfer-encoding")] == ["chunked"]
        source = _unchunk(body()) if chunked else body()
        content, full, how = _decode(source, values("content-encoding"), limit)
        row.update(content=content, full_length=full, decode_status=how)
    for _ in pieces:
        pass
    return row


def _open(path: str):
    if "://" in path and not path.startswith("file:"):
        system, inner = arrow_fs.FileSystem.from_uri(path)
        return system.open_input_file(inner), system.get_file_info(inner).size
    local = path.removeprefix("file://").removeprefix("file:")
    return open(local, "rb"), os.path.getsize(local)


def _holds_record(member: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(member, _LOOK).startswith(b"WARC/")
    except zlib.error:
        return False


def _next_start(handle, start: int, end: int) -> int | None:
    """The first place in the range that looks like the start of a record or of its gzip member."""
    handle.seek(0)
    zipped = handle.read(2) == _ZIPPED
    mark, before = (_ZIPPED + b"\x08", 0) if zipped else (b"\r\n\r\nWARC/", 4)
    at = max(start - before, 0)
    handle.seek(at)
    window, more = b"", True
    while more and at + before < end:
        piece = handle.read(_PIECE)
        more = bool(piece)
        window += piece
        found = window.find(mark)
        while found >= 0 and (not zipped or not more or len(window) - found >= _LOOK):
            if at + found + before >= end:
                return None
            if not zipped or _holds_record(window[found : found + _LOOK]):
                return at + found + before
            found = window.find(mark, found + 1)
        used = found if found >= 0 else max(len(window) - len(mark) + 1, 0)
        at, window = at + used, window[used:]
    return None


def read_file(path: str, limit: int, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """All records of one file; a fault ends the file with one error row.

    With a range, the records from the first request that starts in it up to the first request
    that starts behind it; so the ranges of a file share out its records, and a response and its
    request are read together.  The range from zero on takes what comes before any request too.
    """
    offset = start
    try:
        handle, file_size = _open(path)
    except OSError as fault:
        yield dict.fromkeys(_COLUMNS) | {"file": path, "offset": 0, "error": str(fault)}
        return
    with handle:
        request = None
        own = start == 0
        try:
            first = 0 if own else _next_start(handle, start, end or file_size)
            if first is None:
                return
            handle.seek(first)
            stream = _Stream(handle, first)
            stream.skip_blank()
            while not stream.at_end():
                offset = stream.offset()
                behind = end is not None and offset >= end
                if behind and not own:
                    return
                row = _record(stream, limit)
                if row["type"] == "request":
                    if behind:
                        return
                    own = True
                stream.skip_blank()
                if not own:
                    continue
                length = stream.offset() - offset
                row.update(
                    file=path,
                    offset=offset,
                    file_size=file_size,
                    length=length if length > 0 else None,
                    preceding_request=request if row["type"] == "response" else None,
                )
                if row["type"] == "request":
                    request = {k: row[k] for k in ("record_id", "target", "http_block")}
                yield row
        except (EOFError, OSError, ValueError, KeyError, zlib.error, gzip.BadGzipFile) as fault:
            yield dict.fromkeys(_COLUMNS) | {
                "file": path, "offset": offset, "file_size": file_size,
                "error": f"{type(fault).__name__}: {fault}",
            }


def _batches(rows: Iterator[dict], size: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def ranges(paths: DataFrame, split_bytes: int) -> DataFrame:
    """``path, start, end`` of stretches of ``split_bytes`` that cover each file; a missing file has one."""

    def cut(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    handle, size = _open(path)
                    handle.close()
                except OSError:
                    size = 0
                starts = range(0, max(size, 1), split_bytes)
                rows += [{"path": path, "start": s, "end": s + split_bytes} for s in starts]
            fields = [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return paths.select("path").mapInArrow(cut, "path string, start bigint, end bigint")


def scan(
    paths: DataFrame,
    limit: int = config.CONTENT_LIMIT,
    files_per_task: int = 1,
    rows_per_batch: int = 256,
    split_bytes: int | None = None,
) -> DataFrame:
    """S3 over ``paths(path)``: the table is spread, so a file is a unit of work.

    With ``split_bytes`` a stretch of a file is.  Where a stretch starts inside a record, the
    reader looks for the next record start; a page that is itself an archive can deceive it,
    which :func:`misread` finds and :func:`store` mends.  A task reads short stretches one after
    the other, SPLIT_BYTES in all, so that tasks and their files follow the bytes, not the stretches.
    """
    whole = F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end")
    parts = paths.select("path", *whole) if split_bytes is None else ranges(paths, split_bytes)
    count = parts.count()
    if split_bytes is None:
        tasks = -(-count // files_per_task)
    else:
        # Every core has work, however little there is.
        cores = paths.sparkSession.sparkContext.defaultParallelism
        tasks = max(min(count, cores), -(-count // max(1, SPLIT_BYTES // split_bytes)))

    def read(batches):
        for batch in batches:
            stretches = zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")))
            rows = (row for path, start, end in stretches for row in read_file(path, limit, start, end))
            yield from _batches(rows, rows_per_batch)

    return parts.repartition(max(1, tasks)).mapInArrow(read, SCHEMA)


def misread(records: DataFrame) -> DataFrame:
    """``file`` of those whose records do not add up to the file, or with a fault."""
    sums = records.groupBy("file").agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("read"), F.max("file_size").alias("size"), F.count("error").alias("faults")
    )
    return sums.where((F.col("faults") > 0) | ~F.col("read").eqNullSafe(F.col("size"))).select("file")


def store(
    paths: DataFrame, folder: str, limit: int = config.CONTENT_LIMIT, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The records of a scan in byte ranges, written below ``folder`` and read back.

    Files that do not add up are read again whole, so the rows are those of an undivided scan
    whatever the files hold; a damaged file ends at its first fault, as it does there.  A path
    that is listed twice is read once.
    """
    spark = paths.sparkSession
    paths = paths.select("path").distinct()
    scan(paths, limit, split_bytes=split_bytes).write.mode("overwrite").parquet(f"{folder}/ranges")
    divided = spark.read.schema(SCHEMA).parquet(f"{folder}/ranges")
    misread(divided).write.mode("overwrite").parquet(f"{folder}/misread")
    again = spark.read.schema("file string").parquet(f"{folder}/misread")
    if again.isEmpty():
        return divided
    scan(again.select(F.col("file").alias("path")), limit).write.mode("overwrite").parquet(f"{folder}/whole")
    whole = spark.read.schema(SCHEMA).parquet(f"{folder}/whole")
    return divided.join(again, "file", "left_anti").select(*_COLUMNS).unionByName(whole)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.limit = int(options.get("limit", _DEFAULT_LIMIT))

    def partitions(self) -> list[_File]:
        pattern = self.pattern.removeprefix("file://").removeprefix("file:")
        if "://" in pattern:
            system, inner = arrow_fs.FileSystem.from_uri(pattern)
            root = pattern[: len(pattern) - len(inner)]
            info = system.get_file_info(inner)
            if info.type == arrow_fs.FileType.File:
                return [_File(pattern)]
            found = system.get_file_info(arrow_fs.FileSelector(inner))
            return [_File(root + f.path) for f in found if f.type == arrow_fs.FileType.File]
        if os.path.isdir(pattern):
            pattern = os.path.join(pattern, "*")
        return [_File(p) for p in sorted(glob.glob(pattern)) or [pattern]]

    def read(self, partition: _File) -> Iterator[tuple]:
        for row in read_file(partition.path, self.limit):
            headers = row["headers"]
            if headers is not None:
                row["headers"] = [(h["name"], h["value"]) for h in headers]
            if row["preceding_request"] is not None:
                row["preceding_request"] = tuple(row["preceding_request"].values())
            yield tuple(row[c] for c in _COLUMNS)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("limit", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)

# Python workers get the code of this module along with the task, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
