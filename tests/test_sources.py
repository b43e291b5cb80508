import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sitestance.operators import captures
from sitestance.sources import tables, warc


def record(kind, number, block, target="http://ex.org/", extra=""):
    media = "application/warc-fields" if kind == "warcinfo" else f"application/http; msgtype={kind}"
    head = (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\nWARC-Date: 2023-09-21T09:47:51Z\r\n"
        f"WARC-Target-URI: {target}\r\n{extra}Content-Type: {media}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def response(body, headers="", status="200 OK"):
    return f"HTTP/1.1 {status}\r\nContent-Type: text/plain\r\n{headers}\r\n".encode() + body


LONG = b"x" * 500
DEFLATE = zlib.compressobj(9, zlib.DEFLATED, -15)
RECORDS = [
    record("warcinfo", 0, b"software: x\r\n"),
    record("request", 1, b"GET /a HTTP/1.1\r\nHost: ex\r\n\r\n", "http://ex.org/a"),
    record("response", 2, response(b"hello"), "http://ex.org/a", "WARC-IP-Address: 1.2.3.4\r\n"),
    record("response", 3, response(b"gone", status="404 Not Found"), "http://ex.org/b"),
    record("response", 4, response(gzip.compress(LONG), "Content-Encoding: gzip\r\n"), "http://ex.org/c"),
    record("response", 5, response(b"raw", "Content-Encoding: br\r\n"), "http://ex.org/d"),
    record("response", 6, response(LONG), "http://ex.org/e", "WARC-Truncated: DISCONNECT\r\n"),
    record("response", 7, response(DEFLATE.compress(b"df") + DEFLATE.flush(), "Content-Encoding: deflate\r\n"), "http://ex.org/f"),
    record("response", 8, response(zlib.compress(b"zf"), "Content-Encoding: deflate\r\n"), "http://ex.org/g"),
    record("response", 9, response(b"not gzip", "Content-Encoding: gzip\r\n"), "http://ex.org/h"),
    record("response", 10, response(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n", "Transfer-Encoding: chunked\r\n"), "http://ex.org/i"),
    record("response", 11, response(b"two", "Content-Encoding: gzip\r\nContent-Encoding: gzip\r\nX-A: 1\r\nx-a: 2\r\n"), "http://ex.org/j", "WARC-Concurrent-To: <urn:1>\r\n"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("warc")
    (root / "a.warc").write_bytes(b"".join(RECORDS))
    (root / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (root / "c.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS[:4])[:-30])
    (root / "d.warc").write_bytes(b"".join(RECORDS[:3]) + b"garbage\r\n\r\n")
    return str(root)


@pytest.mark.parametrize("way", ["format", "paths"])
def test_scan(spark, folder, way):
    if way == "format":
        warc.register(spark)
        df = spark.read.format("warc").option("limit", 100).load(folder)
    else:
        paths = spark.createDataFrame([(f"{folder}/{n}",) for n in ("a.warc", "b.warc.gz", "c.warc.gz", "d.warc")], "path string")
        df = warc.scan(paths, limit=100)
    df = df.withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1)).cache()
    sizes = {r["name"]: (r["n"], r["s"], r["size"]) for r in df.groupBy("name").agg(
        F.count("type").alias("n"), F.sum("length").alias("s"), F.max("file_size").alias("size")).collect()}
    for name in ("a.warc", "b.warc.gz"):
        n, total, size = sizes[name]
        assert n == len(RECORDS) and total == size
    assert sizes["c.warc.gz"][0] == 3 and sizes["d.warc"][0] == 3
    errors = {r["file"].rsplit("/")[-1] for r in captures.scan_errors(df).collect()}
    assert errors == {"c.warc.gz", "d.warc"}
    kept = captures.truncate(captures.http_responses(df.where("name IN ('a.warc', 'b.warc.gz')")), 100)
    rows = {}
    for r in kept.withColumn("request", captures.paired_request()).collect():
        rows.setdefault(r["target"][-1], []).append(r)
    assert all(len(v) == 2 for v in rows.values()) and len(rows) == 10
    for letter, content, how, trimmed, reason in [
        ("a", b"hello", "raw", False, None), ("b", b"gone", "raw", False, None), ("c", LONG[:100], "decoded", True, "length"),
        ("d", b"raw", "unsupported", False, None), ("e", LONG[:100], "raw", True, "disconnect"), ("f", b"df", "decoded", False, None),
        ("g", b"zf", "decoded", False, None), ("h", b"not gzip", "failed", False, None), ("i", b"abcde", "raw", False, None),
        ("j", b"two", "unsupported", False, None),
    ]:
        for r in rows[letter]:
            assert bytes(r["content"]) == content, letter
            assert (r["decode_status"], r["trimmed"], r["trimmed_reason"]) == (how, trimmed, reason), letter
    assert {r["http_status"] for r in rows["b"]} == {404} and {r["ip"] for r in rows["a"]} == {"1.2.3.4"}
    assert all(r["request"].startswith("GET /a") for k in "aj" for r in rows[k]) and rows["b"][0]["request"] is None
    meta = captures.capture_columns(kept.where("target LIKE '%/j'")).first()["metadata"]
    assert meta["protocol.x-a"] == ["1", "2"] and meta["protocol._request.time_"] == ["1695289671000"]
    df.unpersist()


def _inner_archive():
    """A page that is itself an archive; zipped again, its bytes stay as they are."""
    return b"".join(RECORDS[:3])


@pytest.fixture(scope="module")
def divided(tmp_path_factory):
    root = tmp_path_factory.mktemp("divided")
    many = [
        r for i in range(60) for r in (
            record("request", 2 * i, f"GET /{i} HTTP/1.1\r\n\r\n".encode(), f"http://ex.org/{i}"),
            record("response", 2 * i + 1, response(b"%d " % i * (i * 37 % 400)), f"http://ex.org/{i}"),
        )
    ]
    answers = many[1::2]
    deceiving = many[:6] + [record("response", 900, response(LONG + b"\r\n\r\n" + _inner_archive()))] + many[6:20]

    def stored_members(parts):
        return b"".join(gzip.compress(p, 0) for p in parts)

    inner = b"".join(gzip.compress(r) for r in RECORDS[:3])
    files = {
        "plain.warc": b"".join(many),
        "zipped.warc.gz": b"".join(gzip.compress(r) for r in many),
        "pairs.warc.gz": b"".join(gzip.compress(a + b) for a, b in zip(answers, many[2::2])),
        "one_member.warc.gz": gzip.compress(b"".join(many)),
        "answers.warc": b"".join(answers),
        "deceiving.warc": b"".join(deceiving),
        "deceiving.warc.gz": stored_members([*many[:6], record("response", 900, response(inner * 3)), *many[6:20]]),
        "damaged.warc.gz": b"".join(gzip.compress(r) for r in many[:30]) + b"damage" + gzip.compress(many[30]),
        "cut.warc": b"".join(many)[:-40],
        "empty.warc": b"",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return root


@pytest.mark.parametrize("step", [64, 700, 4096])
def test_ranges_share_out_a_file(divided, step):
    for name in ("plain.warc", "zipped.warc.gz", "pairs.warc.gz", "one_member.warc.gz", "answers.warc", "empty.warc"):
        path = str(divided / name)
        size = (divided / name).stat().st_size
        parts = [list(warc.read_file(path, -1, s, s + step)) for s in range(0, max(size, 1), step)]
        whole = list(warc.read_file(path, -1))
        assert [r for rows in parts for r in rows] == whole, name
        assert sum(bool(rows) for rows in parts) > 3 or name in ("one_member.warc.gz", "answers.warc", "empty.warc") or step == 4096


def test_stored_scan_equals_an_undivided_one(spark, divided, tmp_path):
    names = sorted(p.name for p in divided.iterdir())
    paths = spark.createDataFrame([(str(divided / n),) for n in [*names, "none.warc", names[0]]], "path string")
    found = warc.store(paths, str(tmp_path / "s"), -1, split_bytes=300)
    key = lambda r: (r["file"], r["offset"], r["record_id"] or "", r["error"] or "")
    expected = warc.scan(paths.distinct(), -1).collect()
    assert found.columns == warc._COLUMNS
    assert sorted(found.collect(), key=key) == sorted(expected, key=key)
    again = {r["file"].rsplit("/")[-1] for r in spark.read.parquet(str(tmp_path / "s" / "misread")).collect()}
    assert {"deceiving.warc", "damaged.warc.gz", "cut.warc", "none.warc"} <= again
    assert not again & {"plain.warc", "zipped.warc.gz", "pairs.warc.gz", "one_member.warc.gz", "answers.warc"}


def test_tasks_follow_bytes_not_ranges(spark, divided):
    """Short ranges share tasks, so a scan has as many tasks and files as its bytes need."""
    paths = spark.createDataFrame([(str(divided / n),) for n in ("plain.warc", "zipped.warc.gz")], "path string")
    count = warc.ranges(paths, 64).count()
    found = warc.scan(paths, -1, split_bytes=64)
    assert count > 100 and found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    key = lambda r: (r["file"], r["offset"])
    assert sorted(found.collect(), key=key) == sorted(warc.scan(paths, -1).collect(), key=key)


def test_missing_file_is_an_error_row(spark):
    df = warc.scan(spark.createDataFrame([("/tmp/none/x.warc",)], "path string"))
    assert df.first()["error"]


def test_large_body_is_bounded(spark, tmp_path):
    body = bytes(range(256)) * 8192
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record("response", 1, response(gzip.compress(body), "Content-Encoding: gzip\r\n"))))
    rows = list(warc.read_file(str(tmp_path / "x.warc.gz"), 1000))
    assert rows[0]["content"] == body[:1000] and rows[0]["full_length"] == len(body)
    rows = list(warc.read_file(str(tmp_path / "x.warc.gz"), -1))
    assert hashlib.md5(rows[0]["content"]).digest() == hashlib.md5(body).digest()


def test_path_lists(spark, tmp_path):
    (tmp_path / "warc.paths").write_text("crawl/a.gz\ncrawl/b.gz\n\ncrawl/c.gz\n")
    (tmp_path / "other.txt").write_text("no\n")
    listed = tables.with_root(tables.path_list(spark, str(tmp_path), "*.paths"), "file:/data/")
    assert sorted((r["file_no"], r["path"]) for r in listed.collect()) == [
        (0, "file:/data/crawl/a.gz"), (1, "file:/data/crawl/b.gz"), (3, "file:/data/crawl/c.gz")
    ]


def test_registry(spark):
    assert tables.crawls(spark).count() == 16


def test_record_counters(spark, folder):
    warc.register(spark)
    found = captures.record_counters(spark.read.format("warc").load(f"{folder}/a.warc"))
    counts = {r["scope"]: r["n"] for r in found.collect()}
    assert counts["fetched"] == 10 and counts["status_404"] == 1 and counts["warc_skipped_record_of_type_request"] == 1
