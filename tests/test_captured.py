"""From archive records to the inputs of the flows."""

import pytest
from pyspark.sql import functions as F

from sitestance.functions import text
from sitestance.operators import study
from sitestance.plans import corpora, flows
from sitestance.sources import warc


@pytest.mark.parametrize(
    "content, content_type, expected",
    [
        ("é“".encode(), None, "é“"),
        ("é“".encode("cp1252"), "text/html; charset=ISO-8859-1", "é“"),
        ("é".encode("cp1252"), 'text/html; charset="windows-1252"', "é"),
        (b"<meta charset='koi8-r'>" + "да".encode("koi8-r"), "text/html", "<meta charset='koi8-r'>да"),
        ("日本".encode("shift_jis"), "text/html;charset=Shift_JIS", "日本"),
        # The mark counts before the header, the header before the tag.
        (b"\xef\xbb\xbf" + "é".encode(), "text/html; charset=latin1", "é"),
        (b"<meta charset=koi8-r>" + "é".encode(), "a/b; charset=utf-8", "<meta charset=koi8-r>é"),
        ("é".encode(), "text/html; charset=no-such-set", "é"),
        (b"\xff", "text/html", "�"),
        (b"", "text/html; charset=gbk", ""),
        (None, "text/html; charset=gbk", None),
    ],
)
def test_pages_are_decoded_as_they_declare(spark, content, content_type, expected):
    row = spark.createDataFrame([(content, content_type)], "content binary, kind string")
    assert row.select(text.decode_page(F.col("content"), F.col("kind"))).first()[0] == expected


def _records(spark):
    media = "application/http; msgtype=response"
    row = dict.fromkeys(warc._COLUMNS)
    ok = {
        **row, "file": "f", "offset": 1, "type": "response", "media_type": media, "http_status": 200,
        "target": "https://ex.org/robots.txt", "full_length": 6,
        "headers": [{"name": "content-type", "value": "text/plain"}], "content": b"abcdef",
    }
    rows = [
        ok,
        {**ok, "offset": 2, "target": None},
        {**ok, "offset": 3, "target": ""},
        {**ok, "offset": 4, "content": None, "full_length": None},
        {**row, "file": "f", "offset": 5, "error": "EOFError: "},
        {**row, "file": "f", "offset": 6, "type": "request"},
    ]
    return spark.createDataFrame(rows, warc.SCHEMA)


def test_no_response_is_lost(spark):
    records = _records(spark)
    assert [r["offset"] for r in flows.captured(records).collect()] == [1]
    found = {r["offset"]: r["error"] for r in flows.set_aside(records).collect()}
    assert found == {
        2: "response without URL", 3: "response without URL", 4: "response without content", 5: "EOFError: ",
    }


def test_stored_captures_feed_both_flows(spark, tmp_path):
    table = flows.captured(_records(spark), limit=4)
    stored = flows.store_captures(table, str(tmp_path), "robotstxt", "2023-50")
    robots = flows.captured_robots(stored).first().asDict()
    assert (robots["url"], robots["status"], robots["content_type"]) == ("https://ex.org/robots.txt", 200, "text/plain")
    assert (robots["content"], robots["dataset"], robots["crawl"]) == (b"abcd", "robotstxt", "2023-50")
    assert robots["metadata"]["warc.file.name"] == ["f"]
    pages = flows.captured_pages(stored)
    assert pages.first()["html"] == "abcd"
    assert flows.robots_documents(flows.captured_robots(stored), corpora.suffixes(spark)).first()["doc"]["host"] == ["ex.org"]


def _archive(path, numbers):
    def one(kind, number, block):
        return (
            f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}:{number}>\r\nWARC-Target-URI: http://ex.org/{number}\r\n"
            f"Content-Type: application/http; msgtype={kind}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
        )

    path.write_text("".join(
        one("request", n, f"GET /{n} HTTP/1.1\r\n\r\n") + one("response", n, f"HTTP/1.1 200 OK\r\n\r\npage {n}") for n in numbers
    ), newline="")


def _targets(table):
    return sorted(r["target"].rsplit("/")[-1] for r in table.collect())


def test_reruns_open_new_archives_only(spark, tmp_path):
    def run(*names):
        paths = spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
        return flows.ingest(paths, str(tmp_path / "out"), "warc", "c1", split_bytes=200)

    _archive(tmp_path / "a", [1, 2, 3])
    _archive(tmp_path / "b", [4, 5])
    assert _targets(run()) == []
    assert _targets(run("a", "b", "c", "a")) == list("12345")
    # What a failed run left behind is under no listed name.
    root = tmp_path / "out" / "dataset=warc" / "crawl=c1"
    left = flows.captured(warc.scan(spark.createDataFrame([(str(tmp_path / "a"),)], "path string")))
    left.write.parquet(str(root / "captures" / "batch=failed"))
    # Read archives may change or go; one that was missing is read when it is there.
    (tmp_path / "a").write_text("changed")
    _archive(tmp_path / "c", [6])
    (tmp_path / "d").write_text("WARC/1.0\r\nbroken")
    table = run("a", "b", "c", "d")
    assert _targets(table) == list("123456") and {(r["dataset"], r["crawl"]) for r in table.collect()} == {("warc", "c1")}
    assert _targets(run("a", "b", "c", "d")) == list("123456")
    assert len(list((root / "records").iterdir())) == 2
    faults = flows.ingest_faults(spark, str(tmp_path / "out"), "warc", "c1").collect()
    assert sorted(r["file"][-1] for r in faults) == ["c", "d"]
    full = flows.captured(warc.scan(spark.createDataFrame([(str(tmp_path / n),) for n in "bc"], "path string")))
    kept = table.where(~table["file"].endswith("/a")).drop("dataset", "crawl").select(*full.columns)
    key = lambda r: (r["file"], r["offset"])
    assert sorted(kept.collect(), key=key) == sorted(full.collect(), key=key)


@pytest.mark.parametrize(
    "directive, forbids",
    [("noindex", True), ("NoFollow", True), ("otherbot: noarchive", True), ("none", True), ("all", False),
     ("notranslate", False), ("max-image-preview:none", False), ("max-snippet: 5", False), ("", False)],
)
def test_directives_that_forbid(spark, directive, forbids):
    row = spark.createDataFrame([(directive,)], "d string")
    assert row.select(study.restricts(F.col("d"))).first()[0] is forbids
