"""Odd and hostile inputs: nothing is cut, lost or slow because of them."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from sitestance.functions import text, url
from sitestance.operators import captures, html, metadata, policy
from sitestance.sources import warc


def annotations(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows = html.annotate(df).orderBy("page_id").collect()
    return [{a["key"]: a["values"] for a in r["annotations"]} for r in rows]


def test_quoted_signs_and_comments_in_titles(spark):
    first, second = annotations(
        spark,
        '<a title="a > b" rel="license" href="https://ex.org/l">x</a>'
        '<a title="c > d" href="https://creativecommons.org/licenses/by/4.0/">y</a>',
        '<title>a <!-- b</title><meta name="robots" content="noindex"><h1>t</h1>',
    )
    assert any("https://ex.org/l" in v for v in first.values())
    assert any("https://creativecommons.org/licenses/by/4.0/" in v for v in first.values())
    assert second["parse.title"] == ["a <!-- b"]
    assert any("noindex" in v for v in second.values())


@pytest.mark.parametrize("piece", ["<a ", "<h1>", '<b rel=x"', "<a<", "<h1 ", "x" * 16, "<meta " + "y" * 90])
def test_annotations_take_linear_time(spark, piece):
    annotations(spark, "<p>warm")
    start = time.perf_counter()
    annotations(spark, "<meta " + piece * (64_000 // len(piece)))
    assert time.perf_counter() - start < 10


def test_gzip_members_are_read_on():
    both = gzip.compress(b"first ") + gzip.compress(b"second")
    for size in (1, 7, 1000):
        pieces = [both[i : i + size] for i in range(0, len(both), size)]
        assert warc._decode(iter(pieces), ["gzip"], -1) == (b"first second", 12, "decoded")
    junk = warc._decode(iter([gzip.compress(b"body") + b"\0\0"]), ["gzip"], -1)
    assert junk == (b"body", 4, "decoded")
    cut = gzip.compress(bytes(range(256)) * 40)[:-20]
    assert warc._decode(iter([cut]), ["gzip"], -1)[2] == "partial"


def test_deep_suffix_rules(spark):
    rules = spark.createDataFrame(
        [("cn", False, False), ("s3.dual.north.aws.com.cn", False, False)],
        "suffix string, is_wildcard boolean, is_exception boolean",
    )
    pages = spark.createDataFrame([("a.b.s3.dual.north.aws.com.cn",), ("x.y.cn",)], "host string")
    found = {r["host"]: r["domain"] for r in metadata.with_domain(pages, rules).collect()}
    assert found == {"a.b.s3.dual.north.aws.com.cn": "b.s3.dual.north.aws.com.cn", "x.y.cn": "y.cn"}


def test_headers_named_like_capture_fields(spark):
    row = spark.createDataFrame([(1,)], "id long").select(
        F.lit(200).alias("http_status"), F.timestamp_seconds(F.lit(5)).alias("date"), F.lit("1.2.3.4").alias("ip"),
        F.lit("head").alias("http_block"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("offset"),
        F.lit(9).cast("long").alias("length"), F.lit("u").alias("target"), F.array(F.lit("r")).alias("concurrent_to"),
        F.struct(F.lit("r").alias("record_id"), F.lit("u").alias("target"), F.lit("q").alias("http_block")).alias("preceding_request"),
        F.array(F.struct(F.lit("_request.time_").alias("name"), F.lit("x").alias("value"))).alias("headers"),
    )
    assert captures.capture_columns(row).first()["metadata"]["protocol._request.time_"] == ["5000"]


def test_requests_without_origin_have_no_cache_state(spark):
    rows = [(1, "o", "2023-01-01"), (2, "o", "2023-01-02"), (3, None, "2023-01-01")]
    df = spark.createDataFrame(rows, "page_id long, origin string, day string").withColumn("ts", F.to_timestamp("day"))
    found = {r["page_id"]: r["cached"] for r in policy.cache_hits(df).collect()}
    assert found == {1: False, 2: True, 3: None}


def test_long_references_paths_and_ports(spark):
    row = spark.createDataFrame([("&#0000000065;&#x000000041;",)], "t string")
    assert row.select(text.decode_references(F.col("t"))).first()[0] == "AA"
    row = spark.createDataFrame([("http://ex.org:000080/",)], "u string")
    assert row.select(url.is_valid(F.col("u"))).first()[0]
