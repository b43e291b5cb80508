"""Stored sketches and the stored offset index."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitestance.operators import captures, sketches


def test_buckets_keep_the_order_and_the_size(spark):
    sizes = sorted({0, 1, 255, 256, 257, 511, 512, *(random.Random(1).randrange(1 << k) for k in range(1, 62) for _ in range(9))})
    frame = spark.createDataFrame([(s,) for s in [*sizes, -5, None]], "size long")
    bucket = sketches.size_bucket(F.col("size"))
    found = {r[0]: (r[1], r[2]) for r in frame.select("size", bucket.alias("b"), sketches.bucket_size(bucket)).collect()}
    assert found[None] == (None, None) and found[-5] == (0, 0)
    assert [found[s][0] for s in sizes] == sorted(found[s][0] for s in sizes)
    assert all(abs(found[s][1] - s) <= s / 256 for s in sizes)


def test_quantiles_stay_in_their_bound_and_crawls_are_replaced(spark, tmp_path):
    draw = random.Random(7)
    rows = [(f"c{k % 3}", k % 2, int(draw.lognormvariate(9, 2))) for k in range(6000)] + [("c0", 0, None), ("c9", 5, None)]
    docs = spark.createDataFrame(rows, "crawl string, status int, content_length long")
    path = str(tmp_path / "sizes")
    old = spark.createDataFrame([("c0", 0, 7)], docs.schema)
    sketches.store(sketches.size_sketches(old, "status"), path)
    stored = sketches.store(sketches.size_sketches(docs, "status"), path)
    assert stored.agg(F.sum("n")).first()[0] == len(rows)
    found = {(r.crawl, r.status, r.level): r for r in sketches.quantiles_over(stored, "crawl", "status").collect()}
    for group, r in found.items():
        crawl, status, level = group
        of = [x for x in rows if (level > 1 or x[0] == crawl) and (level > 0 or x[1] == status)]
        sizes = sorted(x[2] for x in of if x[2] is not None)
        assert r.docs == len(of)
        for q, value in ((0.5, r.p50), (0.95, r.p95)):
            if not sizes:
                assert value is None
                continue
            exact = sizes[max(math.ceil(q * len(sizes)), 1) - 1]
            assert abs(value - exact) <= exact / 256 + 1
    assert len(found) == 7 + 4 + 1


def test_distinct_sketches_merge(spark, tmp_path):
    names = [[f"a{k}" for k in range(n * 5000, n * 5000 + 10_000)] for n in range(3)]
    docs = spark.createDataFrame(list(zip(["c0", "c1", "c2"], names)) + [("c3", None), ("c3", [None]), ("c4", ["", "x"])], "crawl string, useragents array<string>")
    stored = sketches.store(sketches.agent_sketches(docs), str(tmp_path / "agents"))
    for r in sketches.distinct_over(stored, "crawl").collect():
        assert r.agents == 2 if r.crawl == "c4" else abs(r.agents - 10_000) < 400
    assert abs(sketches.distinct_over(stored).first().agents - 20_000) < 800


def indexed(spark, path, rows, files_per_part):
    frame = spark.createDataFrame(rows, "file_no int, offset long").repartition(5)
    captures.store_indexed(frame, path, chunk_size=16, files_per_part=files_per_part)


@pytest.mark.parametrize("files_per_part", [1, 2, 100])
def test_first_documents_by_the_index(spark, tmp_path, files_per_part):
    rows = [(f, o) for f in range(5) for o in range(0, 100, 3)]
    path = str(tmp_path / "table")
    indexed(spark, path, [*rows, (None, 3), (2, None)], files_per_part)
    for limit in (0, 1, 33, 34, 35, 100, 169, 170, 500):
        found = captures.first_indexed(spark, path, limit).collect()
        assert sorted((r["file_no"], r["offset"]) for r in found) == sorted(rows)[:limit], limit


def test_files_behind_the_edge_are_not_opened(spark, tmp_path):
    rows = [(f, o) for f in range(6) for o in range(50)]
    indexed(spark, str(tmp_path / "table"), rows, 2)
    for part in (tmp_path / "table" / "rows").glob("_part=[12]/*.parquet"):
        part.write_bytes(b"no parquet")
        (part.parent / f".{part.name}.crc").unlink()
    found = captures.first_indexed(spark, str(tmp_path / "table"), 80)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "_part" in text and "PartitionFilters: [isnotnull(_part" in text
    assert sorted((r["file_no"], r["offset"]) for r in found.collect()) == sorted(rows)[:80]


def test_index_of_an_empty_table(spark, tmp_path):
    indexed(spark, str(tmp_path / "table"), [], 2)
    assert captures.first_indexed(spark, str(tmp_path / "table"), 5).count() == 0
