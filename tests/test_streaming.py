from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitestance.plans import catalog, corpora
from sitestance.streaming import jobs


def test_stream_counters_equal_the_batch(spark, sf_dir):
    batch = catalog.CATALOG["s13_counters"](spark, sf_dir)
    stream = catalog.CATALOG["s13_stream_counters"](spark, sf_dir).select(batch.columns)
    assert stream.exceptAll(batch).isEmpty() and stream.count() == batch.count()


def test_stream_counters_of_several_batches_and_of_none(spark, tmp_path):
    def latest(n):
        source = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1)
        counted = jobs.counters(source.parquet(str(tmp_path / f"in{n}")), "ts", "kind", lateness="1 hour")
        out = str(tmp_path / f"out{n}")
        found = jobs.run_to_latest(counted, f"{out}/table", f"{out}/state", ["bucket", "scope"])
        return sorted((r["bucket"].second, r["scope"], r["n"]) for r in found.collect())

    rows = spark.sql(
        "SELECT timestamp_seconds(1704067200 + id) AS ts, if(id % 2 = 0, 'a', 'b') AS kind FROM range(25)"
    )
    rows.limit(0).write.parquet(str(tmp_path / "in0"))
    rows.repartition(3).write.parquet(str(tmp_path / "in1"))
    assert latest(0) == []
    assert latest(1) == [(0, "a", 5), (0, "b", 5), (10, "a", 5), (10, "b", 5), (20, "a", 3), (20, "b", 2)]


def test_stream_cache_equals_batch(spark, sf_dir):
    batch = catalog.CATALOG["f5_cache_hits"](spark, sf_dir)
    stream = catalog.CATALOG["f5_stream_cache_hits"](spark, sf_dir)
    assert stream.select(batch.columns).exceptAll(batch).isEmpty() and stream.count() == batch.count()


@pytest.mark.parametrize("lateness", [None, "1 day"])
def test_stream_cache_sorts_all_chunks_of_an_origin(spark, tmp_path, lateness):
    """Days of two micro-batches, each in no order and cut into chunks of two rows."""
    source = str(tmp_path / "in")
    schema = "origin string, ts timestamp, row_id bigint"
    for part, days in enumerate([[5, 20, 21, 0, 1, 8, 26], [28, 27, 60, 40, 33]]):
        rows = [("o", datetime(2024, 1, 1) + timedelta(days=d), d) for d in days]
        rows += [(None, datetime(2024, 1, 2), 100 + part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    chunk = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(chunk)
    for key, value in {**jobs.TTL_SETTINGS, chunk: "2"}.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = str(tmp_path / "out")
        jobs.run_to_table(jobs.cache_hits(stream, 7, lateness), f"{out}/table", f"{out}/state")
    finally:
        spark.conf.set(chunk, before)
    found = {r["row_id"]: r["cached"] for r in spark.read.parquet(f"{out}/table").collect()}
    misses = {0, 8, 20, 27, 40, 60}
    assert found == {d: d not in misses for d in (0, 1, 5, 8, 20, 21, 26, 27, 28, 33, 40, 60)} | {100: None, 101: None}


def test_streamed_sink_is_idempotent(spark, sf_dir, tmp_path):
    schema = corpora.read(spark, sf_dir, "events").schema
    source = str(tmp_path / "in")
    corpora.read(spark, sf_dir, "events").write.parquet(source)
    docs = spark.readStream.schema(schema).parquet(source).select(
        "event_id", F.lit("warc").alias("dataset"), F.lit("2023-50").alias("crawl")
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        jobs.write_index(docs, out, state).awaitTermination()
    written = spark.read.parquet(out)
    assert written.count() == corpora.read(spark, sf_dir, "events").count()
