from datetime import datetime, timezone

from pyspark.sql import functions as F

from sitestance.operators import captures, index
from sitestance.plans import corpora, flows


def test_projection(spark):
    data = {"a": ["1"], "c": [], "parse.meta.x": ["2"], "parse.metax": ["3"]}
    df = spark.createDataFrame([(data,)], "m map<string,array<string>>")
    doc = df.select(index.project(F.col("m"), ["a=b", "c", "parse.meta.*"])).first()[0]
    assert doc == {"b": ["1"], "parse.meta.x": ["2"]}
    both = df.select(index.project(F.col("m"), ["a=b", "parse.metax=b"])).first()[0]
    assert both == {"b": ["1", "3"]}


def test_types(spark):
    doc = {
        "fetcher.file.robots.num-lines": ["14"], "fetcher.file.robots.bias.ccbot": ["-2"], "capturetime": ["1695289671000"],
        "fetcher.file.robots.agents.ccbot": ["false"], "parse.meta.robots": ["a", "b"], "fetcher.file.robots.num-x": ["y"],
    }
    df = spark.createDataFrame([(doc,)], "doc map<string,array<string>>")
    r = index.typed_maps(df).first()
    assert r["integers"] == {"fetcher.file.robots.num-lines": 14, "fetcher.file.robots.bias.ccbot": -2, "fetcher.file.robots.num-x": None}
    assert r["booleans"] == {"fetcher.file.robots.agents.ccbot": False}
    assert r["strings"] == {"parse.meta.robots": ["a", "b"]}
    wide = index.typed_columns(df, ["capturetime", "fetcher.file.robots.num-lines", "title"])
    assert [t for _, t in wide.dtypes] == ["timestamp", "int", "array<string>"]
    moment = wide.select(F.unix_millis("capturetime")).first()[0]
    assert datetime.fromtimestamp(moment / 1000, timezone.utc).year == 2023
    assert index.field_type("fetcher.file.tdmrep.content-length") == "integer"
    assert index.field_type("fetcher.file.robots.url") == "keyword"


def test_no_document_is_dropped(spark, sf_dir):
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages"))
    docs = flows.page_documents(pages, corpora.suffixes(spark))
    assert docs.count() == pages.count()


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, "warc", "2016-50"), (2, "warc", "2017-51")]
    docs = spark.createDataFrame(rows, "id int, dataset string, crawl string")
    index.write_index(docs, path)
    index.write_index(docs.where("id = 1").withColumn("id", F.lit(9)), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 9]


def test_first_documents(spark):
    rows = [(f, o) for f in range(5) for o in range(0, 100, 3)]
    df = spark.createDataFrame(rows, "file_no int, offset int").repartition(7)
    for limit in (0, 1, 33, 34, 35, 100, 170, 500):
        found = captures.first_documents(df, limit, chunk_size=16).collect()
        assert sorted((r["file_no"], r["offset"]) for r in found) == sorted(rows)[:limit], limit
