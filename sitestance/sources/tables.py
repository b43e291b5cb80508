"""Small inputs: path lists (S1, S2), label tables (S14), the crawl registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitestance import config


def path_list(spark: SparkSession, folder: str, file_filter: str = "*") -> DataFrame:
    """Archive paths of all list files in a folder, ``(list_file, file_no, path)``.

    A list names the files of one crawl, a few megabytes at most, so each list is
    read as one value and numbered in place: the number does not depend on splits.
    """
    lists = (
        spark.read.option("pathGlobFilter", file_filter)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("list_file"), "value")
    )
    rows = lists.select("list_file", F.posexplode(F.split("value", "\r?\n", -1)).alias("file_no", "path"))
    return rows.where(F.btrim("path") != "").withColumn("path", F.btrim("path"))


def with_root(paths: DataFrame, root: str) -> DataFrame:
    """Put a file-system root before each relative path."""
    joint = "" if root.endswith("/") else "/"
    return paths.withColumn("path", F.concat(F.lit(root + joint), F.col("path")))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``host,label`` lines to ``(host, label)``.

    The first line of a file is a heading, only the first comma separates, blanks
    are dropped and the last line of a host wins.  The position of a line is the
    start of its split plus its place in the split, so large files stay splittable.
    """
    rows = (
        spark.read.option("sep", "\u0001")
        .option("quote", "")
        .option("header", True)
        .schema("line string")
        .csv(path)
    )
    position = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    parts = F.split(F.btrim("line"), ",", 2)
    placed = rows.select(parts.alias("p"), position.alias("position")).where(F.size("p") == 2)
    return (
        placed.select(
            F.btrim(F.col("p")[0]).alias("host"), F.btrim(F.col("p")[1]).alias("label"), "position"
        )
        .where((F.col("host") != "") & (F.col("label") != ""))
        .groupBy("host")
        .agg(F.max_by("label", "position").alias("label"))
    )


def crawls(spark: SparkSession, root: str = "/data/input") -> DataFrame:
    """Crawl and dataset to input folder, path list and index name."""
    named = {"warc": "warc", "robotstxt": "robots"}
    rows = [
        (crawl, dataset, f"{root}/{crawl}/", paths, f"content-{named[dataset]}-{crawl}")
        for crawl in config.CRAWLS
        for dataset, paths in config.DATASETS.items()
    ]
    return spark.createDataFrame(
        rows, "crawl string, dataset string, input_dir string, paths string, index_name string"
    )
