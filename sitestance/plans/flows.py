"""The three whole flows, from captures to index documents.

Each flow adds dotted metadata as ``map<string, array<string>>`` and projects it
with the field mapping, so one row in is one row out.  ``metadata`` of the captures,
where present, is carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions.rows import overlaid
from sitestance.functions.text import decode_page
from sitestance.operators import captures, html, index, metadata, policy, robots
from sitestance.session import prepare
from sitestance.sources import warc


def _single(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("key"), F.when(value.isNotNull(), F.array(value)).alias("value")
    )


def _map(entries: Column) -> Column:
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _site_fields(has_label: bool) -> list[Column]:
    fields = [_single("parse.host", F.col("host")), _single("parse.domain", F.col("domain"))]
    if has_label:
        fields.append(_single(config.LABEL_KEY, F.col("label")))
    return fields


def _with_site(rows: DataFrame, suffixes: DataFrame, labels: DataFrame | None) -> DataFrame:
    sited = metadata.with_domain(metadata.with_host(rows), suffixes)
    return sited if labels is None else metadata.with_label(sited, labels)


def _merged(rows: DataFrame, *maps: Column) -> Column:
    parts = [F.col("metadata")] if "metadata" in rows.columns else []
    return overlaid(*parts, *maps)


# --- from archive records to the flows' inputs ----------------------------------


def _usable() -> Column:
    return (F.coalesce("target", F.lit("")) != "") & F.col("content").isNotNull()


def captured(records: DataFrame, limit: int = config.CONTENT_LIMIT) -> DataFrame:
    """Scan records to captures: responses with a URL, cut to ``limit``, with their metadata.

    What is left out comes from :func:`set_aside`.  Columns of the caller stay.
    """
    good, _ = metadata.quarantine(captures.http_responses(records), ~_usable())
    return captures.capture_columns(captures.truncate(good, limit))


def set_aside(records: DataFrame) -> DataFrame:
    """``(file, offset, error)``: faults of the scan, and responses that no flow can use."""
    _, bad = metadata.quarantine(captures.http_responses(records), ~_usable())
    reason = F.when(F.coalesce("target", F.lit("")) == "", F.lit("response without URL")).otherwise(
        F.lit("response without content")
    )
    return captures.scan_errors(records).unionByName(bad.select("file", "offset", reason.alias("error")))


def store_captures(table: DataFrame, path: str, dataset: str, crawl: str) -> DataFrame:
    """Captures written once under their dataset and crawl, and read back from there.

    Every later step reads this table, so archives are fetched and inflated once however
    often an operator passes over its input.
    """
    part = f"{path}/dataset={dataset}/crawl={crawl}"
    table.drop("dataset", "crawl").write.mode("overwrite").option("compression", "zstd").parquet(part)
    read = table.sparkSession.read.schema(table.drop("dataset", "crawl").schema).parquet(part)
    return read.withColumns({"dataset": F.lit(dataset), "crawl": F.lit(crawl)})


_DONE = "path string, batch string"


def _begun(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, begun without rows if there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ingest(
    paths: DataFrame,
    folder: str,
    dataset: str,
    crawl: str,
    limit: int = config.CONTENT_LIMIT,
    split_bytes: int = warc.SPLIT_BYTES,
) -> DataFrame:
    """Captures of all archives ever named for a crawl; only those not yet read are opened.

    A run writes its captures under a name of its own and, last, lists its archives with that
    name.  Captures of a run that failed before are under no listed name, so they do not count and
    its archives are read again.  An archive that could not be opened is not listed either;
    a damaged one is, up to its fault.  Records are kept beside the captures (``records``), and
    what is set aside comes from :func:`ingest_faults`.  One run at a time may write a crawl.
    """
    spark = paths.sparkSession
    root = f"{folder}/dataset={dataset}/crawl={crawl}"
    listed = _begun(spark, f"{root}/done", _DONE)
    fresh = paths.select("path").distinct().join(listed, "path", "left_anti")
    if not fresh.isEmpty():
        batch = uuid.uuid4().hex
        records = warc.store(fresh, f"{root}/records/{batch}", limit, split_bytes)
        table = captured(records, limit)
        table.write.option("compression", "zstd").parquet(f"{root}/captures/batch={batch}")
        set_aside(records).write.parquet(f"{root}/faults/batch={batch}")
        unread = records.where("error IS NOT NULL AND file_size IS NULL").select(F.col("file").alias("path"))
        done = fresh.join(unread, "path", "left_anti").withColumn("batch", F.lit(batch))
        done.write.mode("append").parquet(f"{root}/done")
    schema = captured(spark.createDataFrame([], warc.SCHEMA), limit).schema
    found = _of_listed_runs(spark, root, "captures", schema)
    return found.withColumns({"dataset": F.lit(dataset), "crawl": F.lit(crawl)})


def ingest_faults(spark: SparkSession, folder: str, dataset: str, crawl: str) -> DataFrame:
    """``(file, offset, error)`` of the listed runs of :func:`ingest`."""
    root = f"{folder}/dataset={dataset}/crawl={crawl}"
    return _of_listed_runs(spark, root, "faults", "file string, offset bigint, error string")


def _of_listed_runs(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    listed = _begun(spark, f"{root}/done", _DONE)
    # The folder of no run keeps the table readable before the first one.
    _begun(spark, f"{root}/{name}/batch=none", schema)
    rows = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    runs = spark.read.schema(listed.schema).parquet(f"{root}/done").select("batch").distinct()
    return rows.join(runs, "batch", "left_semi").drop("batch")


def _content_type() -> Column:
    values = captures.header_values(F.col("headers"), F.lit("content-type"))
    return F.try_element_at(values, F.lit(1))


def captured_pages(table: DataFrame) -> DataFrame:
    """Captures to ``pages(url, html, headers, metadata, …)``, decoded as the page declares."""
    return table.withColumns(
        {"url": F.col("target"), "html": decode_page(F.col("content"), _content_type())}
    ).drop(*_CAPTURE_ONLY, "content", "target")


def captured_robots(table: DataFrame) -> DataFrame:
    """Captures to ``robots(url, status, content_type, content, metadata, …)``."""
    return table.withColumns(
        {"url": F.col("target"), "status": F.col("http_status"), "content_type": _content_type()}
    ).drop(*_CAPTURE_ONLY, "headers", "target")


_CAPTURE_ONLY = [
    "type", "media_type", "record_id", "concurrent_to", "http_status", "http_block", "full_length",
    "decode_status", "preceding_request", "error", "trimmed", "trimmed_reason", "truncated",
    "date", "ip", "file", "file_size", "offset", "length",
]


# --- the flows -----------------------------------------------------------------


def page_metadata(
    pages: DataFrame, suffixes: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """H0, M1 - M7: ``pages(url, html, headers, …)`` to rows with a ``metadata`` map."""
    annotated = html.annotate(pages)
    with_headers = annotated.withColumn(
        "annotations",
        metadata.refine(
            F.concat("annotations", metadata.pick_headers(F.col("headers")))
        ),
    ).drop("headers")
    sited = _with_site(with_headers, suffixes, labels)
    parsed = F.map_from_entries(
        F.transform("annotations", lambda a: F.struct(a["key"], a["values"]))
    )
    site = _map(F.array(*_site_fields(labels is not None)))
    return sited.withColumn("metadata", _merged(sited, parsed, site)).drop(
        "annotations", "host", "domain", "label"
    )


def page_documents(
    pages: DataFrame,
    suffixes: DataFrame,
    labels: DataFrame | None = None,
    mapping: list[str] | None = None,
) -> DataFrame:
    """The page flow: annotations, headers, site fields, projection."""
    prepare(pages.sparkSession)
    rows = page_metadata(pages, suffixes, labels)
    return rows.withColumn("doc", index.project(F.col("metadata"), mapping)).drop("metadata")


def fetched_page_documents(
    pages: DataFrame,
    policies: DataFrame,
    suffixes: DataFrame,
    labels: DataFrame | None = None,
    fetch_time: Column | None = None,
    mapping: list[str] | None = None,
    ts: str | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """The fetch flow: the page flow plus robots verdicts and TDM of the origin.

    The HTML is reduced to annotations before the join, so it is never shuffled.
    With the columns ``ts``, when a page was fetched, and ``row_id``, unique to a row, the
    flow says whether the policy came from the cache (F5); else a column ``cached`` of the
    pages does, if there is one.
    """
    prepare(pages.sparkSession)
    rows = page_metadata(policy.validate(pages), suffixes, labels)
    if ts is not None and row_id is not None:
        rows = policy.cache_hits(policy.with_origin(rows.drop("cached")), "origin", ts, row_id)
    judged = policy.page_policies(rows, policies)
    time = F.current_timestamp() if fetch_time is None else fetch_time
    cached = F.col("cached") if "cached" in judged.columns else F.lit(None).cast("boolean")
    invalid = F.col("error").isNotNull()
    fetched = F.when(
        invalid,
        F.create_map(F.lit(f"{config.METADATA_PREFIX}error"), F.array(F.col("error"))),
    ).otherwise(policy.fetch_metadata(time, cached))
    merged = judged.withColumn("metadata", overlaid(F.col("metadata"), fetched))
    return merged.withColumn("doc", index.project(F.col("metadata"), mapping)).drop(
        "metadata", "denied", "robots", "tdmrep", "origin", "error", "cached"
    )


def robots_documents(
    docs: DataFrame,
    suffixes: DataFrame,
    labels: DataFrame | None = None,
    agents: list[str] | None = None,
    mapping: list[str] | None = None,
) -> DataFrame:
    """The robots.txt flow: statistics, site fields, projection."""
    prepare(docs.sparkSession)
    profiles = robots.profile(docs, agents)
    stats = robots.as_metadata(profiles, f"{config.METADATA_PREFIX}robots.")
    keep = [c for c in ("doc_id", "crawl", "dataset", "url", "metadata") if c in docs.columns]
    sited = _with_site(profiles.select(*keep, stats.alias("stats")), suffixes, labels)
    site = _map(F.array(*_site_fields(labels is not None)))
    doc = index.project(_merged(sited, F.col("stats"), site), mapping)
    return sited.withColumn("doc", doc).drop("metadata", "stats", "host", "domain", "label")
