"""Capture table operators: record filter, headers, lengths, truncation, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance import config
from sitestance.operators import skew


def is_http_response() -> Column:
    """Whether a record of the scan is an HTTP response; null where it names no type."""
    media = F.regexp_replace(F.lower("media_type"), r"\s", "")
    return (
        F.col("error").isNull()
        & (F.col("type") == "response")
        & F.startswith(media, F.lit("application/http"))
        & F.contains(media, F.lit("msgtype=response"))
    )


def http_responses(records: DataFrame) -> DataFrame:
    """HTTP response records of every status; error rows are left out."""
    return records.where(is_http_response())


def scan_errors(records: DataFrame) -> DataFrame:
    """Where and why the rest of a file was skipped."""
    return records.where(F.col("error").isNotNull()).select("file", "offset", "error")


def header_map(headers: Column, prefix: str = "") -> Column:
    """Header lines to ``map<lower-cased name, values in record order>``."""
    names = F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"])))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                F.concat(F.lit(prefix), n).alias("key"), header_values(headers, n).alias("value")
            ),
        )
    )


def header_values(headers: Column, name: Column) -> Column:
    """All values of one header, name compared without regard to case."""
    return F.transform(
        F.filter(headers, lambda h: F.lower(h["name"]) == F.lower(name)), lambda h: h["value"]
    )


def group_headers(headers: DataFrame, key: str, order: str) -> DataFrame:
    """S6, long form: ``(key, order, name, value)`` rows to one row per name.

    Bounded by the header block of one capture.
    """
    return (
        headers.groupBy(key, F.lower("name").alias("name"))
        .agg(F.array_sort(F.collect_list(F.struct(order, "value"))).alias("v"))
        .withColumn("values", F.col("v.value"))
        .drop("v")
    )


def capture_columns(captures: DataFrame) -> DataFrame:
    """The capture metadata as a dotted multimap, one value per key."""
    entries = {
        "fetch.statusCode": F.col("http_status").cast("string"),
        "protocol._request.time_": F.unix_millis("date").cast("string"),
        "protocol._response.ip_": F.col("ip"),
        "protocol._request.headers_": paired_request(),
        "protocol._response.headers_": F.col("http_block"),
        "warc.file.name": F.col("file"),
        "warc.record.offset": F.col("offset").cast("string"),
        "warc.record.length": F.col("length").cast("string"),
    }
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), F.array(v)).alias("value"))
            for k, v in entries.items()
        ]
    )
    fixed = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    # A header may be named like a capture field; the field counts.
    others = F.map_filter(header_map(F.col("headers"), "protocol."), lambda k, _: ~k.isin(*entries))
    return captures.withColumn("metadata", F.map_concat(fixed, others))


def paired_request() -> Column:
    """The latest request before a response, if it belongs to it."""
    request = F.col("preceding_request")
    belongs = F.coalesce(
        F.array_contains(F.col("concurrent_to"), request["record_id"]), F.lit(False)
    ) | F.coalesce(request["target"] == F.col("target"), F.lit(False))
    return F.when(belongs, request["http_block"])


def record_lengths(
    records: DataFrame, file: str = "file", offset: str = "offset", chunk_size: int = 1 << 26
) -> DataFrame:
    """S8 over a table of offsets: next offset in the file minus own offset.

    ``file_size`` closes the last record when the column exists.  A length that is
    not positive is left NULL.
    """
    ranged = skew.next_value(records, file, offset, chunk_size)
    end = F.col("next_position")
    if "file_size" in records.columns:
        end = F.coalesce(end, F.col("file_size"))
    length = end - F.col(offset)
    return ranged.withColumn("length", F.when(length > 0, length)).drop("next_position")


def preceding_requests(records: DataFrame, chunk_size: int = 1 << 26) -> DataFrame:
    """S9 over a table of records: adds the latest request before each record."""
    value = F.when(F.col("type") == "request", F.struct("record_id", "target", "http_block"))
    return skew.last_before(records, "file", "offset", value, chunk_size, "preceding_request")


def truncate(
    captures: DataFrame, limit: int = config.CONTENT_LIMIT, content: str = "content"
) -> DataFrame:
    """Cut the content; adds ``trimmed`` and ``trimmed_reason``.

    A reason given by the archive takes priority over our own cut.  A negative
    limit means no cut.
    """
    full = F.col("full_length") if "full_length" in captures.columns else F.octet_length(content)
    over = F.coalesce(full > limit, F.lit(False)) if limit >= 0 else F.lit(False)
    given = F.lower("truncated") if "truncated" in captures.columns else F.lit(None).cast("string")
    body = F.substring(content, 1, limit) if limit >= 0 else F.col(content)
    return captures.withColumns(
        {
            content: body,
            "trimmed": over | given.isNotNull(),
            "trimmed_reason": F.coalesce(given, F.when(over, F.lit("length"))),
        }
    )


def counters(events: DataFrame, ts: str, scope: str, size: str | None = None) -> DataFrame:
    """Events per scope and time bucket; the same plan serves streams."""
    amount = F.sum(size) if size else F.lit(None).cast("bigint")
    return (
        events.groupBy(F.window(ts, config.COUNTER_BUCKET).alias("w"), F.col(scope).alias("scope"))
        .agg(F.count("*").alias("n"), amount.alias("bytes"))
        .select(F.col("w.start").alias("bucket"), "scope", "n", "bytes")
    )


def record_counters(records: DataFrame) -> DataFrame:
    """S13 with the scan's own scopes: skipped types, responses, statuses, bytes."""
    response = F.col("type") == "response"
    scopes = F.when(
        response,
        F.array(
            F.struct(F.lit("warc_http_response_record").alias("scope"), F.lit(1).alias("by")),
            F.struct(F.lit("fetched").alias("scope"), F.lit(1).alias("by")),
            F.struct(
                F.concat(F.lit("status_"), F.col("http_status")).alias("scope"),
                F.lit(1).alias("by"),
            ),
            F.struct(
                F.lit("bytes_fetched").alias("scope"), F.octet_length("content").alias("by")
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.concat(F.lit("warc_skipped_record_of_type_"), F.col("type")).alias("scope"),
                F.lit(1).alias("by"),
            )
        )
    )
    rows = records.where(F.col("type").isNotNull()).select("date", F.inline(scopes))
    return (
        rows.groupBy(F.window("date", config.COUNTER_BUCKET).alias("w"), "scope")
        .agg(F.sum("by").alias("n"))
        .select(F.col("w.start").alias("bucket"), "scope", "n")
    )


def first_documents(
    captures: DataFrame,
    limit: int,
    file_no: str = "file_no",
    offset: str = "offset",
    chunk_size: int = 1 << 26,
) -> DataFrame:
    """The first ``limit`` documents in (file, offset) order.

    Rows are counted per stretch of a file; the running total names the one stretch
    where the limit falls.  Earlier stretches stay whole, and only that one is
    numbered row by row.  ``orderBy().limit()`` would bring all kept rows into one task.
    """
    if limit <= 0:
        return captures.where(F.lit(False))
    chunked = skew.with_chunk(captures, F.col(offset), chunk_size)
    stretches = chunked.groupBy(file_no, "chunk").agg(F.count("*").alias("n"))
    edge = _edge(stretches, limit, file_no).select(F.struct("f", "c", "take")).scalar()
    marked = chunked.withColumn("_edge", edge)
    where_now = F.struct(F.col(file_no).alias("f"), F.col("chunk").alias("c"))
    where_cut = F.struct(F.col("_edge.f").alias("f"), F.col("_edge.c").alias("c"))
    whole = marked.where(F.col("_edge").isNull() | (where_now < where_cut))
    inside = Window.partitionBy(file_no, "chunk").orderBy(offset)
    part = (
        marked.where(where_now == where_cut)
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") <= F.col("_edge.take"))
        .drop("_rn")
    )
    return whole.unionByName(part).drop("_edge", "chunk")


def _edge(stretches: DataFrame, limit: int, file_no: str) -> DataFrame:
    """The stretch where the limit falls and the rows it gives, ``(f, c, take)``; no row if all fit."""
    files = stretches.groupBy(file_no).agg(F.sum("n").alias("n")).withColumn(
        "block", F.floor(F.col(file_no) / 1000)
    )
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    # One row per thousand files.
    before_block = F.sum("n").over(_before(Window.orderBy("block")))
    block_starts = blocks.select("block", F.coalesce(before_block, F.lit(0)).alias("block_start"))
    before_file = F.sum("n").over(_before(Window.partitionBy("block").orderBy(file_no)))
    file_starts = files.withColumn("in_block", F.coalesce(before_file, F.lit(0))).join(
        block_starts, "block"
    ).select(file_no, (F.col("block_start") + F.col("in_block")).alias("file_start"))
    before_stretch = F.sum("n").over(_before(Window.partitionBy(file_no).orderBy("chunk")))
    start = F.col("file_start") + F.coalesce(before_stretch, F.lit(0))
    return (
        stretches.join(file_starts, file_no)
        .withColumn("start", start)
        .where((F.col("start") < limit) & (F.col("start") + F.col("n") >= limit))
        .select(
            F.col(file_no).alias("f"), F.col("chunk").alias("c"),
            (F.lit(limit) - F.col("start")).alias("take"),
        )
    )


def store_indexed(
    captures: DataFrame,
    path: str,
    file_no: str = "file_no",
    offset: str = "offset",
    chunk_size: int = 1 << 26,
    files_per_part: int = 100,
) -> None:
    """Captures in parts of ``files_per_part`` files, and beside them an offset index.

    The index has one row per stretch of ``chunk_size`` bytes of a file: how many captures begin
    there.  It is counted from the stored rows and written last, so a run that fails leaves
    none.  The names ``_part`` and ``_chunk`` are taken; a capture without file or offset is in no stretch.
    """
    spark = captures.sparkSession
    rows = captures.withColumns(
        {"_part": F.floor(F.col(file_no) / files_per_part), "_chunk": F.floor(F.col(offset) / chunk_size)}
    )
    # A table without rows has no part that tells its columns.
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/columns")
    rows.write.option("compression", "zstd").partitionBy("_part").parquet(f"{path}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    placed = kept.where(F.col(file_no).isNotNull() & F.col("_chunk").isNotNull())
    stretches = placed.groupBy("_part", file_no, F.col("_chunk").alias("chunk")).agg(F.count("*").alias("n"))
    stretches.write.parquet(f"{path}/stretches")


def first_indexed(
    spark: SparkSession, path: str, limit: int, file_no: str = "file_no", offset: str = "offset"
) -> DataFrame:
    """The first ``limit`` captures of a table of :func:`store_indexed`.

    The index alone names the edge, one row with three numbers; parts and files behind it are not
    opened, and of the captures only the edge's stretch is numbered.  Captures in no stretch
    are never among the first.
    """
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    placed = rows.where(F.col(file_no).isNotNull() & F.col("_chunk").isNotNull())
    if limit <= 0:
        return rows.where(F.lit(False)).drop("_part", "_chunk")
    stretches = spark.read.parquet(f"{path}/stretches")
    edge = _edge(stretches, limit, file_no).join(
        stretches.select(F.col(file_no).alias("f"), F.col("chunk").alias("c"), "_part"), ["f", "c"]
    ).first()
    if edge is None:
        return placed.drop("_part", "_chunk")
    near = placed.where((F.col("_part") <= edge["_part"]) & (F.col(file_no) <= edge["f"]))
    whole = near.where((F.col(file_no) < edge["f"]) | (F.col("_chunk") < edge["c"]))
    last = placed.where(
        (F.col("_part") == edge["_part"]) & (F.col(file_no) == edge["f"]) & (F.col("_chunk") == edge["c"])
    )
    numbered = last.withColumn("_rn", F.row_number().over(Window.partitionBy(file_no).orderBy(offset)))
    part = numbered.where(F.col("_rn") <= edge["take"]).drop("_rn")
    return whole.unionByName(part).drop("_part", "_chunk")


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)
