"""Every operator as a query over the given tables: ``name -> (spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import rows, text, url
from sitestance.operators import captures, html, index, metadata, policy, robots, sketches, study, tdm
from sitestance.plans import archives, corpora, flows
from sitestance.session import prepare, shared_dir
from sitestance.sources import tables, warc
from sitestance.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; it runs with the package's session settings."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    CATALOG[fn.__name__] = run
    return run


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _joined(name: str, sep: str = "|") -> Column:
    return F.array_join(name, sep).alias(name)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _millis(name: str) -> Column:
    return F.unix_millis(name)


# --- sources -------------------------------------------------------------------


@query
def s1_path_list(spark, sf_dir):
    """Lists of archive paths written from ``pages``, then read and numbered."""
    folder = _folder(spark, "paths")
    pages = corpora.read(spark, sf_dir, "pages")
    lines = pages.select(F.concat(F.lit("crawl-data/"), "page_id", F.lit(".warc.gz")).alias("line"))
    lines.write.text(folder)
    listed = tables.with_root(tables.path_list(spark, folder, "part-*"), "/archive")
    return listed.select("path", (F.col("file_no") >= 0).alias("numbered"))


@query
def s3_warc_scan(spark, sf_dir):
    """Archives written from ``pages``, scanned back through ``format("warc")``."""
    return captures.http_responses(_records(spark, sf_dir)).select(
        F.col("target").alias("url"),
        *_long("http_status", "full_length"),
        "decode_status",
        F.md5("content").alias("content_md5"),
        (F.col("length") > 0).alias("has_length"),
    )


def _records(spark, sf_dir) -> DataFrame:
    folder = archives.write(corpora.read(spark, sf_dir, "pages"), _folder(spark, "warc"))
    warc.register(spark)
    return spark.read.format("warc").option("limit", archives.LIMIT).load(folder)


@query
def s4_record_types(spark, sf_dir):
    """All records of the archives by type, and how many are HTTP responses."""
    records = _records(spark, sf_dir)
    return records.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if(captures.is_http_response()).alias("responses")
    )


@query
def s5_statuses(spark, sf_dir):
    """Responses of every status are kept."""
    kept = captures.http_responses(_records(spark, sf_dir))
    return kept.groupBy(F.col("http_status").cast("bigint").alias("status")).agg(
        F.count("*").alias("n")
    )


@query
def s10_verbatim_headers(spark, sf_dir):
    """Literal header blocks of the response and of the request that belongs to it."""
    kept = captures.http_responses(_records(spark, sf_dir))
    return kept.select(
        F.col("target").alias("url"),
        F.md5("http_block").alias("response_headers_md5"),
        F.md5(captures.paired_request()).alias("request_headers_md5"),
    )


@query
def s11_decoding(spark, sf_dir):
    """How the bodies were decoded, and how many bytes came out."""
    kept = captures.http_responses(_records(spark, sf_dir))
    return kept.groupBy("decode_status").agg(
        F.count("*").alias("n"), F.sum("full_length").alias("bytes")
    )


@query
def s13_record_counters(spark, sf_dir):
    """The scan's own counters per ten-second bucket."""
    counted = captures.record_counters(_records(spark, sf_dir))
    return counted.select(_millis("bucket").alias("bucket"), "scope", *_long("n"))


@query
def s3_warc_path_scan(spark, sf_dir):
    """The same records, read from a table of paths; lengths add up to the file size."""
    folder = archives.write(corpora.read(spark, sf_dir, "pages"), _folder(spark, "warc"))
    files = spark.read.format("binaryFile").load(folder).select(F.col("path"))
    records = warc.scan(files, archives.LIMIT)
    whole = records.groupBy("file").agg(
        F.sum("length").alias("total"), F.max("file_size").alias("size"), F.count("*").alias("n")
    )
    return whole.agg(
        F.sum("n").alias("records"), F.bool_and(F.col("total") == F.col("size")).alias("complete")
    )


@query
def s3_split_scan(spark, sf_dir):
    """Requests and responses of archives read in ranges of 16 KiB, with the request before each."""
    folder = archives.write(corpora.read(spark, sf_dir, "pages"), _folder(spark, "warc"))
    files = spark.read.format("binaryFile").load(folder).select("path")
    records = warc.store(files, _folder(spark, "records"), archives.LIMIT, split_bytes=1 << 14)
    return records.where("type <> 'warcinfo'").select(
        F.col("target").alias("url"),
        "type",
        F.col("preceding_request.target").alias("request_url"),
        F.md5("content").alias("content_md5"),
        *_long("full_length"),
    )


@query
def s6_header_map(spark, sf_dir):
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages"))
    mapped = rows.map_rows(pages, ["page_id"], captures.header_map(F.col("headers")), "name", "values")
    return mapped.select("page_id", "name", _joined("values"))


@query
def s6_header_groups(spark, sf_dir):
    """The long form of the multimap: header rows grouped by capture and name."""
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages"))
    lines = rows.numbered(pages, ["page_id"], "headers", "pos", "h").select(
        "page_id", "pos", "h.name", "h.value"
    )
    return captures.group_headers(lines, "page_id", "pos").select("page_id", "name", _joined("values"))


@query
def s7_capture_columns(spark, sf_dir):
    """Status, time, file and offset of every response as multimap entries."""
    found = captures.capture_columns(captures.http_responses(_records(spark, sf_dir)))
    entry = lambda key: F.try_element_at("metadata", F.lit(key))[0]
    return found.select(
        F.col("target").alias("url"),
        entry("fetch.statusCode").alias("status"),
        entry("protocol._request.time_").alias("request_time"),
        entry("protocol._response.ip_").alias("ip"),
        F.regexp_extract(entry("protocol._request.headers_"), r"^(\S+ \S+)", 1).alias("request_line"),
        entry("protocol.content-type").alias("content_type"),
        entry("warc.record.offset").isNotNull().alias("has_offset"),
    )


@query
def s8_record_lengths(spark, sf_dir):
    """Next offset minus own offset, with users as files and events as records."""
    events = corpora.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("offset")
    )
    return captures.record_lengths(events, chunk_size=1024).select("file", "offset", "length")


@query
def s9_preceding_request(spark, sf_dir):
    """Errors as requests: the latest one before each event, and whether it belongs."""
    events = corpora.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("offset"),
        F.when(F.col("event_type") == "error", F.lit("request")).otherwise(F.lit("response")).alias("type"),
        F.col("event_id").cast("string").alias("record_id"),
        (F.col("event_id") % 3).cast("string").alias("target"),
        F.array((F.col("event_id") - 7).cast("string")).alias("concurrent_to"),
        F.concat(F.lit("GET "), F.col("event_id")).alias("http_block"),
    )
    paired = captures.preceding_requests(events, chunk_size=1024)
    return paired.select(
        "file", "offset",
        F.col("preceding_request.record_id").alias("request_id"),
        captures.paired_request().alias("request_headers"),
    )


@query
def s12_truncation(spark, sf_dir):
    pages = corpora.read(spark, sf_dir, "pages").select(
        "page_id",
        F.encode("html", "UTF-8").alias("content"),
        F.when(F.col("page_id") % 10 == 0, F.lit("DISCONNECT")).alias("truncated"),
    )
    cut = captures.truncate(pages, 2048)
    return cut.select(
        "page_id", F.octet_length("content").cast("bigint").alias("content_length"),
        "trimmed", "trimmed_reason", F.md5("content").alias("content_md5"),
    )


@query
def s13_counters(spark, sf_dir):
    events = corpora.read(spark, sf_dir, "events").withColumn("size", F.length("props"))
    counted = captures.counters(events, "ts", "event_type", "size")
    return counted.select(_millis("bucket").alias("bucket"), "scope", *_long("n", "bytes"))


@query
def s13_stream_counters(spark, sf_dir):
    """The same counters as a stream behind a watermark, drained into a table."""
    stream = corpora.event_stream(spark, sf_dir).withColumn("size", F.length("props"))
    counted = jobs.counters(stream, "ts", "event_type", "size", "1 day")
    out = _folder(spark, "counters")
    table = jobs.run_to_latest(counted, f"{out}/table", f"{out}/state", ["bucket", "scope"])
    return table.select(_millis("bucket").alias("bucket"), "scope", *_long("n", "bytes"))


@query
def s14_labels(spark, sf_dir):
    """A label file written from the hosts of ``pages``, loaded back."""
    folder = _folder(spark, "labels")
    hosts = corpora.read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host")).distinct()
    line = F.concat(
        F.lit(" "), "host", F.lit(" , "), F.coalesce(F.expr(corpora.LABEL), F.lit("")), F.lit(" ")
    )
    hosts.select(line.alias("host,label")).write.option("header", True).option("sep", "\u0001").option(
        "quote", ""
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return tables.labels(spark, folder)


@query
def s15_crawl_registry(spark, sf_dir):
    """Documents per registered crawl, with the index they go to."""
    docs = corpora.robots(spark, sf_dir).groupBy("crawl").agg(F.count("*").alias("docs"))
    registry = tables.crawls(spark).where(F.col("dataset") == "robotstxt")
    return registry.join(docs, "crawl", "left").select(
        "crawl", "dataset", "input_dir", "paths", "index_name",
        F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs"),
    )


@query
def s16_first_documents(spark, sf_dir):
    """The first 20,000 lines in (file, offset) order, orders dealt out to 13 files."""
    return captures.first_documents(_dealt_lines(spark, sf_dir), 20_000, chunk_size=1 << 12)


@query
def s16_stored_index(spark, sf_dir):
    """The same lines from a table stored with its offset index; files behind the edge stay closed."""
    folder = _folder(spark, "indexed")
    captures.store_indexed(_dealt_lines(spark, sf_dir), folder, chunk_size=1 << 12, files_per_part=1)
    return captures.first_indexed(spark, folder, 20_000)


def _dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 13).alias("file_no"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("offset"),
    )


# --- HTML annotations -------------------------------------------------------------


@query
def h0_annotations(spark, sf_dir):
    annotated = html.annotate(corpora.annotated_pages(spark, sf_dir))
    return html.annotation_rows(annotated, "page_id").select("page_id", "key", *_long("pos"), "value")


def _annotation_query(key: str) -> Query:
    def run(spark, sf_dir):
        pages = corpora.annotated_pages(spark, sf_dir)
        annotated = html.annotate(pages, selectors={key: config.SELECTORS[key]})
        return html.annotation_rows(annotated, "page_id").select("page_id", *_long("pos"), "value")

    return run


def annotation_query_names() -> dict[str, str]:
    """Query name of every annotation key, numbered in list order."""
    return {
        f"h{n}_{key.removeprefix('parse.').replace('.', '_').replace('-', '_')}": key
        for n, key in enumerate(config.SELECTORS, 1)
    }


for _name, _key in annotation_query_names().items():
    _fn = _annotation_query(_key)
    _fn.__name__ = _name
    query(_fn)


# --- page metadata ------------------------------------------------------------------


@query
def m1_host(spark, sf_dir):
    return metadata.with_host(corpora.read(spark, sf_dir, "pages")).select("page_id", "host")


@query
def m2_domain(spark, sf_dir):
    pages = metadata.with_host(corpora.read(spark, sf_dir, "pages"))
    return metadata.with_domain(pages, corpora.suffixes(spark)).select("page_id", "host", "domain")


@query
def m3_headers(spark, sf_dir):
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages"))
    picked = rows.inlined(pages, ["page_id"], metadata.pick_headers(F.col("headers")), "key")
    return picked.select("page_id", "key", _joined("values"))


def _refined(spark, sf_dir) -> DataFrame:
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages"))
    annotated = html.annotate(
        pages.select("page_id", "headers", *corpora._expressions(
            {k: v for k, v in corpora.PAGE_COLUMNS.items() if k in ("crawl", "url", "html")}
        ))
    )
    both = F.concat("annotations", metadata.pick_headers(F.col("headers")))
    return annotated.withColumn("annotations", metadata.refine(both)).drop("headers")


@query
def m4_comma_split(spark, sf_dir):
    values = html.annotation_rows(_refined(spark, sf_dir), "page_id")
    return values.where(F.col("key").isin("parse.keywords", "parse.http.x-robots-tag")).select(
        "page_id", "key", *_long("pos"), "value"
    )


@query
def m5_directives(spark, sf_dir):
    per_key = rows.inlined(_refined(spark, sf_dir), ["page_id"], "annotations", "key")
    return per_key.where(F.col("key") == config.DIRECTIVE_KEY).select(
        "page_id", F.array_join("values", "|").alias("directives")
    )


@query
def m6_labels(spark, sf_dir):
    pages = metadata.with_host(corpora.read(spark, sf_dir, "pages"))
    return metadata.with_label(pages, corpora.labels(spark, sf_dir)).select("page_id", "host", "label")


@query
def m7_page_records(spark, sf_dir):
    """What stays of a page: no text and no links, one row per page."""
    kept = metadata.with_host(html.annotate(corpora.annotated_pages(spark, sf_dir)))
    return kept.select("page_id", "crawl", "url", "host", F.size("annotations").cast("bigint").alias("keys"))


@query
def m8_quarantine(spark, sf_dir):
    """TDM files that cannot be read are set aside, with the reason."""
    profiles = tdm.profile(corpora.tdmrep(spark, sf_dir))
    _, bad = metadata.quarantine(profiles, F.col("error").isNotNull())
    return bad.select("doc_id", "error")


# --- robots.txt -----------------------------------------------------------------------


def _profiles(spark, sf_dir) -> DataFrame:
    return robots.profile(corpora.robots(spark, sf_dir))


def _parsed(spark, sf_dir) -> DataFrame:
    return robots.parse(corpora.robots(spark, sf_dir))


@query
def r1_early_outs(spark, sf_dir):
    return robots.admit(corpora.robots(spark, sf_dir)).select(
        "doc_id", *_long("content_length"), "content_type", "is_parsed"
    )


@query
def r2_decoded(spark, sf_dir):
    docs = corpora.robots(spark, sf_dir)
    return docs.select("doc_id", F.md5(text.decode_text(F.col("content"))).alias("text_md5"))


@query
def r3_lines(spark, sf_dir):
    return robots.raw_line_rows(corpora.robots(spark, sf_dir)).select("doc_id", *_long("n"), "raw")


@query
def r4_num_lines(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", *_long("num_lines"))


@query
def r5_stripped_lines(spark, sf_dir):
    """How many lines are left once comments and blanks are gone."""
    return _parsed(spark, sf_dir).where(F.col("is_parsed")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("kept_lines")
    )


@query
def r6_directives(spark, sf_dir):
    return robots.lines(_parsed(spark, sf_dir)).select("doc_id", *_long("n"), "directive", "value")


@query
def r7_groups(spark, sf_dir):
    return robots.agent_groups(_parsed(spark, sf_dir)).select(
        "doc_id", *_long("grp"), _joined("agents"), F.size("rules").cast("bigint").alias("num_rules")
    )


@query
def r8_rule_counts(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "doc_id", *_long("num_disallow", "num_disallow_empty", "num_allow")
    )


@query
def r9_user_agents(spark, sf_dir):
    return _profiles(spark, sf_dir).select("doc_id", *_long("num_useragents"), _joined("useragents"))


@query
def r10_sitemaps(spark, sf_dir):
    return _profiles(spark, sf_dir).select("doc_id", *_long("num_sitemaps"), _joined("sitemaps"))


@query
def r11_crawl_delay(spark, sf_dir):
    return _profiles(spark, sf_dir).select("doc_id", *_long("crawldelay"))


@query
def r12_agent_counts(spark, sf_dir):
    return robots.agent_counts(_profiles(spark, sf_dir)).select(
        "doc_id", "agent", *_long("num_allow", "num_disallow", "num_disallow_empty")
    )


@query
def r13_directories(spark, sf_dir):
    return rows.exploded(_profiles(spark, sf_dir), ["doc_id"], "directories", "directory")


@query
def r14_verdicts(spark, sf_dir):
    """Each page's path against the robots.txt of its own row: agents denied."""
    probes = corpora.read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), url.path_query(F.col("url")).alias("path")
    )
    return robots.verdicts(probes, _parsed(spark, sf_dir))


@query
def r15_blanket_bans(spark, sf_dir):
    return (
        robots.agent_rows(_profiles(spark, sf_dir))
        .where("disallow_all")
        .select("doc_id", robots.agent_label(F.col("agent")).alias("agent"))
    )


@query
def r16_bias(spark, sf_dir):
    return (
        robots.agent_rows(_profiles(spark, sf_dir))
        .where(F.col("bias").isNotNull())
        .select("doc_id", "agent", *_long("bias"))
    )


@query
def r17_probe_base(spark, sf_dir):
    """Probe prefix of robots.txt URLs and, for the odd case, of page URLs."""
    pages = corpora.read(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        robots.probe_base(F.concat(F.expr(corpora.SITE), F.lit("/robots.txt"))).alias("of_robots"),
        robots.probe_base(F.col("url")).alias("of_page"),
    )


@query
def r18_status_fields(spark, sf_dir):
    """The statistics as dotted names, long form."""
    profiles = _profiles(spark, sf_dir)
    fields = robots.as_metadata(profiles, "fetcher.file.robots.")
    return rows.map_rows(profiles, ["doc_id"], fields, "field", "values").select(
        "doc_id", "field", _joined("values")
    )


@query
def r19_profile(spark, sf_dir):
    bans = F.size(F.filter("agents", lambda a: a["disallow_all"]))
    bias = F.aggregate("agents", F.lit(0), lambda s, a: s + F.coalesce(a["bias"], F.lit(0)))
    return _profiles(spark, sf_dir).select(
        "doc_id", "crawl", "url", *_long("status"), "content_type", "is_parsed",
        *_long(
            "content_length", "num_lines", "num_disallow", "num_disallow_empty", "num_allow",
            "num_sitemaps", "num_useragents", "crawldelay",
        ),
        F.size("directories").cast("bigint").alias("num_directories"),
        bans.cast("bigint").alias("bans"),
        bias.cast("bigint").alias("bias_sum"),
    )


# --- TDM ----------------------------------------------------------------------------------


@query
def t1_admitted(spark, sf_dir):
    return robots.admit(corpora.tdmrep(spark, sf_dir)).select(
        "doc_id", *_long("content_length"), "content_type", "is_parsed"
    )


@query
def t2_groups(spark, sf_dir):
    return tdm.profile(corpora.tdmrep(spark, sf_dir)).select("doc_id", *_long("num_groups"), "error")


@query
def t3_coerced(spark, sf_dir):
    """Reservation values after coercion, counted."""
    groups = tdm.group_rows(tdm.profile(corpora.tdmrep(spark, sf_dir)), "doc_id")
    return groups.groupBy(F.col("tdm_reservation").cast("bigint").alias("reservation")).agg(
        F.count("*").alias("n"), F.count("tdm_policy").alias("with_policy")
    )


@query
def t4_rendered(spark, sf_dir):
    return tdm.profile(corpora.tdmrep(spark, sf_dir)).select("doc_id", "groups_text")


@query
def t5_group_rows(spark, sf_dir):
    groups = tdm.group_rows(tdm.profile(corpora.tdmrep(spark, sf_dir)), "doc_id")
    return groups.select("doc_id", *_long("pos"), "location", *_long("tdm_reservation"), "tdm_policy")


# --- page and origin policy ------------------------------------------------------------------


def _odd_urls(spark, sf_dir) -> DataFrame:
    """``pages`` with some URLs blank or broken."""
    broken = F.expr(
        "CASE page_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN substr(url, 5)"
        " WHEN 2 THEN concat('HTTP://Ex_A.org:8080/a|b/', url) ELSE url END"
    )
    return corpora.read(spark, sf_dir, "pages").select("page_id", broken.alias("url"))


@query
def f1_validated(spark, sf_dir):
    return policy.validate(_odd_urls(spark, sf_dir)).select("page_id", "url", "error")


@query
def f2_origin(spark, sf_dir):
    return policy.with_origin(_odd_urls(spark, sf_dir)).select("page_id", "origin")


@query
def f3_policy_urls(spark, sf_dir):
    return policy.policy_urls(corpora.read(spark, sf_dir, "pages")).select(
        "page_id", "robots_url", "tdmrep_url"
    )


def _starts(spark, sf_dir) -> DataFrame:
    pages = corpora.read(spark, sf_dir, "pages").select("url")
    nothing = spark.createDataFrame([], "origin string")
    return policy.work_list(pages, nothing)


@query
def f4_work_list(spark, sf_dir):
    """Origins still to fetch: those without a robots.txt answered in the log."""
    log = corpora.fetches(spark, sf_dir)
    fresh = policy.with_origin(log.where((F.col("kind") == "robots") & (F.col("status") == 200)))
    pages = corpora.read(spark, sf_dir, "pages")
    return policy.work_list(pages.select("url"), fresh.select("origin"))


def _requests(spark, sf_dir) -> DataFrame:
    return corpora.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("origin"), "ts", F.col("event_id").alias("page_id")
    )


@query
def f5_cache_hits(spark, sf_dir):
    return policy.cache_hits(_requests(spark, sf_dir)).select(
        F.col("page_id").alias("event_id"), "origin", "cached"
    )


@query
def f5_stream_cache_hits(spark, sf_dir):
    """The same with keyed state on a stream."""
    for key, value in jobs.TTL_SETTINGS.items():
        spark.conf.set(key, value)
    stream = corpora.event_stream(spark, sf_dir)
    hits = jobs.cache_hits(jobs.event_stream(stream))
    out = _folder(spark, "cache")
    jobs.run_to_table(hits, f"{out}/table", f"{out}/state")
    return spark.read.schema(hits.schema).parquet(f"{out}/table").select(
        F.col("row_id").alias("event_id"), F.col("origin").cast("bigint").alias("origin"), "cached"
    )


@query
def f6_redirects(spark, sf_dir):
    starts = policy.policy_starts(_starts(spark, sf_dir)).where(F.col("kind") == "robots")
    resolved = policy.resolve_redirects(corpora.fetches(spark, sf_dir), starts)
    return resolved.select("origin", "url", "final_url", *_long("code", "num_redirects"), "error")


@query
def f7_shortcuts(spark, sf_dir):
    """Redirects to the policy file of an origin whose result is already known."""
    starts = policy.policy_starts(_starts(spark, sf_dir)).where(F.col("kind") == "robots")
    known = spark.createDataFrame(
        [("robots", "https:hot.example.org:443", "https://cdn.example.org/r.txt", 200, 3, None)],
        "kind string, origin string, final_url string, code int, num_redirects int, error string",
    )
    resolved = policy.resolve_redirects(corpora.fetches(spark, sf_dir), starts, known)
    return resolved.select("origin", "final_url", *_long("code", "num_redirects"), "error")


def _policies(spark, sf_dir) -> DataFrame:
    return policy.origin_policies(corpora.fetches(spark, sf_dir), _starts(spark, sf_dir))


def _judged(spark, sf_dir) -> DataFrame:
    pages = corpora.read(spark, sf_dir, "pages").select("page_id", "url", F.expr(corpora.CRAWL).alias("crawl"))
    return policy.page_policies(pages, _policies(spark, sf_dir))


@query
def f8_fetch_failures(spark, sf_dir):
    """Origins whose robots.txt could not be had, and how many rule sets bind there."""
    sets = F.coalesce(F.size("rule_sets"), F.lit(0)).cast("bigint")
    return _policies(spark, sf_dir).select(
        "origin", F.col("robots.error").alias("error"), (sets > 0).alias("has_rules")
    )


@query
def f9_page_verdicts(spark, sf_dir):
    return policy.denied_agents(_judged(spark, sf_dir), "page_id")


@query
def f9_verdicts_wide(spark, sf_dir):
    wide = policy.denied_wide(_judged(spark, sf_dir).select("page_id", "denied"))
    keys = [config.REFERENCE_AGENT, *config.agent_keys()]
    return wide.select("page_id", *[F.col(f"`agents.{a}`").alias(a.replace("-", "_").lower()) for a in keys])


@query
def f10_page_tdm(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "page_id",
        F.col("tdmrep.final_url").alias("tdm_url"),
        F.col("tdmrep.code").cast("bigint").alias("tdm_code"),
        F.col("tdmrep.file.num_groups").cast("bigint").alias("num_groups"),
        F.coalesce("tdmrep.error", "tdmrep.file.parse_error").alias("tdm_error"),
    )


@query
def f11_fetch_fields(spark, sf_dir):
    """All fields a fetch adds to a page, long form."""
    judged = _judged(spark, sf_dir)
    time = F.lit("2024-01-01 00:00:00").cast("timestamp")
    fields = policy.fetch_metadata(time, F.lit(True))
    return rows.map_rows(judged, ["page_id"], fields, "field", "values").select(
        "page_id", "field", _joined("values")
    )


# --- index -------------------------------------------------------------------------------------


def _page_docs(spark, sf_dir) -> DataFrame:
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages")).select(
        "headers", *corpora._expressions(corpora.PAGE_COLUMNS)
    )
    stamp = F.create_map(
        F.lit("protocol._request.time_"),
        F.array((F.lit(1_695_289_671_000) + F.col("page_id")).cast("string")),
        F.lit("fetch.statusCode"),
        F.array(F.lit("200")),
        F.lit("warc.file.name"),
        F.array().cast("array<string>"),
    )
    return flows.page_documents(
        pages.withColumn("metadata", stamp), corpora.suffixes(spark), corpora.labels(spark, sf_dir)
    )


def _fields(docs: DataFrame, key: str) -> DataFrame:
    return rows.map_rows(docs, [key], "doc", "field", "values").select(
        key, "field", _joined("values")
    )


@query
def e1_all_documents(spark, sf_dir):
    """No page is filtered out, ``noindex`` or not."""
    docs = _page_docs(spark, sf_dir)
    directives = F.try_element_at("doc", F.lit(config.DIRECTIVE_KEY))
    return docs.groupBy("crawl").agg(
        F.count("*").alias("docs"),
        F.count_if(F.coalesce(F.array_contains(directives, "noindex"), F.lit(False))).alias("noindex"),
    )


@query
def e2_projection(spark, sf_dir):
    return _fields(_page_docs(spark, sf_dir), "page_id")


@query
def e3_newest_per_url(spark, sf_dir):
    """Two captures of a host's page compete for one key; the later one stays."""
    pages = corpora.read(spark, sf_dir, "pages").select(
        "page_id", F.expr(corpora.SITE).alias("url"), F.length("html").cast("bigint").alias("size")
    )
    return index.newest_per_url(pages, "page_id").select("url", "page_id", "size")


@query
def e4_typed_fields(spark, sf_dir):
    """Typed maps of robots documents, counted per type."""
    docs = flows.robots_documents(corpora.robots(spark, sf_dir), corpora.suffixes(spark))
    typed = index.typed_maps(docs)
    return typed.select(
        "doc_id",
        F.try_element_at("integers", F.lit("fetcher.file.robots.num-lines")).cast("bigint").alias("num_lines"),
        F.try_element_at("integers", F.lit("fetcher.file.robots.content-length")).cast("bigint").alias("content_length"),
        F.try_element_at("integers", F.lit("fetcher.file.robots.bias.gptbot")).cast("bigint").alias("bias_gptbot"),
        F.coalesce(
            F.try_element_at("booleans", F.lit("fetcher.file.robots.disallow-all.gptbot")), F.lit(False)
        ).alias("ban_gptbot"),
        F.size("integers").cast("bigint").alias("integers"),
        F.size("booleans").cast("bigint").alias("booleans"),
    )


@query
def e4_typed_columns(spark, sf_dir):
    docs = _page_docs(spark, sf_dir)
    typed = index.typed_columns(docs, ["host", "title", "capturetime", "parse.html.language"], "doc", "page_id")
    return typed.select(
        "page_id",
        F.col("host")[0].alias("host"),
        F.col("title")[0].alias("title"),
        _millis("capturetime").alias("capturetime"),
        F.col("`parse.html.language`")[0].alias("language"),
    )


@query
def e5_partitioned_sink(spark, sf_dir):
    """Documents written per dataset and crawl, then read back from one partition each."""
    folder = _folder(spark, "index")
    docs = corpora.robots(spark, sf_dir).select(
        "doc_id", "url", F.lit("robotstxt").alias("dataset"), "crawl"
    )
    index.write_index(docs, folder)
    return spark.read.parquet(folder).groupBy(
        "dataset", F.col("crawl").cast("string").alias("crawl")
    ).agg(F.count("*").alias("docs"))


@query
def e6_robots_documents(spark, sf_dir):
    docs = flows.robots_documents(
        corpora.robots(spark, sf_dir), corpora.suffixes(spark), corpora.labels(spark, sf_dir)
    )
    return _fields(docs, "doc_id")


@query
def e6_page_documents(spark, sf_dir):
    docs = _page_docs(spark, sf_dir)
    return docs.select("page_id", "crawl", "url", F.size("doc").cast("bigint").alias("fields"))


@query
def e6_captured_page_documents(spark, sf_dir):
    """From archives to page documents, by way of a stored capture table."""
    pages = corpora.read(spark, sf_dir, "pages").select(*corpora._expressions(corpora.PAGE_COLUMNS))
    folder = archives.write(pages, _folder(spark, "warc"))
    warc.register(spark)
    records = spark.read.format("warc").option("limit", archives.LIMIT).load(folder)
    number = F.regexp_extract(captures.paired_request(), r"^GET /(\d+) ", 1).cast("bigint")
    stored = flows.store_captures(
        flows.captured(records.withColumn("page_id", number), archives.LIMIT),
        _folder(spark, "captures"), "warc", "2023-50",
    )
    docs = flows.page_documents(flows.captured_pages(stored), corpora.suffixes(spark))
    place = F.col("field").isin("warc.file.name", "warc.record.offset")
    return _fields(docs, "page_id").where(~place)


@query
def e6_reruns(spark, sf_dir):
    """Captures after a run over some of the archives and another over all of them."""
    folder = archives.write(corpora.read(spark, sf_dir, "pages"), _folder(spark, "warc"))
    paths = spark.read.format("binaryFile").load(folder).select("path")
    target = _folder(spark, "runs")
    flows.ingest(paths.where(F.col("path").endswith(".gz")), target, "warc", "2023-50", archives.LIMIT)
    table = flows.ingest(paths, target, "warc", "2023-50", archives.LIMIT)
    return table.select(F.col("target").alias("url"), F.md5("content").alias("content_md5"), "crawl")


@query
def e6_set_aside(spark, sf_dir):
    """Archive records that no flow can use, with the reason."""
    pages = corpora.read(spark, sf_dir, "pages")
    lost = pages.withColumn("url", F.when(F.col("page_id") % 9 != 0, F.col("url")).otherwise(""))
    folder = archives.write(lost, _folder(spark, "warc"))
    warc.register(spark)
    records = spark.read.format("warc").option("limit", archives.LIMIT).load(folder)
    return flows.set_aside(records).groupBy("error").agg(F.count("*").alias("n"))


@query
def e6_fetched_page_documents(spark, sf_dir):
    pages = corpora.with_headers(corpora.read(spark, sf_dir, "pages")).select(
        "headers", F.expr(corpora.FETCHED_AT).alias("ts"), *corpora._expressions(corpora.PAGE_COLUMNS)
    )
    docs = flows.fetched_page_documents(
        pages, _policies(spark, sf_dir), corpora.suffixes(spark),
        fetch_time=F.lit("2024-01-01 00:00:00").cast("timestamp"), ts="ts", row_id="page_id",
    )
    return _fields(docs, "page_id")


# --- study ------------------------------------------------------------------------------------------


@query
def q1_agents_named(spark, sf_dir):
    return study.agents_named(_profiles(spark, sf_dir)).select("crawl", "agent", "docs", "share")


@query
def q2_agents_blocked(spark, sf_dir):
    return study.agents_blocked(_profiles(spark, sf_dir), k=5).select(
        "crawl", "agent", "blocked", *_long("rank")
    )


@query
def q3_bias_summary(spark, sf_dir):
    return study.bias_summary(_profiles(spark, sf_dir))


@query
def q4_change(spark, sf_dir):
    counts = study.agents_named(_profiles(spark, sf_dir)).select("crawl", "agent", "share")
    return study.change_over_crawls(counts, "agent", "share")


@query
def q5_annotation_prevalence(spark, sf_dir):
    return study.annotation_prevalence(_refined(spark, sf_dir)).select("crawl", "key", "urls", "share")


@query
def q6_directive_frequency(spark, sf_dir):
    return study.directive_frequency(
        _refined(spark, sf_dir), [config.DIRECTIVE_KEY, "parse.http.x-robots-tag"]
    )


@query
def q7_status_breakdown(spark, sf_dir):
    profiles = robots.admit(corpora.robots(spark, sf_dir))
    return study.status_breakdown(profiles, exact=True).select(
        "crawl", *_long("status"), "content_type", "docs", "p50", "p95", "level"
    )


@query
def q7_size_buckets(spark, sf_dir):
    profiles = robots.admit(corpora.robots(spark, sf_dir))
    return study.size_buckets(profiles).select("crawl", *_long("status", "bucket"), "docs")


@query
def q7_stored_quantiles(spark, sf_dir):
    """Size quantiles by crawl and status, subtotals included, from size sketches stored per crawl."""
    profiles = robots.admit(corpora.robots(spark, sf_dir))
    stored = sketches.store(sketches.size_sketches(profiles, "status"), _folder(spark, "sizes"))
    return sketches.quantiles_over(stored, "crawl", "status").select(
        "crawl", *_long("status"), "docs", "p50", "p95", "level"
    )


@query
def q8_by_label(spark, sf_dir):
    """Pages that reserve their content, by crawl and category."""
    keys = html.annotation_keys(_refined(spark, sf_dir), "crawl", "url")
    reserved = metadata.with_host(keys.where(F.col("key") == "parse.meta.tdm-reservation"))
    labelled = metadata.with_label(reserved, corpora.labels(spark, sf_dir))
    return study.by_dimension(labelled, "crawl", "label")


@query
def q9_sitemap_and_delay(spark, sf_dir):
    return study.sitemap_and_delay(_profiles(spark, sf_dir)).select(
        "crawl", "docs", "with_sitemap", "with_delay", *_long("max_delay")
    )


@query
def q10_mechanisms(spark, sf_dir):
    judged = policy.page_policies(_refined(spark, sf_dir), _policies(spark, sf_dir))

    def restricts(key: str) -> Column:
        return F.exists(html.values_of(key), study.restricts)

    flags = {
        "meta": restricts(config.DIRECTIVE_KEY),
        "header": restricts("parse.http.x-robots-tag"),
        "robots": F.array_contains("denied", "gptbot"),
        "tdm": F.exists("tdmrep.file.groups", lambda g: g["tdm_reservation"] == 1),
    }
    return study.mechanisms(judged, flags)


@query
def q11_licences(spark, sf_dir):
    return study.licences_linked(_refined(spark, sf_dir))


@query
def q12_distinct_agents(spark, sf_dir):
    return study.distinct_agents(_profiles(spark, sf_dir)).select("crawl", "agents")


@query
def q12_approximate_agents(spark, sf_dir):
    """The sketch stays within its error bound of the exact count."""
    profiles = _profiles(spark, sf_dir)
    both = study.distinct_agents(profiles).join(
        study.distinct_agents(profiles, approximate=True).withColumnRenamed("agents", "approx"), "crawl"
    )
    close = F.abs(F.col("approx") - F.col("agents")) <= F.greatest(F.lit(1), F.col("agents") * 0.15)
    return both.select("crawl", close.alias("within_bound"))


@query
def q12_stored_agents(spark, sf_dir):
    """Different agents named per crawl and, without crawl, in all, from sketches stored per crawl."""
    stored = sketches.store(sketches.agent_sketches(_profiles(spark, sf_dir)), _folder(spark, "agents"))
    every = sketches.distinct_over(stored).withColumn("crawl", F.lit(None).cast("string"))
    return sketches.distinct_over(stored, "crawl").unionByName(every)
