"""Demonstration corpora derived row by row from ``pages`` and ``events``.

The given tables hold no robots.txt files, headers or fetch log, so each corpus is
a function of the rows of ``pages``: the number of documents follows the table.
All column rules are SQL texts valid in Spark and in the oracle's dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitestance import config

K = "CAST(page_id % 50 AS STRING)"


def sql_text(template: str, k: str = K) -> str:
    """A text template to a SQL expression; ``{k}`` varies from row to row."""
    pieces = []
    for part in re.split(r"(\{k\}|')", template):
        if part == "{k}":
            pieces.append(k)
        elif part == "'":
            pieces.append("chr(39)")
        elif part:
            pieces.append("'" + part + "'")
    return f"concat({', '.join(pieces)})" if pieces else "''"


def pick(index: str, templates: list[str], k: str = K) -> str:
    """CASE over templates."""
    cases = " ".join(f"WHEN {i} THEN {sql_text(t, k)}" for i, t in enumerate(templates))
    return f"CASE {index} {cases} END"


CRAWL = "CASE CAST(floor(page_id / 16) AS BIGINT) % 8 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(config.CRAWLS)
) + " END"
SITE = "regexp_extract(url, '^([a-z]+://[^/]+)', 1)"

# --- robots.txt ----------------------------------------------------------------

ROBOTS_TEMPLATES = [
    "User-agent: CCBot\nUser-agent: GPTBot\nDisallow: /shop{k}/\nDisallow: /cart\n\n"
    "User-agent: Bingbot\nDisallow: /search?\nAllow: /search?q={k}\nCrawl-delay: 2\n"
    "User-agent: *\nDisallow: /internal/\nAllow: /internal/press/\n"
    "Sitemap: https://ex.org/map{k}.xml",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nDisallow: /\n",
    "User-agent: CCBot\nCrawl-delay: 5\nUser-agent: GPTBot\nDisallow: /\nAllow: /p{k}/\n",
    "Useragent: gptbot\nDisalow: /x{k}/\nDssalow /y/\n",
    "User-agent: GPTBot\nUser-agent: GPTBOT\nDisallow: /\n",
    "# c\n   \nUser-agent: * # x\r\n\r\nDisallow: /a{k}/*\n",
    "User-agent: GPTBot\nCrawl-delay: 10.5\nCrawl-delay: 3\nUser-agent: *\nCrawl-delay: {k}\n"
    "Crawl-delay: -9\nDisallow: /tmp\n",
    "Sitemap: https://Ex.org/S{k}.xml\nsitemaps: https://ex.org/s{k}.xml\n"
    "Sitemap https://ex.org/t.xml\nhttps://ex.org/u.xml\n: odd\nHost: ex.org\n",
    "User-agent: GPTBot\nAllow:\nUser-agent: CCBot\nDisallow: /p{k}/\n",
    "Disallow: /early/\nUser-agent: GPTBot\nAllow: /ok{k}/\n",
    "User-agent: *\nDisallow: /pub/\nUser-agent: GPTBot\nAllow: /pub/\nDisallow: /pub/\n"
    "Disallow: /en/{k}\n",
    "User-agent: *\nDisallow: /Admin/\nUser-agent: GPTBot\nDisallow: /admin/\n",
    "User-agent: *\nDisallow: /a/\nUser-agent: GPTBot\nDisallow: /4\nACAP-crawler: *\n",
    "User-agent:\nDisallow: /z{k}/\nUser-agent-x: foo\nNoindex: /q\n",
    "User agent\t:\tBingbot \t\nDisallow: /*.html$\nDisallow: /a.b(c){k}/*/d/\n"
    "Allow: /*?page=2$\nDisallow: /*page=*ref=\nAllow: /d*/\nUser-agent: *\nDisallow: /fr/*\n"
    "Allow: /fr/{k}\nUser-agent: Yandex\nUser-agent: PetalBot\nDisallow: /en/\n"
    "Crawl-delay: 99999999999\nUser-agent: bingbot\nDisallow: /es/\n",
]
_TEXT_ROBOTS = f"CASE WHEN page_id % 17 = 0 THEN '' ELSE {pick('page_id % 16', ROBOTS_TEMPLATES)} END"
ROBOTS_COLUMNS = {
    "doc_id": "page_id",
    "crawl": CRAWL,
    "url": f"concat({SITE}, '/robots.txt')",
    "status": "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END",
    "content_type": (
        "CASE WHEN page_id % 19 = 0 THEN 'text/HTML; charset=utf-8'"
        " WHEN page_id % 5 = 0 THEN NULL ELSE 'text/plain' END"
    ),
    "text": _TEXT_ROBOTS,
    # 0 none, 1 UTF-8, 2 UTF-16LE, 3 UTF-16BE
    "mark": "CASE WHEN page_id % 17 = 0 THEN 0 ELSE CASE page_id % 23 WHEN 5 THEN 1"
    " WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE 0 END END",
}

# --- annotated pages -------------------------------------------------------------

HEAD_BLOCKS = [
    '<meta name="robots" content="noindex, NoFollow , max-image-preview : large">',
    '<meta name="tdm-reservation" content="1"><meta name="TDM-Policy" '
    'content="https://ex.org/p{k}.json">',
    '<meta name="author" content="A &amp; B {k}"><META NAME="copyright" CONTENT="(c) {k}">',
    "<meta content='x > y' name=ROBOTS><meta name='dc.rights' content='r{k}'/>"
    "<meta name='DC.Creator' content='c{k}'>",
    '<link rel="canonical" href="https://ex.org/c{k}"><meta property="og:url" '
    'content="https://ex.org/o{k}"><meta property="og:title" content="T{k}">'
    '<meta property="og:description" content="D{k}">',
    '<link rel="license" href="https://creativecommons.org/licenses/by/4.0/">'
    '<a rel="license nofollow" href="/no">n</a><a REL=author href=/me{k}>me</a>',
    '<a href="https://creativecommons.org/licenses/by-sa/4.0/">1</a>'
    '<a href="http://creativecommons.org/licenses/by-nc/3.0/">2</a>'
    '<a class="x" href="http://creativecommons.org/publicdomain/zero/1.0/">3</a>',
    '<link type="application/atom+xml" href="/atom{k}"><link type="application/rss+xml" '
    'href="/rss{k}"><link type="application/rss+xml" href="/rss2">',
    '<meta name="description" content="d{k}"><meta name="keywords" content="a, b ,,c{k}">'
    '<meta name="keywords" content="d"><meta http-equiv="Content-Language" content="de">'
    '<meta name="language" content="de"><meta name="DC.LANGUAGE" content="de">'
    '<meta name="license" content="l"><meta name="License:Uri" content="u{k}">'
    '<meta name="rights" content="r"><meta name="rights-standard" content="s">'
    '<meta name="dc.accessrights" content="1"><meta name="dc.license" content="2">'
    '<meta name="dc.provenance" content="3"><meta name="dc.publisher" content="4">'
    '<meta name="dc.rightsholder" content="5"><meta name="dc.source" content="6">'
    '<meta name="robots" content="NOAI"><meta name="robots" content="noindex">',
    '<meta name="RoBots" content="none:"><meta name="robotsx" content="no">'
    '<meta name="keywords" content="  ">',
    '<!-- <meta name="robots" content="commented"> --><meta name="title" content="m{k}">'
    '<script>var a = "<meta name=robots content=scripted>";</script>',
    "",
]
PAGE_COLUMNS = {
    "page_id": "page_id",
    "crawl": CRAWL,
    "url": "url",
    "html": f"replace(html, '<head>', concat('<head>', {pick('page_id % 12', HEAD_BLOCKS)}))",
}
# Every 12th page loses its title, every 24th its first heading too.
_TITLE = "CASE WHEN page_id % 12 = 4 THEN replace(replace({h}, '<title>', '<x>'), '</title>', '</x>') ELSE {h} END"
PAGE_COLUMNS["html"] = _TITLE.format(h=PAGE_COLUMNS["html"])

# Pages are fetched over some twenty days, in no order of their numbers.
FETCHED_AT = "timestamp_seconds(1695289671 + page_id * 7919 % 1009 * 1800)"

# --- response headers: one text line per header, in record order ------------------

HEADER_TEMPLATES = [
    "X-Robots-Tag: noindex, nofollow\nServer: s{k}",
    "x-robots-tag: all\nX-ROBOTS-TAGS: no",
    "TDM-Policy: p{k}\ntdm-policy: p2\nTDM-Reservation: 1",
    "Content-Type: text/html\nX-Robots-Tag: otherbot: noarchive\nX-Robots-Tag: noindex",
    "Server: s",
    "TDM-Reservation: 0\nVary: a",
]
HEADER_TEXT = pick("page_id % 6", HEADER_TEMPLATES)

# --- tdmrep.json -------------------------------------------------------------------

TDM_TEMPLATES = [
    '[{"tdm-policy": "https://rights.ex.org/{k}", "location": "/", "tdm-reservation": 1}, '
    '{"tdm-reservation": 0, "location": "/press/{k}"}]',
    '{"location":"/"}',
    '[{"location":"/","tdm-reservation":1},{"location":"/b{k}"}]',
    "[]",
    '[{"location":"/{k}","tdm-reservation":"1"},{"location":5,"tdm-reservation":1.9},'
    '{"location":true,"tdm-reservation":"x"},{"location":null,"tdm-reservation":true}]',
    '[{"location":"/","tdm-reservation":{k},"tdm-policy":null}]',
    "[5]",
    "[{",
    '[{"location":{"a":1},"tdm-reservation":-1.5,"tdm-policy":[1]}]',
]
TDM_COLUMNS = {
    "doc_id": "page_id",
    "content_type": "CASE WHEN page_id % 13 = 0 THEN 'text/html' ELSE 'application/json' END",
    "text": f"CASE WHEN page_id % 29 = 0 THEN '' ELSE {pick('page_id % 9', TDM_TEMPLATES)} END",
}

# --- fetch log ----------------------------------------------------------------------
# One origin has up to seven log rows; its course depends on the first digit of a hash.

_FK = "substr(md5(base), 2, 1)"
FETCH_ROBOTS = [
    "User-agent: *\nDisallow: /en/\nUser-agent: GPTBot\nDisallow: /\n",
    "User-agent: CCBot\nUser-agent: Googlebot\nDisallow: /*.html$\nDisallow: /de/*{k}\n",
    "User-agent: *\nDisallow: /*page=*ref=\nAllow: /*/7\nUser-agent: Bingbot\nDisallow:\n",
    "User-agent: CompletelyRandomReferenceUserAgent\nDisallow: /fr/\nUser-agent: *\nAllow: /\n",
    "User-agent: yandex\nDisallow: /es/\nUser-agent: *\nDisallow: /\nAllow: /en/\n",
    "# nothing here\n",
]
_DIRECT = "('0', '1', '2', '3', '4', '5', '6')"
_SLOT = f"CASE substr(md5(base), 3, 1) {' '.join(f'WHEN {chr(39)}{d:x}{chr(39)} THEN {d % 6}' for d in range(16))} END"
FETCH_COLUMNS = {
    "url": (
        "CASE WHEN hop = 0 THEN concat(base, '/robots.txt') WHEN c = '7' THEN concat(base, '/r1')"
        " WHEN c IN ('8', '9') THEN concat(base, '/h', CAST(hop AS STRING))"
        " WHEN c = 'e' THEN 'https://hot.example.org/robots.txt'"
        " ELSE concat(base, '/x/robots2.txt?v=1') END"
    ),
    "kind": "'robots'",
    "status": (
        f"CASE WHEN c = 'c' THEN NULL WHEN c = '6' THEN 404 WHEN hop = 0 AND c IN {_DIRECT}"
        " THEN 200 WHEN c = '8' AND hop = 5 THEN 200 WHEN c = '9' AND hop = 6 THEN 200"
        " WHEN c IN ('7', 'e', 'f') AND hop = 1 THEN 200 WHEN hop % 2 = 0 THEN 301 ELSE 308 END"
    ),
    "location": (
        f"CASE WHEN c IN {_DIRECT} OR c IN ('a', 'c') THEN NULL"
        " WHEN c = '8' AND hop = 5 THEN NULL WHEN c = '9' AND hop = 6 THEN NULL"
        " WHEN c IN ('7', 'e', 'f') AND hop = 1 THEN NULL"
        " WHEN c = '7' THEN 'r1' WHEN c IN ('8', '9') THEN concat('/h', CAST(hop + 1 AS STRING))"
        " WHEN c = 'b' THEN 'https://nowhere.example.org/a' WHEN c = 'd' THEN 'mailto:a@ex.org'"
        " WHEN c = 'e' THEN '//hot.example.org/robots.txt'"
        " WHEN c = 'f' THEN './y/../x/robots2.txt?v=1' END"
    ),
    "content_type": "CASE WHEN c = '5' THEN NULL ELSE 'text/plain' END",
    "text": (
        "CASE WHEN c = '6' THEN 'User-agent: *\nDisallow: /\n' WHEN c = 'e' AND hop = 1"
        f" THEN {sql_text(FETCH_ROBOTS[0])} ELSE {pick(_SLOT, FETCH_ROBOTS, _FK)} END"
    ),
    "error": "CASE WHEN c = 'c' THEN 'timeout' END",
}
FETCH_ROWS = (
    "hop = 0 OR (c IN ('7', 'e', 'f') AND hop = 1) OR (c = '8' AND hop <= 5) OR (c = '9')"
)
TDM_FETCH_COLUMNS = {
    "url": (
        "CASE WHEN hop = 0 THEN concat(base, '/.well-known/tdmrep.json')"
        " ELSE concat(base, '/tdm/tdmrep.json') END"
    ),
    "kind": "'tdmrep'",
    "status": "CASE WHEN c = 'a' THEN 404 WHEN c = 'c' THEN NULL WHEN c = 'f' AND hop = 0 THEN 302 ELSE 200 END",
    "location": "CASE WHEN c = 'f' AND hop = 0 THEN '/tdm/tdmrep.json' END",
    "content_type": "CASE WHEN c = 'd' THEN 'text/html' ELSE 'application/json' END",
    "text": (
        "CASE WHEN c IN ('a', 'b') THEN '{}' ELSE "
        + pick(
            "CASE c " + " ".join(f"WHEN '{d:x}' THEN {d % 9}" for d in range(16)) + " END",
            TDM_TEMPLATES,
            "'7'",
        )
        + " END"
    ),
    "error": "CASE WHEN c = 'c' THEN 'timeout' END",
}
TDM_FETCH_ROWS = "hop = 0 OR (c = 'f' AND hop = 1)"

# --- labels and suffixes ---------------------------------------------------------------

LABEL = (
    "CASE substr(md5(host), 1, 1) WHEN '0' THEN NULL WHEN '1' THEN NULL WHEN '2' THEN 'Arts, Music'"
    " WHEN '3' THEN 'News' WHEN '4' THEN 'News' WHEN '5' THEN 'Science' ELSE 'Business' END"
)
SUFFIXES = [
    ("com", False, False), ("net", False, False), ("org", False, False),
    ("example.com", False, False), ("example.net", True, False),
    ("tionsh.example.net", False, True),
]


def _expressions(columns: dict[str, str]) -> list:
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _instants(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _instants(df: DataFrame) -> DataFrame:
    """Event times without a zone are read as UTC."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return _instants(files.parquet(sf_dir))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, crawl, url, status, content_type, content)``."""
    derived = read(spark, sf_dir, "pages").select(*_expressions(ROBOTS_COLUMNS))
    content = (
        F.when(F.col("mark") == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("mark") == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(F.col("mark") == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return derived.withColumn("content", content).drop("text", "mark")


def annotated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, crawl, url, html)``."""
    return read(spark, sf_dir, "pages").select(*_expressions(PAGE_COLUMNS))


def with_headers(pages: DataFrame) -> DataFrame:
    """Adds ``headers``: ``array<struct<name, value>>`` in record order."""
    lines = F.split(F.expr(HEADER_TEXT), "\n", -1)
    return pages.withColumn(
        "headers",
        F.transform(
            lines,
            lambda h: F.struct(
                F.regexp_extract(h, "^([^:]*): ", 1).alias("name"),
                F.regexp_extract(h, "^[^:]*: (.*)$", 1).alias("value"),
            ),
        ),
    )


def tdmrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content_type, content)``."""
    derived = read(spark, sf_dir, "pages").select(*_expressions(TDM_COLUMNS))
    return derived.withColumn("content", F.encode("text", "UTF-8")).drop("text")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log of all origins in ``pages``."""
    origins = (
        read(spark, sf_dir, "pages")
        .select(F.expr(SITE).alias("base"))
        .distinct()
        .withColumn("c", F.substring(F.md5("base"), 1, 1))
        .withColumn("page_id", F.lit(0))
    )
    hops = origins.withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(6))))
    parts = [
        hops.where(F.expr(rows)).select(
            *_expressions(columns), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")
        )
        for columns, rows in ((FETCH_COLUMNS, FETCH_ROWS), (TDM_FETCH_COLUMNS, TDM_FETCH_ROWS))
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .withColumn("content", F.when(F.col("error").isNull(), F.encode("text", "UTF-8")))
        .drop("text")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitestance.functions import url

    hosts = read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host")).distinct()
    return hosts.withColumn("label", F.expr(LABEL)).where(F.col("label").isNotNull())


def suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SUFFIXES, "suffix string, is_wildcard boolean, is_exception boolean"
    )
