"""Everything a user may want to change, kept as plain data."""

from __future__ import annotations

from html.entities import name2codepoint

# --- Fixed values: tracked agents -------------------------------------------
AGENTS = [
    "Google-Extended",
    "CCBot",
    "GPTBot",
    "ChatGPT-User",
    "Googlebot",
    "Bingbot",
    "Baiduspider",
    "Yandex",
    "AhrefsBot",
    "PetalBot",
    "MJ12bot",
    "AdsBot-Google",
    "Mediapartners-Google",
    "ia_archiver",
]

# Stands for "any other bot"; no robots.txt names it.
REFERENCE_AGENT = "CompletelyRandomReferenceUserAgent"

# --- Fixed values: robots.txt directives and the spellings seen for them -----
DIRECTIVES = {
    "user-agent": [
        "user-agent", "useragent", "useg-agent", "ser-agent", "users-agent",
        "user agent", "user-agnet", "user-agents",
    ],
    "disallow": [
        "disallow", "desallow", "dissallow", "dissalow", "disalow", "dssalow",
        "dsallow", "diasllow", "disallaw", "diallow", "disallows", "disllow",
    ],
    "allow": ["allow"],
    "crawl-delay": [
        "crawl-delay", "crawl delay", "clawl-delay", "craw-delay", "crawl-deley",
    ],
    "sitemap": ["sitemap", "sitemaps"],
    "host": ["host"],
    "no-index": ["no-index"],
    "request-rate": ["request-rate"],
    "visit-time": ["visit-time"],
    "robot-version": ["robot-version"],
    "comment": ["comment"],
    "http": ["http", "https"],
}
# Takes any suffix after the dash.
PREFIX_DIRECTIVE = "acap-"

# --- Fixed values: limits ----------------------------------------------------
CONTENT_LIMIT = 65536
CACHE_TTL_DAYS = 7
MAX_REDIRECTS = 5
REDIRECT_CODES = [301, 302, 303, 307, 308]
COUNTER_BUCKET = "10 seconds"
FIRST_DOCUMENTS = 60_000_000

# --- Fixed values: HTML annotations -----------------------------------------
# key -> selectors in order of preference; each is
# (element or "*", attribute, attribute value, attribute read).
# ``text`` selectors read the element's text; ``prefix`` ones compare the start.


def _meta(*names: str) -> list[tuple[str, str, str, str]]:
    return [("meta", "name", n, "content") for n in names]


SELECTORS = {
    "parse.canonical": [
        ("*", "rel", "canonical", "href"),
        ("*", "property", "og:url", "content"),
    ],
    "parse.title": [
        ("title", "text", "", ""),
        *_meta("title", "dc:title"),
        ("meta", "property", "og:title", "content"),
        ("h1", "text", "", ""),
    ],
    "parse.description": [
        *_meta("description", "Description", "dc:description"),
        ("meta", "property", "og:description", "content"),
    ],
    "parse.keywords": _meta("keywords", "meta:keyword", "dc:subject"),
    "parse.feedlink": [
        ("link", "type", "application/rss+xml", "href"),
        ("link", "type", "application/atom+xml", "href"),
    ],
    "parse.html.language": [("html", "present", "", "lang")],
    "parse.meta.language": _meta("language", "Language", "LANGUAGE"),
    "parse.meta.content-language": [
        ("meta", "http-equiv", v, "content")
        for v in ("content-language", "Content-Language", "CONTENT-LANGUAGE")
    ],
    "parse.meta.dc.language": _meta("dc.language", "DC.Language", "DC.LANGUAGE"),
    "parse.rel.author": [("*", "rel", v, "href") for v in ("author", "Author", "AUTHOR")],
    "parse.rel.license": [("*", "rel", v, "href") for v in ("license", "License", "LICENSE")],
    "parse.meta.author": _meta("author", "Author", "AUTHOR"),
    "parse.meta.copyright": _meta("copyright", "Copyright", "COPYRIGHT"),
    "parse.meta.license": _meta("license", "License", "LICENSE"),
    "parse.meta.license-uri": _meta("license:uri", "License:uri", "License:Uri", "LICENSE:URI"),
    "parse.meta.rights": _meta("rights", "Rights", "RIGHTS"),
    "parse.meta.rights-standard": _meta(
        "rights-standard", "Rights-standard", "Rights-Standard", "RIGHTS-STANDARD"
    ),
    **{
        f"parse.meta.dc.{term}": _meta(
            f"dc.{term}", f"DC.{term}", f"DC.{term.capitalize()}", f"DC.{term.upper()}"
        )
        for term in (
            "creator", "accessrights", "license", "provenance", "publisher",
            "rights", "rightsholder", "source",
        )
    },
    "parse.creativecommons": [
        ("a", "prefix", f"{scheme}{host}", "href")
        for host in ("creativecommons.org", "www.creativecommons.org")
        for scheme in ("http://", "https://")
    ],
    "parse.meta.robots": _meta("robots", "Robots", "ROBOTS"),
    **{
        f"parse.meta.tdm-{term}": _meta(
            f"tdm-{term}", f"Tdm-{term}", f"tdm-{term.capitalize()}",
            f"Tdm-{term.capitalize()}", f"TDM-{term}", f"TDM-{term.capitalize()}",
            f"TDM-{term.upper()}",
        )
        for term in ("reservation", "policy")
    },
}

# --- Fixed values: page filters ----------------------------------------------
HEADER_FIELDS = {
    "parse.http.x-robots-tag": "X-Robots-Tag",
    "parse.http.tdm-reservation": "TDM-Reservation",
    "parse.http.tdm-policy": "TDM-Policy",
}
COMMA_SPLIT_KEYS = ["parse.keywords", "parse.meta.robots", "parse.http.x-robots-tag"]
DIRECTIVE_KEY = "parse.meta.robots"
LABEL_KEY = "parse.curlieLabel"
METADATA_PREFIX = "fetcher.file."

# Directives that forbid something, alone or after the name of a bot; ``max-…`` only limits.
RESTRICTING = [
    "noindex", "nofollow", "none", "noarchive", "nocache", "nosnippet",
    "noimageindex", "noai", "noimageai", "noml",
]
RESTRICTS = rf"^([^:]+:\s*)?({'|'.join(RESTRICTING)})$"

# Character sets that a page may declare, by their usual names; all others are read as UTF-8.
CHARSETS = {
    "iso-8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252",
    "ascii": "windows-1252", "cp1252": "windows-1252", "x-sjis": "shift_jis", "gb2312": "gbk",
    **{
        name: name
        for name in (
            *(f"windows-125{n}" for n in range(9)), *(f"iso-8859-{n}" for n in (2, 4, 5, 6, 7, 8, 9, 13, 15)),
            "koi8-r", "koi8-u", "utf-16le", "utf-16be", "gbk", "gb18030", "big5", "shift_jis", "euc-jp", "euc-kr",
        )
    },
}

# --- Fixed values: index document --------------------------------------------
FIELD_MAPPING = [
    "warc.file.name",
    "warc.record.offset",
    "protocol._request.time_=capturetime",
    "parse.host=host",
    "parse.domain=domain",
    "parse.canonical=canonical",
    "protocol._response.ip_=ip",
    "parse.title=title",
    "parse.description=description",
    "parse.keywords=keywords",
    "parse.feedlink",
    "parse.creativecommons",
    "parse.curlieLabel",
    "parse.html.*",
    "parse.meta.*",
    "parse.rel.*",
    "parse.http.*",
    "fetcher.file.*",
]

# (path pattern, type); the first pattern that fits decides.
FIELD_TYPES = [
    ("fetcher.file.robots.num-*", "integer"),
    ("fetcher.file.robots.cached", "boolean"),
    ("fetcher.file.robots.allow-none.*", "boolean"),
    ("fetcher.file.robots.disallow-all.*", "boolean"),
    ("fetcher.file.robots.bias.*", "integer"),
    ("fetcher.file.fetchTime", "date"),
    ("fetcher.file.tdmrep.num-*", "integer"),
    ("fetcher.file.*-length", "integer"),
    ("fetcher.file.robots.crawldelay", "integer"),
    ("fetcher.file.robots.agents.*", "boolean"),
    ("parse.*", "keyword"),
    ("fetcher.*", "keyword"),
    ("warc.*", "keyword"),
    ("url", "keyword"),
    ("canonical", "keyword"),
    ("host", "keyword"),
    ("domain", "keyword"),
    ("ip", "keyword"),
    ("title", "text"),
    ("keywords", "text"),
    ("description", "text"),
    ("capturetime", "date"),
]

# --- Fixed values: crawls ----------------------------------------------------
CRAWLS = [
    "2016-50", "2017-51", "2018-51", "2019-51",
    "2020-50", "2021-49", "2022-49", "2023-50",
]
DATASETS = {"warc": "warc.paths", "robotstxt": "robotstxt.paths"}

# Character references of HTML 4, from the standard library.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def agent_keys(agents: list[str] | None = None) -> list[str]:
    """The tracked agents as robots.txt names are compared: in lower case."""
    return [a.lower() for a in (AGENTS if agents is None else agents)]
