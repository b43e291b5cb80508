"""The same queries in the oracle's SQL, written relationally and on their own.

Arrays of the Spark plans appear here as rows, in-row folds as window functions,
and rule priority as ``arg_max`` over all matching rules.
"""

from __future__ import annotations

from sitestance import config
from sitestance.plans import archives, corpora
from sitestance.plans.catalog import annotation_query_names


def _cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _values(items: list) -> str:
    def one(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    rows = [i if isinstance(i, tuple) else (i,) for i in items]
    return "VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


AGENTS = config.agent_keys()
TRACKED = f"tracked(agent) AS ({_values(AGENTS)})"
HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
SIZE = (
    "CASE mark WHEN 1 THEN strlen(text) + 3 WHEN 2 THEN 2 + 2 * length(text)"
    " WHEN 3 THEN 2 + 2 * length(text) ELSE strlen(text) END"
)
TRIM = "regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"

# --- robots.txt --------------------------------------------------------------------

DOCS = f"""docs AS (
  SELECT *, content_length > 0 AND NOT starts_with(lower(coalesce(content_type, '')), 'text/html') AS is_parsed
  FROM (SELECT doc_id, crawl, url, status, text, CAST({SIZE} AS BIGINT) AS content_length,
          CASE WHEN strlen(text) > 0 THEN content_type END AS content_type
        FROM (SELECT {_cols(corpora.ROBOTS_COLUMNS)} FROM pages)))"""

_FORMS = [(form, name) for name, forms in config.DIRECTIVES.items() for form in forms]
_DELIMITER = "^([ \\t]*:[ \\t]*|[ \\t]+)"
LINES = f"""raw AS (
  SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
          lambda x: x <> '') AS l FROM docs WHERE is_parsed)),
strip AS (SELECT doc_id, n, {TRIM.format("regexp_replace(raw, '#.*', '')")} AS t FROM raw),
forms(form, name) AS ({_values(_FORMS)}),
tok AS (
  SELECT doc_id, n,
    coalesce(f.name, CASE WHEN regexp_matches(lower(t), '^acap-[^: \\t]+([ \\t]*:|[ \\t])') THEN 'acap-'
      WHEN starts_with(t, ':') THEN 'unknown' ELSE 'missing' END) AS directive,
    {TRIM.format(f"CASE WHEN f.name IS NOT NULL THEN regexp_replace(substr(t, length(f.form) + 1), '{_DELIMITER}', '') WHEN regexp_matches(lower(t), '^acap-[^: \\t]+([ \\t]*:|[ \\t])') THEN regexp_replace(t, '(?i)^acap-[^: \\t]+([ \\t]*:[ \\t]*|[ \\t]+)', '') ELSE t END")} AS value
  FROM strip LEFT JOIN forms f ON starts_with(lower(t), f.form)
    AND regexp_matches(substr(t, length(f.form) + 1), '{_DELIMITER}')
  WHERE t <> '')"""
GROUPS = f"""grp AS (
  SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM (
    SELECT *, CASE WHEN lag(directive) OVER w IS NULL
        OR (directive = 'user-agent' AND lag(directive) OVER w <> 'user-agent') THEN 1 ELSE 0 END AS st
    FROM tok WHERE directive IN ('user-agent', 'allow', 'disallow')
    WINDOW w AS (PARTITION BY doc_id ORDER BY n))),
ag AS (SELECT doc_id, grp, n, lower(value) AS agent FROM grp WHERE directive = 'user-agent'),
ru AS (SELECT doc_id, grp, n, directive = 'allow' AS allow, value AS pattern FROM grp WHERE directive <> 'user-agent'),
{TRACKED},
named AS (SELECT DISTINCT doc_id, lower(value) AS agent FROM tok WHERE directive = 'user-agent'),
subj AS (SELECT doc_id, '*' AS agent FROM docs WHERE is_parsed
  UNION ALL SELECT doc_id, agent FROM named WHERE agent IN (FROM tracked)),
counts AS (
  SELECT doc_id, agent,
    count(*) FILTER (allow AND pattern <> '') AS num_allow,
    count(*) FILTER (NOT allow AND pattern <> '') AS num_disallow,
    count(*) FILTER (NOT allow AND pattern = '') AS num_disallow_empty
  FROM ag JOIN ru USING (doc_id, grp) WHERE agent = '*' OR agent IN (FROM tracked) GROUP BY ALL
  HAVING count(*) FILTER (NOT allow OR pattern <> '') > 0),
dirs AS (SELECT DISTINCT doc_id, d FROM (SELECT doc_id, regexp_replace(lower(pattern), '/\\*$', '/') AS d FROM ru)
  WHERE starts_with(d, '/') AND ends_with(d, '/'))"""
RULES = """rgx AS (SELECT DISTINCT doc_id, agent, allow, pattern,
    '(?s)^' || regexp_replace(replace(regexp_escape(pattern), '\\*', '.*'), '\\\\\\$$', '$') AS rx
  FROM ag JOIN ru USING (doc_id, grp) WHERE pattern <> '')"""
_BEST = "coalesce(arg_max(r.allow, 2 * length(r.pattern) + CASE WHEN r.allow THEN 1 ELSE 0 END), true)"
VERDICTS = f"""probes AS (
  SELECT doc_id, agent, '/42' AS path, true AS root FROM subj
  UNION ALL SELECT doc_id, agent, d || '42', false FROM subj JOIN dirs USING (doc_id)),
verd AS (
  SELECT p.doc_id, p.agent, p.path, p.root, {_BEST} AS ok
  FROM probes p LEFT JOIN rgx r ON r.doc_id = p.doc_id AND r.agent = p.agent AND regexp_matches(p.path, r.rx)
  GROUP BY ALL),
bans AS (
  SELECT v.doc_id, v.agent FROM verd v JOIN counts c USING (doc_id, agent)
  WHERE v.root AND NOT v.ok AND num_disallow = 1 AND num_disallow_empty = 0 AND num_allow = 0),
bias AS (
  SELECT s.doc_id, s.agent, CAST(count(*) FILTER (v.ok) - count(*) FILTER (a.ok) AS BIGINT) AS bias
  FROM subj s LEFT JOIN verd v ON v.doc_id = s.doc_id AND v.agent = s.agent AND NOT v.root
  LEFT JOIN verd a ON a.doc_id = s.doc_id AND a.agent = '*' AND NOT a.root AND a.path = v.path
  WHERE s.agent <> '*' GROUP BY ALL)"""
LABELLED = "CASE WHEN agent = '*' THEN 'asterisk' ELSE agent END AS agent"
STATS = """stats AS (
  SELECT d.doc_id, d.crawl, d.url, d.status, d.content_type, d.content_length, d.is_parsed,
    nl.num_lines,
    CASE WHEN is_parsed THEN count(t.n) FILTER (directive = 'disallow' AND value <> '') END AS num_disallow,
    CASE WHEN is_parsed THEN count(t.n) FILTER (directive = 'disallow' AND value = '') END AS num_disallow_empty,
    CASE WHEN is_parsed THEN count(t.n) FILTER (directive = 'allow' AND value <> '') END AS num_allow,
    CASE WHEN is_parsed THEN count(t.n) FILTER (directive = 'sitemap') END AS num_sitemaps,
    CASE WHEN is_parsed THEN count(DISTINCT lower(value)) FILTER (directive = 'user-agent') END AS num_useragents,
    string_agg(DISTINCT lower(value), '|' ORDER BY lower(value)) FILTER (directive = 'user-agent') AS useragents,
    string_agg(DISTINCT lower(value), '|' ORDER BY lower(value)) FILTER (directive = 'sitemap') AS sitemaps,
    CASE WHEN max(TRY_CAST(value AS INTEGER)) FILTER (directive = 'crawl-delay' AND regexp_matches(value, '^[+-]?[0-9]+$')) >= 0
      THEN CAST(max(TRY_CAST(value AS INTEGER)) FILTER (directive = 'crawl-delay' AND regexp_matches(value, '^[+-]?[0-9]+$')) AS BIGINT) END AS crawldelay
  FROM docs d LEFT JOIN tok t ON t.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS num_lines FROM raw GROUP BY ALL) nl ON nl.doc_id = d.doc_id
  GROUP BY d.doc_id, d.crawl, d.url, d.status, d.content_type, d.content_length, d.is_parsed, nl.num_lines)"""
ROBOTS = (DOCS, LINES, GROUPS, RULES, VERDICTS, STATS)
_FIELD_ROWS = """fieldrows AS (
  SELECT doc_id, unnest(['content-length', 'content-type', 'num-lines', 'num-disallow', 'num-disallow-empty',
      'num-allow', 'num-sitemaps', 'sitemaps', 'num-useragents', 'useragents', 'crawldelay', 'code']) AS field,
    unnest([CAST(content_length AS VARCHAR), content_type, CAST(num_lines AS VARCHAR), CAST(num_disallow AS VARCHAR),
      CAST(num_disallow_empty AS VARCHAR), CAST(num_allow AS VARCHAR), CAST(num_sitemaps AS VARCHAR), sitemaps,
      CAST(num_useragents AS VARCHAR), useragents, CAST(crawldelay AS VARCHAR), CAST(status AS VARCHAR)]) AS values
  FROM stats
  UNION ALL SELECT doc_id, unnest(['num-allow-per-agent.', 'num-disallow-per-agent.', 'num-disallow-empty-per-agent.']) || a,
    unnest([num_allow, num_disallow, CASE WHEN num_disallow_empty > 0 THEN num_disallow_empty END])::VARCHAR
  FROM (SELECT *, CASE WHEN agent = '*' THEN 'asterisk' ELSE agent END AS a FROM counts)
  UNION ALL SELECT doc_id, 'disallow-all.' || CASE WHEN agent = '*' THEN 'asterisk' ELSE agent END, 'true' FROM bans
  UNION ALL SELECT doc_id, 'bias.' || agent, CAST(bias AS VARCHAR) FROM bias)"""

# --- pages -----------------------------------------------------------------------------

PAGES = f"pg AS (SELECT {_cols(corpora.PAGE_COLUMNS)} FROM pages)"
_SELECTORS = []
for _key, _options in config.SELECTORS.items():
    _seen = set()
    for _rank, (_element, _attribute, _value, _out) in enumerate(_options):
        if _attribute != "text" and (_element, _attribute, _value.lower()) not in _seen:
            _seen.add((_element, _attribute, _value.lower()))
            _SELECTORS.append((_key, _rank, _element, _attribute, _value.lower(), _out))
_HIDDEN = "(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)"
_TAG = "(?is)<[a-z][^\\s/>]*(?:[^<>\"'']+|\"[^\"]*\"|''[^'']*'')*>"
_ATTR = "(?s)[^\\s\"''<>/=]+\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)"
_DECODE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
ANNOTATIONS = f"""src AS (SELECT page_id, crawl, regexp_replace(html, '{_HIDDEN}', '', 'g') AS s FROM pg),
tag AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS tpos
  FROM (SELECT page_id, regexp_extract_all(s, '{_TAG}') AS l FROM src)),
att AS (SELECT page_id, tpos, element, lower(regexp_extract(a, '^[^\\s=]+')) AS name, apos,
    regexp_replace(regexp_replace(a, '^[^\\s=]+\\s*=\\s*', ''), '^"(.*)"$|^''(.*)''$', '\\1\\2') AS value
  FROM (SELECT page_id, tpos, element, unnest(l) AS a, generate_subscripts(l, 1) AS apos
    FROM (SELECT page_id, tpos, lower(regexp_extract(tag, '^<([^\\s/>]+)', 1)) AS element,
      regexp_extract_all(regexp_replace(tag, '^<[^\\s/>]+', ''), '{_ATTR}') AS l FROM tag))
  QUALIFY row_number() OVER (PARTITION BY page_id, tpos, name ORDER BY apos) = 1),
sel(key, rank, element, attribute, wanted, out) AS ({_values(_SELECTORS)}),
hit AS (
  SELECT o.page_id, s.key, s.rank, o.tpos, {_DECODE.format("o.value")} AS value
  FROM sel s JOIN att o ON o.name = s.out AND (s.element = '*' OR s.element = o.element)
  LEFT JOIN att m ON m.page_id = o.page_id AND m.tpos = o.tpos AND m.name = s.attribute
  WHERE CASE s.attribute WHEN 'present' THEN true WHEN 'prefix' THEN starts_with(o.value, s.wanted)
    ELSE lower(trim(m.value)) = s.wanted END
  UNION ALL SELECT page_id, 'parse.title', 0, 0,
    {_DECODE.format("trim(regexp_replace(regexp_extract(s, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '[ \\t\\n\\f\\r]+', ' ', 'g'))")} FROM src
  UNION ALL SELECT page_id, 'parse.title', 4, 0,
    {_DECODE.format("trim(regexp_replace(regexp_replace(regexp_extract(s, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1), '(?s)<[^>]*>', '', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'))")} FROM src),
ann AS (SELECT page_id, key, value, CAST(row_number() OVER (PARTITION BY page_id, key ORDER BY tpos) - 1 AS BIGINT) AS pos
  FROM (SELECT *, min(rank) OVER (PARTITION BY page_id, key) AS best FROM hit WHERE trim(value) <> '')
  WHERE rank = best)"""
_FIELD_OF = "CASE lower(name) WHEN 'x-robots-tag' THEN 'parse.http.x-robots-tag' WHEN 'tdm-reservation' THEN 'parse.http.tdm-reservation' WHEN 'tdm-policy' THEN 'parse.http.tdm-policy' END"
HEADERS = f"""hdr AS (SELECT page_id, n, regexp_extract(line, '^([^:]*): ', 1) AS name, regexp_extract(line, '^[^:]*: (.*)$', 1) AS value
  FROM (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
    FROM (SELECT page_id, string_split({corpora.HEADER_TEXT}, chr(10)) AS l FROM pages))),
hsel AS (SELECT page_id, {_FIELD_OF} AS key, value, n AS pos FROM hdr WHERE {_FIELD_OF} IS NOT NULL)"""
REFINED = f"""ref0 AS (SELECT page_id, key, value, pos FROM ann UNION ALL SELECT page_id, key, value, pos FROM hsel),
ref1 AS (SELECT page_id, key, value, pos, 0 AS sub FROM ref0 WHERE key NOT IN ('parse.keywords', 'parse.meta.robots', 'parse.http.x-robots-tag')
  UNION ALL SELECT * FROM (SELECT page_id, key, {TRIM.format("unnest(l)")} AS value, pos, generate_subscripts(l, 1) AS sub
    FROM (SELECT page_id, key, pos, string_split(value, ',') AS l FROM ref0
      WHERE key IN ('parse.keywords', 'parse.meta.robots', 'parse.http.x-robots-tag'))) WHERE value <> ''),
dirv AS (SELECT DISTINCT page_id, array_to_string(list_transform(string_split(regexp_replace(lower(value), ':+$', ''), ':'),
    lambda p: {TRIM.format("p")}), ':') AS value FROM ref1 WHERE key = 'parse.meta.robots'),
refd AS (SELECT page_id, key, value, row_number() OVER (PARTITION BY page_id, key ORDER BY pos, sub) - 1 AS pos FROM ref1 WHERE key <> 'parse.meta.robots'
  UNION ALL SELECT page_id, 'parse.meta.robots', value, row_number() OVER (PARTITION BY page_id ORDER BY value) - 1 FROM dirv),
pagekeys AS (SELECT page_id, key, string_agg(value, '|' ORDER BY pos) AS values FROM refd GROUP BY ALL)"""
ANNOTATED = (PAGES, ANNOTATIONS, HEADERS, REFINED)
DOMAINS = f"""rules(suffix, wild, exempt) AS ({_values(corpora.SUFFIXES)}),
hosts AS (SELECT DISTINCT {HOST} AS host FROM pages),
suff AS (SELECT host, len(string_split(host, '.')) AS total,
    coalesce(max(CASE WHEN exempt THEN len(string_split(suffix, '.')) - 1 END),
      max(CASE WHEN wild AND len(string_split(host, '.')) > len(string_split(suffix, '.')) THEN len(string_split(suffix, '.')) + 1
        WHEN NOT wild AND NOT exempt THEN len(string_split(suffix, '.')) END), 1) AS size
  FROM hosts LEFT JOIN rules ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY ALL),
domains AS (SELECT host, CASE WHEN total > size THEN array_to_string(string_split(host, '.')[total - size:], '.') END AS domain FROM suff)"""
LABELS = f"labels_ AS (SELECT host, {corpora.LABEL} AS label FROM (SELECT DISTINCT {HOST} AS host FROM pages))"

# --- TDM ---------------------------------------------------------------------------------


def _tdm(source: str) -> str:
    """Groups of ``source(doc_id, text, is_parsed)``."""
    integer = """CASE json_type(r) WHEN 'BOOLEAN' THEN CASE WHEN CAST(r AS VARCHAR) = 'true' THEN 1 ELSE 0 END
      ELSE coalesce(CAST(trunc(TRY_CAST(r ->> '$' AS DOUBLE)) AS BIGINT), 0) END"""

    def as_text(c: str) -> str:
        return f"CASE json_type({c}) WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN '' WHEN 'ARRAY' THEN '' ELSE {c} ->> '$' END"

    return f"""tj AS (SELECT *, is_parsed AND NOT json_valid(text) AS broken,
    CASE WHEN is_parsed AND json_valid(text) THEN text::JSON END AS j FROM ({source})),
te AS (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, CAST(j AS JSON[]) AS l FROM tj WHERE json_type(j) = 'ARRAY')),
tf AS (SELECT doc_id, pos, e -> '$.location' AS l, e -> '$."tdm-reservation"' AS r, e -> '$."tdm-policy"' AS p FROM te),
tbad AS (SELECT DISTINCT doc_id FROM tf WHERE l IS NULL OR r IS NULL),
tg AS (SELECT doc_id, pos, {as_text('l')} AS location, {integer} AS tdm_reservation,
    CASE WHEN p IS NOT NULL THEN {as_text('p')} END AS tdm_policy FROM tf WHERE doc_id NOT IN (FROM tbad)),
tp AS (SELECT t.doc_id, CASE WHEN NOT is_parsed THEN NULL WHEN broken THEN 'invalid JSON'
      WHEN json_type(j) <> 'ARRAY' THEN 'JSON object is not an array'
      WHEN doc_id IN (FROM tbad) THEN 'JSON object cannot be parsed' END AS error,
    CASE WHEN json_type(j) = 'ARRAY' AND doc_id NOT IN (FROM tbad)
      THEN (SELECT count(*) FROM tg WHERE tg.doc_id = t.doc_id) END AS num_groups,
    CASE WHEN json_type(j) = 'ARRAY' AND doc_id NOT IN (FROM tbad) THEN '[' || coalesce((SELECT string_agg(
      'Group{{location=''' || location || ''', tdmReservation=' || tdm_reservation || coalesce(', tdmPolicy=''' || tdm_policy || '''', '') || '}}',
      ', ' ORDER BY pos) FROM tg WHERE tg.doc_id = t.doc_id), '') || ']' END AS groups_text
  FROM tj t)"""


TDM_DOCS = f"""tdocs AS (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS content_length,
    CASE WHEN strlen(text) > 0 THEN content_type END AS content_type,
    strlen(text) > 0 AND NOT starts_with(content_type, 'text/html') AS is_parsed
  FROM (SELECT {_cols(corpora.TDM_COLUMNS)} FROM pages))"""
TDM = (TDM_DOCS, _tdm("FROM tdocs"))

# --- fetch log ---------------------------------------------------------------------------------

_BASE = corpora.SITE
ODD = """odd AS (SELECT page_id, CASE page_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN substr(url, 5)
    WHEN 2 THEN concat('HTTP://Ex_A.org:8080/a|b/', url) ELSE url END AS url FROM pages)"""
_ORIGIN = """CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || ':' ||
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) || ':' ||
    CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*:[0-9]+') THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*:([0-9]+)', 1)
      WHEN regexp_matches(url, '(?i)^https') THEN '443' ELSE '80' END END"""
LOG = f"""bases AS (SELECT DISTINCT {_BASE} AS base, substr(md5({_BASE}), 1, 1) AS c, 0 AS page_id FROM pages),
hops AS (SELECT *, unnest(range(0, 7)) AS hop FROM bases),
log AS (SELECT DISTINCT ON (kind, url) * FROM (
  SELECT {_cols(corpora.FETCH_COLUMNS)} FROM hops WHERE {corpora.FETCH_ROWS}
  UNION ALL SELECT {_cols(corpora.TDM_FETCH_COLUMNS)} FROM hops WHERE {corpora.TDM_FETCH_ROWS})),
starts AS (SELECT base, {_ORIGIN.replace('url', 'base')} AS origin, 'robots' AS kind, base || '/robots.txt' AS url FROM bases
  UNION ALL SELECT base, {_ORIGIN.replace('url', 'base')}, 'tdmrep', base || '/.well-known/tdmrep.json' FROM bases)"""
# Locations in the log are of five forms only.
_NEXT = """CASE WHEN location IN ('r1') THEN base || '/r1' WHEN location = './y/../x/robots2.txt?v=1' THEN base || '/x/robots2.txt?v=1'
    WHEN starts_with(location, '//') THEN regexp_extract(base, '^[a-z]+:') || location WHEN starts_with(location, '/') THEN base || location ELSE location END"""


def _walk(known: bool = False) -> str:
    stop = "AND NOT spot = 'https://hot.example.org/robots.txt'" if known else ""
    final = (
        "WHEN hop > 0 AND spot = 'https://hot.example.org/robots.txt' THEN {}" if known else ""
    )
    redirect = "coalesce(status IN (301, 302, 303, 307, 308), false)"
    return f"""walk AS (
  SELECT s.*, s.url AS spot, 0 AS hop FROM starts s
  UNION ALL SELECT w.base, w.origin, w.kind, w.url, {_NEXT.replace('base', 'w.base')}, w.hop + 1
  FROM walk w JOIN log l ON l.kind = w.kind AND l.url = w.spot
  WHERE l.error IS NULL AND {redirect} AND location IS NOT NULL AND w.hop < 5
    AND NOT starts_with(location, 'mailto:') {stop}),
ends AS (SELECT w.origin, w.kind, w.url, w.spot, w.hop, l.status, l.location, l.error AS failure, l.url IS NULL AS gone
  FROM walk w LEFT JOIN log l ON l.kind = w.kind AND l.url = w.spot
  QUALIFY row_number() OVER (PARTITION BY w.origin, w.kind ORDER BY w.hop DESC) = 1),
resolved AS (SELECT origin, kind, url,
    CASE {final.format("'https://cdn.example.org/r.txt'")} WHEN {redirect} THEN NULL ELSE spot END AS final_url,
    CASE {final.format("200")} WHEN gone OR failure IS NOT NULL OR {redirect} THEN NULL ELSE CAST(status AS BIGINT) END AS code,
    CASE {final.format("3")} WHEN gone OR failure IS NOT NULL OR {redirect} THEN NULL ELSE CAST(hop AS BIGINT) END AS num_redirects,
    CASE {final.format("NULL")} WHEN gone THEN 'not in the fetch log' WHEN failure IS NOT NULL THEN failure
      WHEN {redirect} AND hop >= 5 THEN 'Too many redirects'
      WHEN {redirect} AND location IS NULL THEN 'Got redirect response ' || status || ' for ' || url || ' without location'
      WHEN {redirect} THEN 'unknown protocol: mailto' END AS error
  FROM ends)"""


FETCHED = (LOG, _walk())
# Fetched robots.txt files as documents for the robots chain, keyed by origin.
FETCH_DOCS = """docs AS (SELECT r.origin AS doc_id, l.text, true AS is_parsed FROM resolved r JOIN log l
    ON l.kind = r.kind AND l.url = r.final_url WHERE r.kind = 'robots' AND r.error IS NULL)"""
JUDGED = f"""agents(agent, key) AS ({_values([(config.REFERENCE_AGENT, config.REFERENCE_AGENT.lower()), *[(a, a) for a in AGENTS]])}),
own AS (SELECT DISTINCT doc_id, agent AS key FROM ag),
pp AS (SELECT page_id, {_ORIGIN} AS origin, {PATH} AS path0 FROM pages),
denied AS (SELECT p.page_id, a.agent FROM (SELECT page_id, origin, CASE WHEN starts_with(path0, '/') THEN path0 ELSE '/' || path0 END AS path FROM pp) p
  CROSS JOIN agents a
  LEFT JOIN own o ON o.doc_id = p.origin AND o.key = a.key
  LEFT JOIN rgx r ON r.doc_id = p.origin AND r.agent = CASE WHEN o.key IS NULL THEN '*' ELSE o.key END AND regexp_matches(p.path, r.rx)
  GROUP BY p.page_id, a.agent, p.path HAVING NOT {_BEST} AND p.path <> '/robots.txt')"""
VERDICT_CHAIN = (*FETCHED, FETCH_DOCS, LINES, GROUPS, RULES, JUDGED)
FETCH_TDM = _tdm(
    "SELECT r.origin AS doc_id, l.text, l.content_type, strlen(l.text) > 0 AND NOT starts_with(l.content_type, 'text/html')"
    " AS is_parsed FROM resolved r JOIN log l ON l.kind = r.kind AND l.url = r.final_url WHERE r.kind = 'tdmrep' AND r.error IS NULL"
)
FIELDS = """fetchfields AS (
  SELECT page_id, 'fetcher.file.' || unnest(['fetchTime', 'robots.url', 'robots.code', 'robots.num-redirects', 'robots.error',
      'tdmrep.url', 'tdmrep.code', 'tdmrep.num-redirects', 'tdmrep.error', 'tdmrep.content-length', 'tdmrep.content-type',
      'tdmrep.num-groups', 'tdmrep.groups']) AS field,
    unnest(['1704067200000', r.final_url, r.code::VARCHAR, r.num_redirects::VARCHAR, r.error, t.final_url, t.code::VARCHAR,
      t.num_redirects::VARCHAR, coalesce(t.error, g.error), strlen(j.text)::VARCHAR, j.content_type, g.num_groups::VARCHAR, g.groups_text]) AS values
  FROM pp p LEFT JOIN resolved r ON r.origin = p.origin AND r.kind = 'robots'
  LEFT JOIN resolved t ON t.origin = p.origin AND t.kind = 'tdmrep'
  LEFT JOIN tp g ON g.doc_id = p.origin LEFT JOIN tj j ON j.doc_id = p.origin
  UNION ALL SELECT page_id, 'fetcher.file.robots.agents.' || agent, 'false' FROM denied)"""
PAGE_FIELDS = f"""pagefields AS (
  SELECT page_id, CASE key WHEN 'parse.canonical' THEN 'canonical' WHEN 'parse.title' THEN 'title'
    WHEN 'parse.description' THEN 'description' WHEN 'parse.keywords' THEN 'keywords' ELSE key END AS field, values FROM pagekeys
  UNION ALL SELECT page_id, 'host', {HOST} FROM pages
  UNION ALL SELECT page_id, 'domain', domain FROM pages JOIN domains ON domains.host = {HOST} WHERE domain IS NOT NULL)"""


# --- the queries --------------------------------------------------------------------------------------


def _robots(select: str) -> str:
    return _with(*ROBOTS) + select


def _total_share(counts: str, total: str, count: str) -> str:
    return f"SELECT c.*, round(c.{count} / t.total, 6) AS share FROM ({counts}) c JOIN ({total}) t USING (crawl)"


_NAMED = _total_share(
    "SELECT crawl, agent, count(*) AS docs FROM named JOIN docs USING (doc_id) GROUP BY ALL",
    "SELECT crawl, count(*) AS total FROM docs WHERE is_parsed GROUP BY ALL",
    "docs",
)
_WARC_STATUS = "CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END"
_WARC_KEPT = f"CASE WHEN page_id % 3 = 0 THEN 'decoded' WHEN page_id % 5 = 0 THEN 'unsupported' ELSE 'raw' END"

_ARCHIVES = f"greatest({archives.LEAST}, CAST(ceil(count(*) / {archives.PAGES}.0) AS BIGINT))"


def queries() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["s1_path_list"] = (
        "SELECT concat('/archive/crawl-data/', page_id, '.warc.gz') AS path, true AS numbered FROM pages"
    )
    sql["s3_warc_scan"] = (
        f"SELECT url, CAST({_WARC_STATUS} AS BIGINT) AS http_status, CAST(strlen(html) AS BIGINT) AS full_length,"
        f" {_WARC_KEPT} AS decode_status, md5(encode(html)) AS content_md5, true AS has_length FROM pages"
    )
    sql["s4_record_types"] = f"""SELECT 'warcinfo' AS type, {_ARCHIVES} AS n, CAST(0 AS BIGINT) AS responses FROM pages
      UNION ALL SELECT 'request', count(*), 0 FROM pages UNION ALL SELECT 'response', count(*), count(*) FROM pages"""
    sql["s5_statuses"] = f"SELECT CAST({_WARC_STATUS} AS BIGINT) AS status, count(*) AS n FROM pages GROUP BY 1"
    crlf = "chr(13) || chr(10)"
    sql["s10_verbatim_headers"] = f"""SELECT url, md5('HTTP/1.1 ' || CASE WHEN page_id % 7 = 0 THEN '404 Not Found' ELSE '200 OK' END || {crlf}
      || 'Content-Type: text/html' || {crlf} || CASE WHEN page_id % 3 = 0 THEN 'Content-Encoding: gzip' || {crlf}
      WHEN page_id % 5 = 0 THEN 'Content-Encoding: x-unknown' || {crlf} ELSE '' END || {crlf}) AS response_headers_md5,
      md5('GET /' || page_id || ' HTTP/1.1' || {crlf} || 'Host: ex' || {crlf} || {crlf}) AS request_headers_md5 FROM pages"""
    sql["s11_decoding"] = (
        f"SELECT {_WARC_KEPT} AS decode_status, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1"
    )
    sql["s13_record_counters"] = f"""SELECT 1695289670000 AS bucket, scope, CAST(n AS BIGINT) AS n FROM (
      SELECT 'warc_skipped_record_of_type_warcinfo' AS scope, {_ARCHIVES} AS n FROM pages
      UNION ALL SELECT 'warc_skipped_record_of_type_request', count(*) FROM pages
      UNION ALL SELECT 'warc_http_response_record', count(*) FROM pages UNION ALL SELECT 'fetched', count(*) FROM pages
      UNION ALL SELECT 'status_' || {_WARC_STATUS}, count(*) FROM pages GROUP BY 1
      UNION ALL SELECT 'bytes_fetched', sum(strlen(html)) FROM pages)"""
    sql["s3_warc_path_scan"] = f"SELECT 2 * count(*) + {_ARCHIVES} AS records, true AS complete FROM pages"
    sql["s3_split_scan"] = """SELECT url, 'request' AS type, NULL AS request_url, NULL AS content_md5, CAST(NULL AS BIGINT) AS full_length FROM pages
      UNION ALL SELECT url, 'response', url, md5(encode(html)), CAST(strlen(html) AS BIGINT) FROM pages"""
    multimap = "SELECT page_id, lower(name) AS name, string_agg(value, '|' ORDER BY n) AS values FROM hdr GROUP BY ALL"
    sql["s6_header_map"] = _with(HEADERS) + multimap
    sql["s6_header_groups"] = sql["s6_header_map"]
    sql["s7_capture_columns"] = (
        f"SELECT url, CAST({_WARC_STATUS} AS VARCHAR) AS status, '1695289671000' AS request_time, '10.0.0.1' AS ip,"
        " 'GET /' || page_id AS request_line, 'text/html' AS content_type, true AS has_offset FROM pages"
    )
    sql["s8_record_lengths"] = (
        "SELECT user_id AS file, event_id AS \"offset\", lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id"
        ' AS length FROM events'
    )
    sql["s9_preceding_request"] = """SELECT file, "offset", CAST(req AS VARCHAR) AS request_id,
      CASE WHEN req = "offset" - 7 OR req % 3 = "offset" % 3 THEN 'GET ' || req END AS request_headers
      FROM (SELECT user_id AS file, event_id AS "offset", last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS req FROM events)"""
    sql["s12_truncation"] = """SELECT page_id, CAST(least(strlen(html), 2048) AS BIGINT) AS content_length,
      strlen(html) > 2048 OR page_id % 10 = 0 AS trimmed,
      CASE WHEN page_id % 10 = 0 THEN 'disconnect' WHEN strlen(html) > 2048 THEN 'length' END AS trimmed_reason,
      md5(encode(html)[1:2048]) AS content_md5 FROM pages"""
    buckets = "epoch_ms(time_bucket(INTERVAL 10 SECOND, ts)) AS bucket, event_type AS scope, count(*) AS n"
    sql["s13_counters"] = (
        f"SELECT {buckets}, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL"
    )
    sql["s13_stream_counters"] = sql["s13_counters"]
    sql["s14_labels"] = _with(LABELS) + "SELECT host, label FROM labels_ WHERE label IS NOT NULL"
    registry = [
        (c, "robotstxt", f"/data/input/{c}/", "robotstxt.paths", f"content-robots-{c}") for c in config.CRAWLS
    ]
    sql["s15_crawl_registry"] = (
        _with(f"reg(crawl, dataset, input_dir, paths, index_name) AS ({_values(registry)})", DOCS)
        + "SELECT reg.*, (SELECT count(*) FROM docs WHERE docs.crawl = reg.crawl) AS docs FROM reg"
    )
    sql["s16_first_documents"] = """SELECT file_no, "offset" FROM (
      SELECT l_orderkey % 13 AS file_no, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS "offset" FROM lineitem)
      ORDER BY file_no, "offset" LIMIT 20000"""

    sql["s16_stored_index"] = sql["s16_first_documents"]

    sql["h0_annotations"] = _with(PAGES, ANNOTATIONS) + "SELECT page_id, key, pos, value FROM ann"
    for name, key in annotation_query_names().items():
        sql[name] = _with(PAGES, ANNOTATIONS) + f"SELECT page_id, pos, value FROM ann WHERE key = '{key}'"

    sql["m1_host"] = f"SELECT page_id, {HOST} AS host FROM pages"
    sql["m2_domain"] = (
        _with(DOMAINS) + f"SELECT page_id, host, domain FROM (SELECT page_id, {HOST} AS host FROM pages) JOIN domains USING (host)"
    )
    sql["m3_headers"] = _with(HEADERS) + (
        "SELECT page_id, key, string_agg(value, '|' ORDER BY pos) AS values FROM hsel GROUP BY ALL"
    )
    sql["m4_comma_split"] = _with(*ANNOTATED) + (
        "SELECT page_id, key, CAST(pos AS BIGINT) AS pos, value FROM refd"
        " WHERE key IN ('parse.keywords', 'parse.http.x-robots-tag')"
    )
    sql["m5_directives"] = _with(*ANNOTATED) + (
        "SELECT page_id, values AS directives FROM pagekeys WHERE key = 'parse.meta.robots'"
    )
    sql["m6_labels"] = _with(LABELS) + (
        f"SELECT page_id, p.host, label FROM (SELECT page_id, {HOST} AS host FROM pages) p LEFT JOIN labels_ USING (host)"
    )
    sql["m7_page_records"] = _with(PAGES, ANNOTATIONS) + (
        f"SELECT page_id, crawl, url, {HOST} AS host, (SELECT count(DISTINCT key) FROM ann WHERE ann.page_id = pg.page_id) AS keys FROM pg"
    )
    sql["m8_quarantine"] = _with(*TDM) + "SELECT doc_id, error FROM tp WHERE error IS NOT NULL"

    sql["r1_early_outs"] = _with(DOCS) + "SELECT doc_id, content_length, content_type, is_parsed FROM docs"
    sql["r2_decoded"] = _with(DOCS) + "SELECT doc_id, md5(text) AS text_md5 FROM docs"
    sql["r3_lines"] = _with(DOCS, LINES) + "SELECT doc_id, n, raw FROM raw"
    sql["r4_num_lines"] = _robots("SELECT doc_id, num_lines FROM stats")
    sql["r5_stripped_lines"] = _with(DOCS, LINES) + (
        "SELECT doc_id, (SELECT count(*) FROM tok WHERE tok.doc_id = docs.doc_id) AS kept_lines FROM docs WHERE is_parsed"
    )
    sql["r6_directives"] = _with(DOCS, LINES) + "SELECT doc_id, n, directive, value FROM tok"
    sql["r7_groups"] = _with(DOCS, LINES, GROUPS) + (
        "SELECT doc_id, CAST(grp AS BIGINT) AS grp, coalesce(string_agg(lower(value), '|' ORDER BY n) FILTER (directive = 'user-agent'), '') AS agents,"
        " count(*) FILTER (directive <> 'user-agent') AS num_rules FROM grp GROUP BY ALL"
    )
    sql["r8_rule_counts"] = _robots("SELECT doc_id, num_disallow, num_disallow_empty, num_allow FROM stats")
    sql["r9_user_agents"] = _robots("SELECT doc_id, num_useragents, useragents FROM stats")
    sql["r10_sitemaps"] = _robots("SELECT doc_id, num_sitemaps, sitemaps FROM stats")
    sql["r11_crawl_delay"] = _robots("SELECT doc_id, crawldelay FROM stats")
    sql["r12_agent_counts"] = _robots(f"SELECT doc_id, {LABELLED}, num_allow, num_disallow, num_disallow_empty FROM counts")
    sql["r13_directories"] = _robots("SELECT doc_id, d AS directory FROM dirs")
    own = f"""agents(agent, key) AS ({_values([(config.REFERENCE_AGENT, config.REFERENCE_AGENT.lower()), *[(a, a) for a in AGENTS]])}),
pq AS (SELECT page_id AS doc_id, {PATH} AS path FROM pages)"""
    sql["r14_verdicts"] = _with(DOCS, LINES, GROUPS, RULES, own) + f"""SELECT p.doc_id, p.path, a.agent FROM pq p CROSS JOIN agents a
      LEFT JOIN named o ON o.doc_id = p.doc_id AND o.agent = a.key
      LEFT JOIN rgx r ON r.doc_id = p.doc_id AND r.agent = CASE WHEN o.agent IS NULL THEN '*' ELSE o.agent END AND regexp_matches(p.path, r.rx)
      GROUP BY ALL HAVING NOT {_BEST}"""
    sql["r15_blanket_bans"] = _robots(f"SELECT doc_id, {LABELLED} FROM bans")
    sql["r16_bias"] = _robots("SELECT doc_id, agent, bias FROM bias")
    sql["r17_probe_base"] = f"SELECT page_id, '' AS of_robots, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS of_page FROM pages"
    sql["r18_status_fields"] = _with(*ROBOTS, _FIELD_ROWS) + (
        "SELECT doc_id, 'fetcher.file.robots.' || field AS field, values FROM fieldrows WHERE values IS NOT NULL"
    )
    sql["r19_profile"] = _robots("""SELECT doc_id, crawl, url, CAST(status AS BIGINT) AS status, content_type, is_parsed, content_length, num_lines,
      num_disallow, num_disallow_empty, num_allow, num_sitemaps, num_useragents, crawldelay,
      CASE WHEN is_parsed THEN (SELECT count(*) FROM dirs WHERE dirs.doc_id = stats.doc_id) END AS num_directories,
      CASE WHEN is_parsed THEN (SELECT count(*) FROM bans WHERE bans.doc_id = stats.doc_id) END AS bans,
      CASE WHEN is_parsed THEN coalesce((SELECT CAST(sum(bias) AS BIGINT) FROM bias WHERE bias.doc_id = stats.doc_id), 0) END AS bias_sum FROM stats""")

    sql["t1_admitted"] = _with(TDM_DOCS) + "SELECT doc_id, content_length, content_type, is_parsed FROM tdocs"
    sql["t2_groups"] = _with(*TDM) + "SELECT doc_id, num_groups, error FROM tp"
    sql["t3_coerced"] = _with(*TDM) + (
        "SELECT CAST(tdm_reservation AS BIGINT) AS reservation, count(*) AS n, count(tdm_policy) AS with_policy FROM tg GROUP BY ALL"
    )
    sql["t4_rendered"] = _with(*TDM) + "SELECT doc_id, groups_text FROM tp"
    sql["t5_group_rows"] = _with(*TDM) + (
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, location, CAST(tdm_reservation AS BIGINT) AS tdm_reservation, tdm_policy FROM tg"
    )

    sql["f1_validated"] = _with(ODD) + (
        "SELECT page_id, url, CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN url || ' is a malformed URL' END AS error"
        " FROM odd WHERE trim(url) <> ''"
    )
    sql["f2_origin"] = _with(ODD) + f"SELECT page_id, {_ORIGIN} AS origin FROM odd"
    sql["f3_policy_urls"] = (
        f"SELECT page_id, {_BASE} || '/robots.txt' AS robots_url, {_BASE} || '/.well-known/tdmrep.json' AS tdmrep_url FROM pages"
    )
    sql["f4_work_list"] = (
        _with(LOG) + f"SELECT {_ORIGIN} AS origin, min({_BASE} || '/robots.txt') AS robots_url,"
        f" min({_BASE} || '/.well-known/tdmrep.json') AS tdmrep_url FROM pages GROUP BY 1"
        f" HAVING {_ORIGIN.replace('url', 'any_value(url)')} NOT IN (SELECT {_ORIGIN} FROM log WHERE kind = 'robots' AND status = 200)"
    )
    sql["f5_cache_hits"] = """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
      UNION ALL SELECT user_id, min(e.ts) FROM (SELECT m.user_id, e.ts FROM m JOIN events e
        ON e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL 7 DAY) e GROUP BY user_id),
      f AS (SELECT e.event_id, e.user_id, m.ts IS NOT NULL AS at_miss, row_number() OVER (PARTITION BY e.user_id, e.ts ORDER BY event_id) AS rn
        FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.ts = e.ts)
      SELECT event_id, user_id AS origin, NOT (at_miss AND rn = 1) AS cached FROM f"""
    sql["f5_stream_cache_hits"] = sql["f5_cache_hits"]
    sql["f6_redirects"] = _with(*FETCHED) + (
        "SELECT origin, url, final_url, code, num_redirects, error FROM resolved WHERE kind = 'robots'"
    )
    sql["f7_shortcuts"] = _with(LOG, _walk(known=True)) + (
        "SELECT origin, final_url, code, num_redirects, error FROM resolved WHERE kind = 'robots'"
    )
    sql["f8_fetch_failures"] = _with(*FETCHED, FETCH_DOCS, LINES, GROUPS, RULES) + f"""SELECT origin, error,
      EXISTS (SELECT 1 FROM rgx WHERE rgx.doc_id = origin AND (agent IN (FROM tracked) OR agent IN ('*', '{config.REFERENCE_AGENT.lower()}'))) AS has_rules
      FROM resolved WHERE kind = 'robots'"""
    sql["f9_page_verdicts"] = _with(*VERDICT_CHAIN) + "SELECT page_id, agent FROM denied"
    wide = ", ".join(
        f"CASE WHEN count(*) FILTER (agent = '{a}') > 0 THEN false END AS {a.replace('-', '_').lower()}"
        for a in [config.REFERENCE_AGENT, *AGENTS]
    )
    sql["f9_verdicts_wide"] = _with(*VERDICT_CHAIN) + (
        f"SELECT page_id, {wide} FROM pages LEFT JOIN denied USING (page_id) GROUP BY page_id"
    )
    sql["f10_page_tdm"] = _with(*FETCHED, FETCH_TDM) + f"""SELECT page_id, t.final_url AS tdm_url, t.code AS tdm_code, g.num_groups,
      coalesce(t.error, g.error) AS tdm_error FROM (SELECT page_id, {_ORIGIN} AS origin FROM pages) p
      LEFT JOIN resolved t ON t.origin = p.origin AND t.kind = 'tdmrep' LEFT JOIN tp g ON g.doc_id = p.origin"""
    sql["f11_fetch_fields"] = _with(*VERDICT_CHAIN, FETCH_TDM, FIELDS) + """SELECT page_id, field, values FROM fetchfields WHERE values IS NOT NULL
      UNION ALL SELECT page_id, 'fetcher.file.robots.cached', 'true' FROM pages"""

    page_fields = (*ANNOTATED, DOMAINS, LABELS, PAGE_FIELDS)
    page_rows = """SELECT page_id, field, values FROM pagefields"""
    extra = f"""UNION ALL SELECT page_id, 'capturetime', CAST(1695289671000 + page_id AS VARCHAR) FROM pages
      UNION ALL SELECT page_id, 'parse.curlieLabel', label FROM pages JOIN labels_ ON labels_.host = {HOST} WHERE label IS NOT NULL"""
    sql["e1_all_documents"] = _with(*ANNOTATED) + """SELECT crawl, count(*) AS docs,
      count(*) FILTER (page_id IN (SELECT page_id FROM refd WHERE key = 'parse.meta.robots' AND value = 'noindex')) AS noindex FROM pg GROUP BY ALL"""
    sql["e2_projection"] = _with(*page_fields) + page_rows + " " + extra
    sql["e3_newest_per_url"] = (
        f"SELECT {_BASE} AS url, max(page_id) AS page_id, CAST(arg_max(length(html), page_id) AS BIGINT) AS size FROM pages GROUP BY 1"
    )
    integer_field = "(field LIKE 'num-%' OR field LIKE 'bias.%' OR field IN ('content-length', 'crawldelay'))"
    sql["e4_typed_fields"] = _with(*ROBOTS, _FIELD_ROWS) + f"""SELECT doc_id,
      CAST(max(values) FILTER (field = 'num-lines') AS BIGINT) AS num_lines,
      CAST(max(values) FILTER (field = 'content-length') AS BIGINT) AS content_length,
      CAST(max(values) FILTER (field = 'bias.gptbot') AS BIGINT) AS bias_gptbot,
      count(*) FILTER (field = 'disallow-all.gptbot') > 0 AS ban_gptbot,
      count(*) FILTER ({integer_field}) AS integers, count(*) FILTER (field LIKE 'disallow-all.%') AS booleans
      FROM fieldrows WHERE values IS NOT NULL GROUP BY ALL"""
    sql["e4_typed_columns"] = _with(*page_fields) + f"""SELECT page_id, {HOST} AS host,
      (SELECT values FROM pagefields f WHERE f.page_id = p.page_id AND field = 'title') AS title,
      1695289671000 + page_id AS capturetime,
      (SELECT values FROM pagefields f WHERE f.page_id = p.page_id AND field = 'parse.html.language') AS language FROM pages p"""
    sql["e5_partitioned_sink"] = _with(DOCS) + "SELECT 'robotstxt' AS dataset, crawl, count(*) AS docs FROM docs GROUP BY ALL"
    sql["e6_robots_documents"] = _with(*ROBOTS, _FIELD_ROWS, DOMAINS, LABELS) + f"""
      SELECT doc_id, 'fetcher.file.robots.' || field AS field, values FROM fieldrows WHERE values IS NOT NULL
      UNION ALL SELECT doc_id, 'host', {HOST} FROM docs
      UNION ALL SELECT doc_id, 'domain', domain FROM docs JOIN domains ON domains.host = {HOST} WHERE domain IS NOT NULL
      UNION ALL SELECT doc_id, 'parse.curlieLabel', label FROM docs JOIN labels_ ON labels_.host = {HOST} WHERE label IS NOT NULL"""
    sql["e6_page_documents"] = _with(*page_fields) + (
        f"SELECT page_id, crawl, url, count(field) AS fields FROM pg LEFT JOIN ({page_rows} {extra}) USING (page_id) GROUP BY ALL"
    )
    sql["e6_captured_page_documents"] = _with(*ANNOTATED, DOMAINS, PAGE_FIELDS) + f"""{page_rows} WHERE field NOT LIKE 'parse.http.%'
      UNION ALL SELECT page_id, 'capturetime', '1695289671000' FROM pages
      UNION ALL SELECT page_id, 'ip', '10.0.0.1' FROM pages"""
    sql["e6_reruns"] = "SELECT url, md5(encode(html)) AS content_md5, '2023-50' AS crawl FROM pages"
    sql["e6_set_aside"] = "SELECT 'response without URL' AS error, count(*) AS n FROM pages WHERE page_id % 9 = 0"
    requests = f"requests AS (SELECT page_id, {_ORIGIN} AS origin, 1695289671 + page_id * 7919 % 1009 * 1800 AS t FROM pages)"
    spans = """spans AS (SELECT origin, min(t) AS t FROM requests GROUP BY 1
      UNION ALL SELECT origin, min(t) FROM (SELECT s.origin, q.t FROM spans s JOIN requests q
        ON q.origin = s.origin AND q.t >= s.t + 7 * 86400) GROUP BY origin)"""
    sql["e6_fetched_page_documents"] = _with(
        requests, spans, *VERDICT_CHAIN, FETCH_TDM, FIELDS, *ANNOTATED, DOMAINS.replace("rules(", "suffix_rules(").replace("JOIN rules", "JOIN suffix_rules"), PAGE_FIELDS
    ) + f"""{page_rows} UNION ALL SELECT page_id, field, values FROM fetchfields WHERE values IS NOT NULL
      UNION ALL SELECT page_id, 'fetcher.file.robots.cached', CASE WHEN spans.t IS NOT NULL AND
        row_number() OVER (PARTITION BY q.origin, q.t ORDER BY page_id) = 1 THEN 'false' ELSE 'true' END
      FROM requests q LEFT JOIN spans ON spans.origin = q.origin AND spans.t = q.t"""

    sql["q1_agents_named"] = _robots(_NAMED)
    sql["q2_agents_blocked"] = _robots(f"""SELECT crawl, agent, blocked, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY blocked DESC, agent) AS rank FROM (
        SELECT crawl, {LABELLED}, count(*) AS blocked FROM bans JOIN docs USING (doc_id) GROUP BY ALL)) WHERE rank <= 5""")
    sql["q3_bias_summary"] = _robots("""SELECT crawl, agent, count(*) AS docs, round(avg(bias), 6) AS avg_bias,
      count(*) FILTER (bias < 0) AS negative, count(*) FILTER (bias = 0) AS neutral, count(*) FILTER (bias > 0) AS positive
      FROM bias JOIN docs USING (doc_id) GROUP BY ALL""")
    sql["q4_change"] = _robots(f"""SELECT crawl, agent, share, lag(share) OVER w AS previous, round(share - lag(share) OVER w, 6) AS change
      FROM ({_NAMED}) WINDOW w AS (PARTITION BY agent ORDER BY crawl)""")
    sql["q5_annotation_prevalence"] = _with(*ANNOTATED) + _total_share(
        "SELECT crawl, key, count(*) AS urls FROM pagekeys JOIN pg USING (page_id) GROUP BY ALL",
        "SELECT crawl, count(*) AS total FROM pg GROUP BY ALL",
        "urls",
    )
    sql["q6_directive_frequency"] = _with(*ANNOTATED) + """SELECT crawl, key, value AS directive, count(*) AS n FROM refd JOIN pg USING (page_id)
      WHERE key IN ('parse.meta.robots', 'parse.http.x-robots-tag') GROUP BY ALL"""
    sql["q7_status_breakdown"] = _with(DOCS) + """SELECT crawl, CAST(status AS BIGINT) AS status, content_type, count(*) AS docs,
      round(CAST(quantile_cont(content_length, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_cont(content_length, 0.95) AS DOUBLE), 6) AS p95,
      CAST(grouping(crawl, status, content_type) AS BIGINT) AS level FROM docs GROUP BY ROLLUP (crawl, status, content_type)"""
    sql["q7_size_buckets"] = _with(DOCS) + """SELECT crawl, CAST(status AS BIGINT) AS status,
      CASE WHEN content_length > 0 THEN CAST(floor(log2(content_length)) AS BIGINT) ELSE -1 END AS bucket, count(*) AS docs FROM docs GROUP BY ALL"""
    middle = "((b % 256) << (b // 256)) + CASE WHEN b >= 256 THEN 1 << (b // 256 - 1) ELSE 0 END"
    rank = "min(bucket) FILTER (upto >= greatest(ceil({} * sized), 1))"
    p50, p95 = (f"CAST((SELECT {middle} FROM (SELECT {c} AS b)) AS BIGINT) AS {c}" for c in ("p50", "p95"))
    sql["q7_stored_quantiles"] = _with(
        DOCS,
        "cut AS (SELECT crawl, status, content_length AS size, greatest(length(bin(content_length)) - 8, 0) AS cut FROM docs)",
        "buckets AS (SELECT crawl, status, CASE WHEN size IS NOT NULL THEN cut * 256 + (size >> cut) END AS bucket FROM cut)",
        """summed AS (SELECT crawl, status, bucket, count(*) AS n, CAST(grouping(crawl, status) AS BIGINT) AS level
          FROM buckets GROUP BY GROUPING SETS ((crawl, status, bucket), (crawl, bucket), (bucket)))""",
        """run AS (SELECT *, sum(CASE WHEN bucket IS NOT NULL THEN n END) OVER (PARTITION BY crawl, status, level) AS sized,
          sum(n) OVER (PARTITION BY crawl, status, level ORDER BY bucket NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM summed)""",
        f"""found AS (SELECT crawl, CAST(status AS BIGINT) AS status, CAST(sum(n) AS BIGINT) AS docs, level,
          {rank.format("CAST(0.5 AS DOUBLE)")} AS p50, {rank.format("CAST(0.95 AS DOUBLE)")} AS p95 FROM run GROUP BY crawl, status, level)""",
    ) + f"SELECT crawl, status, docs, level, {p50}, {p95} FROM found"
    sql["q8_by_label"] = _with(*ANNOTATED, LABELS) + f"""SELECT crawl, label, count(*) AS n, CAST(grouping(crawl, label) AS BIGINT) AS level
      FROM (SELECT crawl, label FROM pg LEFT JOIN labels_ ON labels_.host = {HOST}
        WHERE page_id IN (SELECT page_id FROM refd WHERE key = 'parse.meta.tdm-reservation')) GROUP BY CUBE (crawl, label)"""
    sql["q9_sitemap_and_delay"] = _robots("""SELECT crawl, count(*) AS docs, count(*) FILTER (num_sitemaps > 0) AS with_sitemap,
      count(crawldelay) AS with_delay, max(crawldelay) AS max_delay FROM stats GROUP BY ALL""")
    restricts = f"regexp_matches(lower(value), '{config.RESTRICTS}') AND NOT starts_with(lower(value), 'max-')"
    sql["q10_mechanisms"] = _with(*VERDICT_CHAIN, FETCH_TDM, *ANNOTATED) + f"""SELECT crawl, CASE WHEN combo = '' THEN 'none' ELSE combo END AS combination, count(*) AS pages
      FROM (SELECT crawl, concat_ws('+',
        CASE WHEN page_id IN (SELECT page_id FROM refd WHERE key = 'parse.meta.robots' AND {restricts}) THEN 'meta' END,
        CASE WHEN page_id IN (SELECT page_id FROM refd WHERE key = 'parse.http.x-robots-tag' AND {restricts}) THEN 'header' END,
        CASE WHEN page_id IN (SELECT page_id FROM denied WHERE agent = 'gptbot') THEN 'robots' END,
        CASE WHEN {_ORIGIN} IN (SELECT doc_id FROM tg WHERE tdm_reservation = 1) THEN 'tdm' END) AS combo FROM pg) GROUP BY ALL"""
    sql["q11_licences"] = _with(*ANNOTATED) + """SELECT crawl, key, CASE WHEN k <> '' THEN k ELSE 'other' END AS licence, count(*) AS links
      FROM (SELECT crawl, key, regexp_extract(lower(value), 'creativecommons\\.org/(?:licenses|publicdomain)/([a-z0-9+-]+)', 1) AS k
        FROM refd JOIN pg USING (page_id) WHERE key IN ('parse.creativecommons', 'parse.rel.license')) GROUP BY ALL"""
    sql["q12_distinct_agents"] = _robots("SELECT crawl, count(DISTINCT agent) AS agents FROM named JOIN docs USING (doc_id) GROUP BY ALL")
    sql["q12_approximate_agents"] = _robots("SELECT DISTINCT crawl, true AS within_bound FROM named JOIN docs USING (doc_id)")
    # A sketch of few values counts them exactly.
    sql["q12_stored_agents"] = _robots(
        "SELECT crawl, count(DISTINCT agent) AS agents FROM named JOIN docs USING (doc_id) GROUP BY ROLLUP (crawl)"
    )
    return sql
