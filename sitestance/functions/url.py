"""URL expressions.

Written with one anchored pattern instead of ``try_parse_url``, which gives NULL
for host names with an underscore and for paths holding a bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# scheme, authority, path with query, fragment
_URL = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"
_DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    """Host and port as written, user information removed."""
    return F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host, NULL when the URL has none."""
    name = F.lower(F.regexp_replace(authority(url), r":[0-9]*$", ""))
    return F.when(name != "", name)


def port(url: Column) -> Column:
    """The port in the URL, or the scheme's default."""
    written = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    default = F.coalesce(*[F.when(scheme(url) == s, F.lit(p)) for s, p in _DEFAULT_PORTS.items()])
    return F.when(written != "", written).otherwise(default)


def is_valid(url: Column) -> Column:
    """Known protocol, as a URL object would require it."""
    return scheme(url).isin(*_DEFAULT_PORTS) & F.coalesce(
        F.regexp_extract(authority(url), r":([^\]]*)$", 1).rlike(r"^[0-9]*$"), F.lit(False)
    )


def origin(url: Column) -> Column:
    """``scheme:host:port`` in lower case, default port filled in."""
    return F.concat_ws(":", scheme(url), F.coalesce(host(url), F.lit("")), port(url))


def site(url: Column) -> Column:
    """``scheme://authority`` with the authority as written."""
    return F.concat(
        F.regexp_extract(url, _URL, 1), F.lit("://"), F.regexp_extract(url, _URL, 2)
    )


def path_query(url: Column) -> Column:
    """Path and query, ``/`` when empty: the part that rules are compared with."""
    rest = F.regexp_extract(url, _URL, 3)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def path(url: Column) -> Column:
    return F.substring_index(path_query(url), "?", 1)


def fetch_key(url: Column) -> Column:
    """One spelling per fetchable resource: origin plus path and query."""
    return F.concat(origin(url), path_query(url))


def resolver(base: str, reference: str, name: str) -> Callable[[DataFrame], DataFrame]:
    """A step adding ``name``: a possibly relative reference against a base URL.

    Two projections, so that the joined URL is worked out once; dots are removed.
    """
    joined, clean = _joined(F.col(base), F.col(reference)), _drop_dots(F.col("_joined"))
    return lambda df: df.withColumn("_joined", joined).withColumn(name, clean).drop("_joined")


def _joined(base: Column, reference: Column) -> Column:
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    own_query = F.startswith(reference, F.lit("?"))
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(F.startswith(reference, F.lit("//")), F.concat(scheme(base), F.lit(":"), reference))
        .when(F.startswith(reference, F.lit("/")), F.concat(site(base), reference))
        .when(own_query, F.concat(site(base), path(base), reference))
        .otherwise(F.concat(site(base), folder, reference))
    )


def _drop_dots(url: Column) -> Column:
    """Remove ``.`` and ``..`` segments of the path with a fold over its segments."""
    segments = F.split(path(url).substr(F.lit(2), F.length(path(url))), "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    query = F.regexp_extract(path_query(url), r"(\?.*)$", 1)
    rebuilt = F.concat(site(url), F.lit("/"), F.array_join(closed, "/"), query)
    has_dots = path(url).rlike(r"(^|/)\.\.?(/|$)")
    return F.when(has_dots, rebuilt).otherwise(url)
